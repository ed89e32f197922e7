"""Data model: table schemas, enumerations, configuration and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LANGUAGES = ("rust", "typescript", "csharp")
# File extensions and their languages.
EXTENSIONS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "cs": "csharp"}
# Kinds of code units.
KINDS = ("function", "method", "struct", "enum", "trait", "class", "interface", "constant", "module")
STATUSES = ("indexing", "ready", "failed")
MATCH_TYPES = ("fts", "vector", "hybrid")
# Weights of the searched fields.
FIELD_WEIGHTS = {"name": 6.0, "signature": 3.0, "doc": 2.0, "content": 1.0}

NATURAL_KEY = ("repo_id", "branch", "file_path", "name", "kind", "line_start")
PARTITION = ("repo_id", "branch")


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for item in text.split(","):
        name, kind = item.split()
        out.add(name, _KINDS[kind.rstrip("?")], kind.endswith("?"))
    return out


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}

CODE_UNITS = _struct(
    "rowid long, id string, repo_id string, branch string, file_path string, name string, kind string, signature string, doc string?, content string, "
    "parent string?, language string, line_start int, line_end int, embedding vector?, embedding_model string, file_hash string"
)
INDEXED_FILES = _struct("repo_id string, branch string, file_path string, file_hash string, chunk_count int, indexed_at timestamp")
INDEX_METADATA = _struct(
    "repo_id string, branch string, status string, last_indexed_at timestamp, last_commit_sha string?, last_seen_commit_sha string?, "
    "file_count int, symbol_count int, embedding_model string, last_error string?"
)
# The stored inverted index: one row a token occurrence, and the length of every unit.
POSTINGS = _struct("token string, rowid long, field string, pos int, n_tok long")
LENGTHS = _struct("rowid long, n_tok long")
MIGRATIONS = _struct("version int, name string, applied_at timestamp")
SCHEMA_VERSIONS = ((1, "initial tables"), (2, "index status and embedding model"))


@dataclass(frozen=True)
class SearchConfig:
    limit: int = 10
    rrf_k: int = 60
    use_fts: bool = True
    use_vector: bool = True
    min_score: float = 0.0

    @property
    def candidates(self) -> int:
        """Rows taken from each source before fusion."""
        return max(self.limit, 1) * 3


class EngineError(Exception):
    """Base of all errors of this package."""


class IndexError_(EngineError):
    """Indexing failed."""


class ParseError(EngineError):
    """A source file could not be parsed."""


class EmbeddingError(EngineError):
    """An embedder failed or gave a vector of another size."""


class StorageError(EngineError):
    """The store could not be read or written."""


class SearchError(EngineError):
    """A search could not be run."""


class RepoNotFoundError(EngineError):
    """The repository root does not exist."""


class NotIndexedError(EngineError):
    """The repository and branch hold no index yet."""
