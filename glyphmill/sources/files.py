"""Source files of a repository: the walk with its filters, and their contents as a frame."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.ids import content_hash
from glyphmill.functions.paths import EXCLUDED_DIRECTORIES, has_nul, language_of, relative_to
from glyphmill.schema import EXTENSIONS
from glyphmill.sources.ignore import Rule, is_ignored, rules_of

MAX_FILE_SIZE = 1 << 20


def _text(path: Path) -> str:
    return path.read_text("utf-8", "replace") if path.is_file() else ""


def _outer_rules(root: Path) -> list[Rule]:
    """Rules from above the root, the repository's exclude file, and the user's global ignore file."""
    config = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    rules = rules_of(_text(config / "git" / "ignore"))
    for above in reversed(root.parents):
        inner = root.relative_to(above).as_posix()
        for rule in rules_of(_text(above / ".gitignore")):
            # Anchored rules of folders above speak of paths that begin with the way to the root.
            pattern = rule.pattern.pattern
            if pattern.startswith("(?:.*/)?"):
                rules.append(rule)
            elif pattern.startswith(re.escape(inner) + "/"):
                rules.append(Rule("", re.compile(pattern[len(re.escape(inner)) + 1 :]), rule.negated, rule.directory_only))
    return rules + rules_of(_text(root / ".git" / "info" / "exclude"))


def source_paths(root: str | Path, max_size: int = MAX_FILE_SIZE) -> list[str]:
    """Relative paths, in bytewise order, of files in known languages under the size limit.

    Hidden files are taken, symbolic links not followed, excluded directories (below the root)
    and what gitignore files name left out, whether the root is a git repository or not.
    """
    base = Path(root).resolve()
    found: list[str] = []
    rules_at = {".": _outer_rules(base)}
    for folder, folders, names in os.walk(base, followlinks=False):
        inner = os.path.relpath(folder, base).replace(os.sep, "/")
        prefix = "" if inner == "." else inner + "/"
        rules = rules_at.pop(inner) + rules_of(_text(Path(folder) / ".gitignore"), prefix.rstrip("/"))
        kept = [d for d in folders if d not in EXCLUDED_DIRECTORIES and not os.path.islink(os.path.join(folder, d)) and not is_ignored(rules, prefix + d, True)]
        folders[:] = kept
        rules_at |= {prefix + d: rules for d in kept}
        for name in names:
            path = os.path.join(folder, name)
            if name.rpartition(".")[2] in EXTENSIONS and "." in name[1:] and not os.path.islink(path) and not is_ignored(rules, prefix + name, False) and os.path.getsize(path) <= max_size:
                found.append(prefix + name)
    return sorted(found, key=str.encode)


def _glob_safe(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_sources(spark: SparkSession, root: str | Path, relative: list[str]) -> DataFrame:
    """file_path (relative), language, content, file_hash of listed files; binary files are left out."""
    base = str(Path(root).resolve())
    if not relative:
        return spark.createDataFrame([], "file_path string, language string, content binary, file_hash string")
    raw = spark.read.format("binaryFile").load([_glob_safe(f"{base}/{p}") for p in relative])
    plain = F.regexp_replace("path", "^file:/+", "/")
    rows = raw.select(relative_to(plain, base).alias("file_path"), "content").where(~has_nul(F.col("content")))
    return rows.select("file_path", language_of(F.col("file_path")).alias("language"), "content", content_hash(F.col("content")).alias("file_hash"))


def scan_sources(spark: SparkSession, folder: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The same of a whole folder in any store that Spark reads, by Spark's own listing (no gitignore rules)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{%s}" % ",".join(EXTENSIONS)).load(folder)
    base = F.lit(folder.rstrip("/") + "/")
    inside = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.regexp_replace(base, "^[a-z0-9]+:/+", "/"), F.lit(r"\E")), 2), 2)
    rows = raw.where(F.col("length") <= max_size).select(inside.alias("file_path"), "content")
    excluded = F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES]))
    kept = rows.where(~excluded & ~has_nul(F.col("content")))
    return kept.select("file_path", language_of(F.col("file_path")).alias("language"), "content", content_hash(F.col("content")).alias("file_hash"))
