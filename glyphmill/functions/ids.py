"""Identities: content hashes, code unit ids, repository ids, store names."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.schema import NATURAL_KEY

SEPARATOR = "\x1f"


def code_unit_id(*columns: str | Column) -> Column:
    """sha256 of the natural key's values, joined by U+001F."""
    used = columns or NATURAL_KEY
    return F.sha2(F.concat_ws(SEPARATOR, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in used]), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def file_hash_or_content(file_hash: Column, content: Column) -> Column:
    return F.coalesce(file_hash, content_hash(content))


def long_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def short_hex(text: str) -> str:
    """The first eight bytes of the digest."""
    return long_hex(text)[:16]


def repo_id(root: str | Path) -> str:
    return short_hex(str(Path(root).resolve()))


def path_segment(name: str) -> str:
    """A name that is safe in a path; ``repo`` if nothing is left."""
    return re.sub(r"[^A-Za-z0-9_-]", "-", name).strip("-") or "repo"


def store_name(root: str | Path) -> str:
    resolved = Path(root).resolve()
    return f"{path_segment(resolved.name)}-{repo_id(resolved)}"
