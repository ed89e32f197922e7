"""Path expressions: languages, modules, relative paths, prefix filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.schema import EXTENSIONS

# Directories that are never indexed.
EXCLUDED_DIRECTORIES = (".git", "target", "node_modules", "dist", "build", "vendor", ".direnv", "bin", "obj", "packages")


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    extension = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.when(extension.isin(list(EXTENSIONS)), extension))


def in_excluded_directory(relative: Column) -> Column:
    """Whether a directory on the relative path is excluded."""
    return F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES]))


def has_nul(content: Column, window: int = 8192) -> Column:
    return F.position(F.lit(b"\0"), F.substring(content, 1, window)) > 0


def module_path(relative: Column) -> Column:
    """The parent directory, ``.`` for files at the root."""
    parent = F.regexp_extract(relative, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(".")).otherwise(parent)


def file_name(relative: Column) -> Column:
    return F.element_at(F.split(relative, "/"), -1)


def module_name(module: Column, root_name: Column | str) -> Column:
    """The last segment of a module's path; the root directory's name at the root."""
    root = F.lit(root_name) if isinstance(root_name, str) else root_name
    return F.when(module == ".", root).otherwise(file_name(module))


def normalized_filter(text: str | None) -> str | None:
    """A path filter with plain slashes and none at its ends; none if it means everything."""
    trimmed = (text or "").strip().replace("\\", "/").strip("/")
    return None if trimmed in ("", ".") else trimmed


def under(relative: Column, prefix: str | None) -> Column:
    """Whether a path is the prefix or lies below it."""
    return F.lit(True) if prefix is None else (relative == prefix) | relative.startswith(prefix + "/")


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    inside = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(path.startswith(base), inside).otherwise(F.raise_error(F.concat(F.lit("path is outside of the repository root: "), path)).cast("string"))
