"""Text expressions: search tokens, phrases, snippets, embedding text, identifiers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
SNIPPET_LINES = 7


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their bases, from Unicode's own decompositions."""
    pairs = {}
    for point in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(point).lower())[0]
        if base.isascii() and base.isalpha():
            pairs[chr(point)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BASES = _folding()
_FOLD = str.maketrans(ACCENTED, BASES)


def folded(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters (texts in ASCII have none to look for)."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.translate(low, ACCENTED, BASES))


def tokens(text: Column) -> Column:
    """Search tokens: maximal runs of letters and digits, folded; null gives none."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many search tokens a text has; folding does not move their ends."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def python_tokens(text: str) -> list[str]:
    """``tokens`` for query strings on the driver."""
    low = text.lower().translate(_FOLD)
    return re.findall(r"[^\W_]+", low)


def query_phrases(query: str) -> list[list[str]]:
    """The token phrases of a query: one a word of it; words without tokens are left out."""
    return [t for t in (python_tokens(word) for word in query.split()) if t]


def sanitized(query: str) -> str | None:
    """Each word quoted, inner quotes doubled; none for a blank query."""
    words = query.split()
    return " ".join('"' + w.replace('"', '""') + '"' for w in words) if words else None


def sanitized_column(query: Column) -> Column:
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(words) > 0, F.array_join(quoted, " "))


def snippet(content: Column, lines: int = SNIPPET_LINES) -> Column:
    """The first lines of a content; a content without lines as it is."""
    split = F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")
    return F.when(content == "", content).otherwise(F.array_join(F.slice(split, 1, lines), "\n"))


def embedding_text(signature: Column, doc: Column, content: Column) -> Column:
    """Signature, doc (where there is one) and content, with blanks between."""
    return F.concat_ws(" ", signature, F.when(doc != "", doc), content)


def identifiers(text: Column) -> Column:
    """The distinct ASCII identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))))


def single_line(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def parse_timestamp(text: Column) -> Column:
    """The time of an RFC 3339 text (date, time, optional fraction, offset or Z); null for any other text."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.upper(text)))
