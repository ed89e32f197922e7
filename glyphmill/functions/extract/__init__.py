"""Symbol extraction: one source file to the code units in it."""

from __future__ import annotations

from glyphmill.functions.extract import csharp, rust, typescript
from glyphmill.functions.extract.source import Unit

_SCANNERS = {"rust": rust.units, "typescript": typescript.units, "csharp": csharp.units}


def extract(content: bytes, language: str) -> list[Unit]:
    """The units of a file in the order of the text; bytes that are no UTF-8 are an error."""
    return _SCANNERS[language](content.decode("utf-8"))
