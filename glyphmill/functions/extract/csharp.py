"""Code units of C# sources: public types, and the public methods and properties of public classes."""

from __future__ import annotations

import re

from glyphmill.functions.extract.source import Source, Unit, blank

_LITERALS = [
    r"//[^\n]*",
    r"/\*.*?(?:\*/|\Z)",
    r'\$*("{3,}).*?\1',
    r'(?:\$@|@\$|@)"(?:""|[^"])*"',
    r'\$?"(?:\\.|[^"\\\n])*"',
    r"'(?:\\[^'\n]*|[^'\\\n])'",
    r"^[ \t]*\#[^\n]*",
]
_PATTERN = re.compile("|".join(_LITERALS), re.S | re.M)
_TYPE = re.compile(r"\b(?P<word>class|interface|enum|struct|record|namespace)\s+(?P<name>@?[A-Za-z_]\w*)")
_METHOD = re.compile(r"(?P<name>[A-Za-z_]\w*)\s*(?:<[^()]*>)?\s*$")
_MODIFIERS = {"public", "private", "protected", "internal", "static", "virtual", "override", "abstract", "sealed", "async", "extern", "new", "partial", "unsafe", "readonly", "required", "volatile"}


def units(text: str) -> list[Unit]:
    source = Source(text, blank(text, [], _PATTERN))
    out: list[Unit] = []
    _scan(source, 0, len(text), out)
    return out


def _declaration_start(source: Source, at: int, low: int) -> int:
    """Where the declaration begins whose keyword is at ``at``, with its modifiers and attributes."""
    begin = max(source.blanked.rfind(c, low, at) for c in ";{}") + 1
    begin = max(begin, low)
    return begin + len(source.blanked[begin:at]) - len(source.blanked[begin:at].lstrip())


def _is_public(source: Source, start: int, head: int) -> bool:
    return "public " in source.text[start:head]


def _scan(source: Source, at: int, end: int, out: list[Unit]) -> None:
    low = at
    while match := _TYPE.search(source.blanked, at, end):
        at = match.end()
        word = match["word"]
        start = _declaration_start(source, match.start(), low)
        lead = source.blanked[start : match.start()]
        if re.search(r"[=(,<:.]|\bwhere\b", re.sub(r"\[[^\]]*\]", "", lead)):
            continue
        head = source.find_any("{;", at, end)
        if head < 0 or source.blanked[head] == ";" or head not in source.closing:
            continue
        stop = source.closing[head] + 1
        if word in ("class", "interface", "enum") and _is_public(source, start, head):
            out.append(source.unit(match["name"], word, start, stop))
            if word == "class":
                _members(source, head + 1, stop - 1, match["name"], out)
            at = low = stop
        else:
            low = head + 1


def _members(source: Source, at: int, end: int, parent: str, out: list[Unit]) -> None:
    text = source.blanked
    while at < end:
        at += len(text[at:end]) - len(text[at:end].lstrip())
        start = at
        while at < end and text[at] == "[" and at in source.closing:  # attributes
            at = source.closing[at] + 1
            at += len(text[at:end]) - len(text[at:end].lstrip())
        head = source.find_any("{;=", at, end)
        if head < 0:
            return
        header = text[at:head]
        arrow = text.startswith("=>", head)
        if text[head] == "{":
            stop = source.closing.get(head, -2) + 1
            after = re.compile(r"\s*=(?!>)").match(text, stop, end) if stop > 0 and "(" not in header else None
            if after:
                stop = source.find_any(";", after.end(), end) + 1
        elif text[head] == ";":
            stop = head + 1
        else:
            stop = source.find_any(";", head, end) + 1
        if stop <= 0:
            at = head + 1
            continue
        at = stop
        if not _is_public(source, start, head):
            continue
        nested = _TYPE.search(header)
        paren = header.find("(")
        if nested:
            if nested["word"] == "enum":
                out.append(source.unit(nested["name"], "enum", start, stop, parent))
        elif paren >= 0:
            named = _METHOD.search(header[:paren])
            words = [w for w in re.findall(r"[A-Za-z_][\w.]*", header[: named.start()] if named else "") if w not in _MODIFIERS]
            if named and words and "delegate" not in words and "operator" not in words:
                out.append(source.unit(named["name"], "method", start, stop, parent))
        elif text[head] == "{" or arrow:
            words = re.findall(r"[A-Za-z_]\w*", header)
            if "event" not in words and "this" not in words and "operator" not in words and words:
                out.append(source.unit(words[-1], "constant", start, stop, parent))
