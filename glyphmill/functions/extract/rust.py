"""Code units of Rust sources."""

from __future__ import annotations

import re

from glyphmill.functions.extract.source import Source, Unit, blank

_LITERALS = re.compile(
    r"""//[^\n]*|/\*|b?c?r(\#*)".*?"\1|[bc]?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\])'""",
    re.S,
)
_ITEM = re.compile(r"\b(?P<pub>pub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:(?:default|async|unsafe|const|extern)\s+)*)(?P<word>struct|enum|trait|fn|impl)\b(?:\s+(?P<name>(?:r\#)?[A-Za-z_]\w*))?")


_MACRO = re.compile(r"\b[A-Za-z_]\w*!\s*(?:[A-Za-z_]\w*\s*)?(?=[({\[])")
_BRACKETS = re.compile(r"[(){}\[\]]")


def _blanked(text: str) -> str:
    """``text`` without literals, comments and what is inside macro calls and definitions (tokens, not items)."""
    found = _without_literals(text)
    at = 0
    while match := _MACRO.search(found, at):
        at, depth = match.end(), 0
        for mark in _BRACKETS.finditer(found, match.end()):
            depth += 1 if mark[0] in "({[" else -1
            if not depth:
                found = found[: match.end() + 1] + re.sub(r"[^\n]", " ", found[match.end() + 1 : mark.start()]) + found[mark.start() :]
                at = mark.end()
                break
    return found


def _without_literals(text: str) -> str:
    out, at = [], 0
    while match := _LITERALS.search(text, at):
        end = match.end()
        if match[0] == "/*":
            depth = 1
            while depth and (mark := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
            end = end if not depth else len(text)
        out += [text[at : match.start()], blank(text[match.start() : end], ["."])]
        at = end
    return "".join([*out, text[at:]])


def _target(header: str) -> str:
    """The type that an impl is for, from the text between ``impl`` and its body."""
    rest, depth = header.strip(), 0
    if rest.startswith("<"):
        for k, char in enumerate(rest):
            depth += (char == "<") - (char == ">" and rest[k - 1] != "-")
            if not depth:
                rest = rest[k + 1 :]
                break
    rest = re.split(r"\bwhere\b", rest)[0]
    return re.split(r"\bfor\b(?!\s*<)", rest)[-1].strip()


def units(text: str) -> list[Unit]:
    source = Source(text, _blanked(text))
    out: list[Unit] = []
    _scan(source, 0, len(text), out)
    return out


def _items(source: Source, at: int, end: int):
    """(match, start, end of header, end) of items from ``at`` on; an item without an end has end -1."""
    while match := _ITEM.search(source.blanked, at, end):
        at = match.end()
        start = match.start()
        if source.before(start) not in ("", "{", "}", ";", "]") or match["word"] != "impl" and not match["name"]:
            continue
        head = source.find_any("{;", at, end)
        stop = -1 if head < 0 else head + 1 if source.blanked[head] == ";" else source.closing.get(head, -2) + 1
        at = yield match, start, head, stop
        at = match.end() if at is None else at


def _scan(source: Source, at: int, end: int, out: list[Unit]) -> None:
    items = _items(source, at, end)
    found = next(items, None)
    while found:
        match, start, head, stop = found
        word, name = match["word"], match["name"]
        public = source.text.startswith("pub ", start)
        skip = None
        if stop > 0:
            body = source.blanked[head] == "{"
            if word == "impl":
                if body:
                    _methods(source, head + 1, stop - 1, _target(source.text[match.end("word") : head]) or None, True, out)
                skip = stop
            elif word in ("struct", "enum") and public:
                out.append(source.unit(name, word, start, stop))
                skip = stop
            elif word == "trait" and public:
                out.append(source.unit(name, "trait", start, stop))
                if body:
                    _methods(source, head + 1, stop - 1, name, False, out)
                skip = stop
            elif word == "fn" and public and body:
                out.append(source.unit(name, "function", start, stop))
                skip = stop
        try:
            found = items.send(skip)
        except StopIteration:
            found = None


def _methods(source: Source, at: int, end: int, parent: str | None, with_body: bool, out: list[Unit]) -> None:
    """The functions directly in a body: those with bodies of impls, those without of traits."""
    items = _items(source, at, end)
    found = next(items, None)
    while found:
        match, start, head, stop = found
        if match["word"] == "fn" and stop > 0 and (source.blanked[head] == "{") == with_body:
            out.append(source.unit(match["name"], "method", start, stop, parent))
        try:
            found = items.send(stop if stop > 0 else None)
        except StopIteration:
            found = None
