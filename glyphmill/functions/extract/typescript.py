"""Code units of TypeScript sources: what is exported, and the public methods of exported classes."""

from __future__ import annotations

import re

from glyphmill.functions.extract.source import Source, Unit, blank

_START = re.compile(r"//|/\*|[\"'`]|/")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$)\]}\s]|\b(?:return|typeof|case|yield|await|in|of|delete|void|throw|new|else|do))\s*$")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?P<unit>(?:async\s+)?(?P<word>interface|type|function|class)\s+(?P<name>[A-Za-z_$][\w$]*))")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set|declare|abstract|accessor)\s+)*\*?\s*(?P<name>\#?[A-Za-z_$][\w$]*|\[[^\]]*\])\??\s*(?=[(<])")


def _template(text: str, at: int) -> int:
    """The end of a template literal that opens at ``at``; its expressions may hold others."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template(text, at)
                    continue
                if text[at] in "\"'":
                    at = _QUOTED[text[at]].match(text, at).end()
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return len(text)


def _blanked(text: str) -> str:
    out, at = [], 0
    while match := _START.search(text, at):
        begin, mark = match.start(), match[0]
        if mark == "//":
            end = text.find("\n", begin)
            end = len(text) if end < 0 else end
        elif mark == "/*":
            end = text.find("*/", begin + 2) + 2
            end = len(text) if end < 2 else end
        elif mark == "`":
            end = _template(text, begin)
        elif mark == "/":
            found = _REGEX.match(text, begin) if _BEFORE_REGEX.search(text[max(0, begin - 200) : begin]) else None
            end = found.end() if found else begin + 1
            if not found:
                out.append(text[at:end])
                at = end
                continue
        else:
            end = _QUOTED[mark].match(text, begin).end()
        out += [text[at:begin], blank(text[begin:end], ["."])]
        at = end
    return "".join([*out, text[at:]])


def _type_end(source: Source, at: int) -> int:
    """The end of a type alias: a semicolon, or a line end that nothing continues."""
    text = source.blanked
    while at < len(text):
        char = text[at]
        if char == ";":
            return at + 1
        if char in "([{":
            if at not in source.closing:
                return -1
            at = source.closing[at]
        elif char == "\n" and not re.search(r"[=|&?:,]\s*$|=>\s*$", text[:at]) and not re.match(r"\s*[|&?:]", text[at:]):
            return len(text[:at].rstrip())
        at += 1
    return len(text.rstrip())


def _body(source: Source, at: int, end: int) -> int:
    """The brace that opens the body after a parameter list and its return type; -1 for none."""
    text = source.blanked
    opened = re.compile(r"\s*(?:<[^(]*>)?\s*\(").match(text, at, end)
    if not opened or opened.end() - 1 not in source.closing:
        return -1
    at = source.closing[opened.end() - 1] + 1
    returned = re.compile(r"\s*:\s*").match(text, at, end)
    if returned:
        at = returned.end()
        while text[at : at + 1] == "{":  # an object type, not the body
            at = source.closing.get(at, end) + 1
            joined = re.compile(r"\s*[|&]\s*|\[\]").match(text, at, end)
            if not joined:
                break
            at = joined.end()
    found = source.find_any("{;=" if not returned else "{;", at, end)
    return found if found >= 0 and text[found] == "{" and found in source.closing else -1


def units(text: str) -> list[Unit]:
    source = Source(text, _blanked(text))
    out: list[Unit] = []
    at = 0
    while match := _EXPORT.search(source.blanked, at):
        at = match.end()
        line_start = source.blanked.rfind("\n", 0, match.start()) + 1
        if source.blanked[line_start : match.start()].strip() and source.before(match.start()) not in "{};":
            continue
        word, name, start = match["word"], match["name"], match.start("unit")
        if word == "type":
            stop = _type_end(source, at)
        else:
            head = _body(source, at, len(text)) if word == "function" else source.find_any("{", at, len(text))
            stop = source.closing.get(head, -2) + 1 if head >= 0 else -1
        if stop <= 0:
            continue
        out.append(source.unit(name, {"type": "constant"}.get(word, word), start, stop))
        if word == "class":
            _methods(source, head + 1, stop - 1, name, out)
        at = stop
    return out


def _methods(source: Source, at: int, end: int, parent: str, out: list[Unit]) -> None:
    text = source.blanked
    while at < end:
        at += len(text[at:end]) - len(text[at:end].lstrip())
        if at >= end:
            break
        if text[at] == "@":  # a decorator
            found = re.compile(r"@[\w$.]+\s*").match(text, at, end)
            at = found.end() if found else at + 1
            at = source.closing.get(at, at - 1) + 1 if text[at : at + 1] == "(" else at
            continue
        member = _MEMBER.match(text, at, end)
        head = _body(source, member.end(), end) if member else -1
        if head >= 0:
            stop = source.closing[head] + 1
            unit = source.unit(member["name"], "method", at, stop, parent)
            if not unit.signature.startswith(("private ", "protected ")):
                out.append(unit)
            at = stop
            continue
        # A field, a signature or a static block: on to its end.
        stop = at
        while stop < end and text[stop] not in ";\n":
            stop = source.closing.get(stop, stop) + 1
        at = stop + 1
