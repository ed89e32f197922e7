"""Source text with comments and literals blanked out, and what the scanners share.

Blanking keeps every offset and line end, so braces and keywords can be looked for in the
blanked text and cut from the original.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_CLOSERS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Unit:
    name: str
    kind: str
    signature: str
    doc: str | None
    content: str
    parent: str | None
    line_start: int
    line_end: int


@dataclass
class Source:
    text: str
    blanked: str
    lines: list[str] = field(init=False)
    breaks: list[int] = field(init=False)
    closing: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.lines = self.text.splitlines()
        self.breaks = [i for i, c in enumerate(self.text) if c == "\n"]
        self.closing, stack = {}, []
        for match in re.finditer(r"[()\[\]{}]", self.blanked):
            at, char = match.start(), match[0]
            if char in _CLOSERS:
                stack.append((char, at))
                continue
            # A closer ends the nearest opener of its kind; openers above that stay open.
            depth = next((k for k in range(len(stack) - 1, -1, -1) if _CLOSERS[stack[k][0]] == char), None)
            if depth is not None:
                self.closing[stack[depth][1]] = at
                del stack[depth:]

    def line_of(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def find_any(self, chars: str, at: int, end: int) -> int:
        """The first of ``chars`` outside of brackets; -1 if there is none or a bracket stays open."""
        while at < end:
            char = self.blanked[at]
            if char in chars:
                return at
            if char in _CLOSERS:
                if at not in self.closing:
                    return -1
                at = self.closing[at]
            at += 1
        return -1

    def before(self, at: int) -> str:
        """The last character before a place that is no white space; empty at the start."""
        return self.blanked[:at].rstrip()[-1:] if at else ""

    def unit(self, name: str, kind: str, start: int, end: int, parent: str | None = None) -> Unit:
        content = self.text[start:end]
        return Unit(name, kind, signature(content), doc_above(self.lines, self.line_of(start) - 1), content, parent, self.line_of(start), self.line_of(end - 1))


def signature(content: str) -> str:
    """The text before the first brace, or else before the first equals sign, without a last semicolon."""
    for mark in "{=":
        head, found, _ = content.partition(mark)
        if found:
            return head.strip().rstrip(";").strip()
    return content.strip().rstrip(";").strip()


def doc_above(lines: list[str], row: int) -> str | None:
    """The doc comment that ends on the line above ``row`` (from 0)."""
    found: list[str] = []
    at = row - 1
    while at >= 0 and (line := lines[at].strip()).startswith(("///", "//!")):
        found.append(line[3:])
        at -= 1
    if at >= 0 and not found and lines[at].strip().startswith("*/"):
        while at >= 0:
            line = lines[at].strip()
            opens = line.startswith("/*")
            found.append(re.sub(r"^/\*+|^\*+/?|\*+/$", "", line))
            if opens:
                break
            at -= 1
    cleaned = (re.sub(r"</?summary>", "", part).strip() for part in reversed(found))
    return " ".join(part for part in cleaned if part) or None


def blank(text: str, patterns: list[str], whole: re.Pattern | None = None) -> str:
    """``text`` with every match of the patterns (first one wins) as blanks, line ends kept."""
    pattern = whole or re.compile("|".join(f"(?:{p})" for p in patterns), re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
