"""gitignore rules, compiled to regular expressions over paths relative to a root."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    base: str
    pattern: re.Pattern
    negated: bool
    directory_only: bool

    def matches(self, relative: str, is_directory: bool) -> bool:
        if self.directory_only and not is_directory:
            return False
        if self.base and not relative.startswith(self.base + "/"):
            return False
        return self.pattern.fullmatch(relative[len(self.base) + 1 if self.base else 0 :]) is not None


def _regex(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        char = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
            continue
        if glob.startswith("/**", at) and at + 3 == len(glob):
            return out + "/.+"
        if char == "*":
            out += "[^/]*"
            at += len(glob[at:]) - len(glob[at:].lstrip("*"))
            continue
        if char == "?":
            out += "[^/]"
        elif char == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inside = glob[at + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            at = end
        elif char == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            out += re.escape(char)
        at += 1
    return out


def rules_of(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file that lies in the directory ``base``."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line[1:] if line.startswith(("\\!", "\\#")) else line
        directory_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _regex(line.lstrip("/"))
        out.append(Rule(base, re.compile(body if anchored else f"(?:.*/)?{body}"), negated, directory_only))
    return out


def is_ignored(rules: list[Rule], relative: str, is_directory: bool) -> bool:
    """Whether the last rule that matches excludes the path; its directories are asked about first by the walk."""
    for rule in reversed(rules):
        if rule.matches(relative, is_directory):
            return not rule.negated
    return False
