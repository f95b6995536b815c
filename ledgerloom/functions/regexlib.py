"""Patterns of configuration files for Java's regex engine.

The files' patterns follow the syntax in which ``$`` is the very end, ``.``
stops at a line feed only, classes are Unicode, and a second quantifier repeats
the first (Java would take ``{3}+`` as possessive)."""

from __future__ import annotations

import re

_ATOM = re.compile(r"\\[pPx]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
_QUANTIFIER = re.compile(r"(?:\{\d+(?:,\d*)?\}|[*+?])\??")


def java(pattern: str) -> str:
    """The same pattern for Java."""
    out: list[str] = []
    opened: list[int] = []
    at = 0
    while at < len(pattern):
        atom = _ATOM.match(pattern, at).group()
        at += len(atom)
        start = len(out)
        if atom == "(":
            opened.append(start)
        elif atom == ")" and opened:
            start = opened.pop()
        out.append(r"\z" if atom == "$" else atom)
        if atom in "(|^$" or (atom == "?" and out[start - 1 : start] == ["("]):
            continue
        count = 0
        while m := _QUANTIFIER.match(pattern, at):
            if count:
                out[start:] = ["(?:" + "".join(out[start:]) + ")"]
            out.append(m.group())
            at = m.end()
            count += 1
    return "(?dU)" + "".join(out)
