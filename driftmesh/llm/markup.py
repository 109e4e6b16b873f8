"""Small helpers that read the typesetting markup of one text."""

from __future__ import annotations

import re

_DEFINITION = re.compile(r"\\(?:newcommand|renewcommand|providecommand)\*?\s*\{?\s*(\\[A-Za-z]+)\s*\}?\s*(?:\[(\d)\])?(?:\[[^\]]*\])?\s*\{|\\def\s*(\\[A-Za-z]+)\s*((?:#\d)*)\s*\{|\\DeclareMathOperator\*?\s*\{(\\[A-Za-z]+)\}\s*\{")


def closing(text: str, at: int) -> int:
    """Place of the brace that closes the group opened just before ``at``; the end of the text if none does."""
    depth = 1
    for m in _BRACES.finditer(text, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return m.start()
    return len(text)


_BRACES = re.compile(r"\\.|[{}]", re.S)


def definitions(text: str) -> tuple[dict[str, tuple[int, str]], list[tuple[int, int]]]:
    """Own macros of a text, name to (number of arguments, meaning), and the spans that define them."""
    macros: dict[str, tuple[int, str]] = {}
    spans = []
    for m in _DEFINITION.finditer(text):
        if spans and m.start() < spans[-1][1]:
            continue
        end = closing(text, m.end())
        name = m.group(1) or m.group(3) or m.group(5)
        arity = int(m.group(2) or 0) if m.group(1) else len(m.group(4) or "") // 2
        macros[name] = (arity, text[m.end() : end])
        spans.append((m.start(), min(len(text), end + 1)))
    return macros, spans
