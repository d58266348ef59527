"""Literal text that every match of a pattern holds, and one search for many literals at once."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as codes
from re import _parser as parser


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-cased ASCII literals of which every match of ``pattern`` holds at least one in its lower-cased form; none if
    nothing is certain.

    Of a sequence, the part with the longest shortest literal counts; of alternatives, each must have one.
    """
    return tuple(sorted(set(_best(parser.parse(pattern)))))


def _best(items) -> list[str]:
    found: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append([run.lower()])
        run = ""

    for op, value in items:
        if op is codes.LITERAL and value < 128:
            run += chr(value)
            continue
        close()
        if op is codes.SUBPATTERN:
            found.append(_best(value[3]))
        elif op is codes.ATOMIC_GROUP:
            found.append(_best(value))
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_best(value[2]))
        elif op is codes.BRANCH:
            sides = [_best(side) for side in value[1]]
            found.append([w for side in sides for w in side] if all(sides) else [])
    close()
    return max(found, key=lambda words: min(map(len, words), default=0), default=[])


def any_literal(words: Iterable[str]) -> str:
    """A pattern for any of the words, the longest at its place, shaped like their prefix tree: a text that fits none is left
    after its first characters, however many words there are."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def shape(node: dict) -> str:
        parts = []
        for c, below in sorted(node.items()):
            text = c
            while len(below) == 1 and "" not in below:  # one way on
                (c, below), = below.items()
                text += c
            if text:
                parts.append(re.escape(text) + (shape(below) if set(below) - {""} else ""))
        whole = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return f"{whole}?" if "" in node else whole

    return shape(root)


def first_characters(words: Iterable[str]) -> str:
    """A class of the words' first characters."""
    return "[" + "".join(re.escape(c) for c in sorted({w[0] for w in words})) + "]"
