r"""Lines, whitespace and regular expressions with the scanned languages' own conventions.

Source text is cut at every Unicode line boundary, and "whitespace" includes the four ASCII separators, which
Java's ``\s`` leaves out. The helpers below say so once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import contains_any, quote

# Line boundaries and whitespace of the scanned text.
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
RARE_LINE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_LINE_END = rf"\r\n|[{LINE_BREAKS}]"


def plain_line_ends_sql(text: str) -> str:
    """True when lines end in ``\\n`` only. Substring searches are many times cheaper than a character class."""
    return f"(NOT {contains_any(text, RARE_LINE_BREAKS)})"


def split_lines_sql(text: str, plain: str | None = None) -> str:
    """The lines of a text without their ends; no empty line after a final line end, none for an empty text.

    ``plain`` is a condition under which the text has no line end but ``\\n``; by default the text is searched.
    """
    plain = plain or plain_line_ends_sql(text)
    # The outer transform only gives the array a name.
    return (
        f"transform(array(IF({plain}, split({text}, '\\n'), split({text}, {quote(_LINE_END)}))), "
        "cut -> IF(element_at(cut, -1) = '', slice(cut, 1, size(cut) - 1), cut))[0]"
    )


def strip_sql(value: str) -> str:
    return f"trim(BOTH {quote(WHITESPACE)} FROM {value})"


def count_nonblank_sql(lines: str) -> str:
    return f"size(filter({lines}, l -> trim(LEADING {quote(WHITESPACE)} FROM l) <> ''))"


def universal_newlines_sql(text: str) -> str:
    r"""``\r\n`` and lone ``\r`` become ``\n``, as when a file is opened in text mode."""
    return (
        f"CASE WHEN contains({text}, '\\r') THEN regexp_replace({text}, {quote(r'\r\n?')}, '\\n') ELSE {text} END"
    )


_TOKEN = re.compile(
    r"\\U[0-9a-fA-F]{8}|\\[1-9][0-9]?|\\.|\(\?P<\w+>|\(\?P=\w+\)|\(\?\(|\{,(?=[0-9]+\})|\{[0-9]+(?:,[0-9]*)?\}|.", re.S
)
_ESCAPES = {r"\s": r"[\s\x1f]", r"\S": r"[^\s\x1f]", r"\Z": r"\z"}
_CLASS_ESCAPES = {r"\s": r"\s\x1f", r"\b": r"\x08"}


def translate_regex(pattern: str, groups_before: int = 0) -> str:
    r"""A pattern in Java's dialect, token by token: back-references, named groups, literal braces, ``[`` and ``&`` in
    classes, and ``\s`` with the unit separator. References count ``groups_before`` groups put in front.

    Raises ``ValueError`` for a pattern that is wrong in its own dialect or has no counterpart.
    """
    try:
        numbers = re.compile(pattern).groupindex
    except re.error as exc:
        raise ValueError(f"wrong pattern {pattern!r}: {exc}") from exc
    out, opened = [], None
    for at, token in ((m.start(), m[0]) for m in _TOKEN.finditer(pattern)):
        if token.startswith("\\U"):
            out.append(rf"\x{{{token[2:]}}}")
        elif opened is not None:
            first = at == opened + 1 or (at == opened + 2 and pattern[opened + 1] == "^")
            if token == "]" and not first:
                opened = None
                out.append(token)
            elif token in ("[", "&") or token == "]":
                out.append("\\" + token)
            else:
                out.append(_CLASS_ESCAPES.get(token, token))
        elif token == "[":
            opened = at
            out.append(token)
        elif token[0] == "\\":
            out.append(rf"(?:\{int(token[1:]) + groups_before})" if token[1] in "123456789" else _ESCAPES.get(token, token))
        elif token.startswith("(?P<"):
            out.append("(")
        elif token.startswith("(?P="):
            out.append(rf"(?:\{numbers[token[4:-1]] + groups_before})")
        elif token == "(?(":
            raise ValueError(f"conditional groups have no counterpart: {pattern!r}")
        else:
            out.append({"{,": "{0,", "{": r"\{"}.get(token, token))
    return "".join(out)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A rule pattern for ``RLIKE``, with Unicode classes as in the rule's dialect."""
    return ("(?iU)" if ignore_case else "(?U)") + translate_regex(pattern)


def code_point_column_sql(line: str, pattern: str, ignore_case: bool = False) -> str:
    """1-based column of the first match in code points (``regexp_instr`` counts UTF-16 units)."""
    flags = "(?iUs)" if ignore_case else "(?Us)"
    return f"length(regexp_extract({line}, {quote(rf'{flags}\A(.*?)(?:{translate_regex(pattern, 1)})')}, 1)) + 1"


def skipping_column_sql(line: str, pattern: str, ignore_case: bool = False) -> str:
    """1-based column of the first match in code points, for a pattern whose groups take the text before the start."""
    found = quote(java_regex(pattern, ignore_case))
    skipped = " + ".join(
        f"length(regexp_extract({line}, {found}, {i}))" for i in range(1, re.compile(pattern).groups + 1)
    )
    return f"length(split({line}, {found}, 2)[0]) + {skipped} + 1"


def split_lines(text: str) -> Column:
    return F.expr(split_lines_sql(text))


def strip(value: str) -> Column:
    return F.expr(strip_sql(value))


def count_code_lines(text: str) -> Column:
    """Number of non-blank lines, comments included."""
    return F.expr(count_nonblank_sql(split_lines_sql(text)))
