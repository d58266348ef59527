"""Blanking comments and strings without changing the length of a text.

A text is cut into comment, string and code tokens by one regular expression per language family; the tokens to
hide become spaces (line ends stay) and the pieces are joined again. Everything is a builtin, so the work stays
in the JVM and row-local.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.rules import C_LIKE
from .sqltext import any_of, contains_any, in_list, quote


def _string(quote: str) -> str:
    """A one-line string: a backslash hides the next character, a line end closes it."""
    return rf"{quote}(?:\\(?s:.)|[^{quote}\\\n])*+(?:{quote}|\\?\z|(?=\n))"


_TRIPLE = r'"""(?s:.*?)(?:"""|\z)' + "|" + r"'''(?s:.*?)(?:'''|\z)"
_HASH = r"#[^\n]*+"


@dataclass(frozen=True)
class Family:
    """How one group of languages marks comments and strings."""

    languages: tuple[str | None, ...]
    comment: str
    strings: str
    code: str
    openers: tuple[str, ...]
    quotes: tuple[str, ...] = ('"', "'")

    @property
    def token(self) -> str:
        return "|".join(p for p in (self.comment, self.strings, self.code) if p)


_PLAIN = "|".join(map(_string, ('"', "'")))
_TICKED = "|".join(map(_string, ('"', "'", "`")))

FAMILIES = (
    Family(C_LIKE, r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", _TICKED, r"[^\"'`/]++|/", ("//", "/*"), ('"', "'", "`")),
    Family(("python",), _HASH, f"{_TRIPLE}|{_PLAIN}", r"[^\"'#]++", ("#",)),
    Family(("ruby",), _HASH, _TICKED, r"[^\"'`#]++", ("#",), ('"', "'", "`")),
    Family(("sql",), r"--[^\n]*+", _PLAIN, r"[^\"'\-]++|-", ("--",)),
    Family(("yaml", "dockerfile", None), _HASH, _PLAIN, r"[^\"'#]++", ("#",)),
    Family(("html", "css", "json", "toml", "ini"), "", _PLAIN, r"[^\"']++", ()),
)


def _hide(text: str, token: str, openers: tuple[str, ...]) -> str:
    """Blanks the tokens that begin with an opener. A text without any opener is returned as it is, which skips the
    tokenizer for many files."""
    opened = any_of(f"startswith(token, {quote(o)})" for o in openers)
    blank = f"regexp_replace(token, {quote('[^' + chr(92) + 'n]')}, ' ')"
    pieces = f"transform(regexp_extract_all({text}, {quote(token)}, 0), token -> IF({opened}, {blank}, token))"
    return f"IF({contains_any(text, openers)}, array_join({pieces}, ''), {text})"


def _scrub(text: str, language: str, hide_strings: bool) -> str:
    cases = []
    for family in FAMILIES:
        hidden = family.openers + (family.quotes if hide_strings else ())
        if hidden:
            member = in_list(language, [name for name in family.languages if name])
            if None in family.languages:
                member = f"({language} IS NULL OR {member})"
            cases.append(f"WHEN {member} THEN {_hide(text, family.token, hidden)}")
    return f"CASE {' '.join(cases)} ELSE {text} END"


def strip_comments_sql(text: str, language: str) -> str:
    """Comments become spaces; strings, line ends and the length stay."""
    return _scrub(text, language, hide_strings=False)


def mask_code_sql(text: str, language: str) -> str:
    """Comments and strings, quotes included, become spaces; line ends and the length stay."""
    return _scrub(text, language, hide_strings=True)


def strip_comments(text: str, language: str) -> Column:
    return F.expr(strip_comments_sql(text, language))


def mask_code(text: str, language: str) -> Column:
    return F.expr(mask_code_sql(text, language))
