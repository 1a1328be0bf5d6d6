"""Text expressions shared by every job.

Whitespace means the full Unicode set wherever the catalog's rules say
"whitespace"; Java's ``\\s`` is ASCII only, so the class is spelled out. Word
boundaries are ASCII and therefore written as look-arounds (Java's ``\\b`` is
Unicode-aware). Lengths are counted in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace code points, as the body of a character class.
_WS_NO_NL = (
    r"\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
_WS = r"\n" + _WS_NO_NL
# Printable ASCII is ruled out first: a class of many ranges is slow to test, and most text is in none of them.
_RARE = r"[\x00-\x20\x7F-\x{FFFF}]"
WS = f"[{_RARE}&&[{_WS}]]"
NOT_WS = f"[!-~[^{_WS}]]"
_WS_NOT_SPACE = rf"[[\x00-\x1F\x7F-\x{{FFFF}}]&&[{_WS}]]"
_BLANK = f"[{_RARE}&&[{_WS_NO_NL}]]"
# The same code points as one string, for the native trim functions.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ASCII word boundaries before / after a word character.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Expressions are trees: a value used k times by each of n steps would be
    written out k**n times, so steps that reuse their input bind it here.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """``let`` with the body given as SQL text over ``s``: parsed at once, where Python builds node by node."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"s -> {body}")), F.lit(0))


def trim(c: Column) -> Column:
    """Strip any Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def trim_sql(text: str) -> str:
    """``trim`` as SQL text."""
    return f"btrim({text}, '{WS_CHARS}')"


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Every whitespace run becomes one space; a single space is left as it is."""
    return F.regexp_replace(c, f" {WS}+|{_WS_NOT_SPACE}{WS}*", " ")


def clean_line(c: Column) -> Column:
    """Trim and collapse; the rule for typed-in single-line text."""
    return collapse(trim(c))


def non_blank(c: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def normalise_text(c: Column) -> Column:
    """Collapse layout noise but keep the line breaks that carry structure."""
    s = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    s = F.replace(s, F.lit("\u00a0"), F.lit(" "))
    s = F.regexp_replace(s, r" [ \t]+|\t[ \t]*", " ")
    # A run of blanks is tried from its first character only.
    s = F.regexp_replace(s, rf"{_BLANK}(?<!{_BLANK}{_BLANK}){_BLANK}*+(?=\n|\z)", "")
    return trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def cap(c: Column, limit: int) -> Column:
    """Schema ceiling: over-long values end in an ellipsis at exactly ``limit``."""
    def capped(s: Column) -> Column:
        cut = F.concat(trim_end(F.substring(s, 1, limit - 1)), F.lit("…"))
        return F.when(F.char_length(s) <= limit, s).otherwise(cut)

    return let(c, capped)


def js_round(c: Column) -> Column:
    """Round half toward positive infinity, as a DOUBLE."""
    return F.floor(c + F.lit(0.5))


def digest_name(content: Column, extension: str = "") -> Column:
    """Content address: first 20 hex digits of SHA-256, plus an extension."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 20), F.lit(extension))


def redact(c: Column, secrets: list[str]) -> Column:
    """Blank out every listed secret of eight characters or more, in list order."""
    for secret in secrets:
        if secret and len(secret) >= 8:
            c = F.replace(c, F.lit(secret), F.lit("***"))
    return c


def tag_list(c: Column) -> Column:
    """Comma-separated tags; the first spelling of each case-folded tag is kept."""
    def first_spellings(parts: Column) -> Column:
        return let(F.transform(parts, F.lower), lambda keys: F.filter(
            parts, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1))

    return let(
        F.filter(F.transform(F.split(c, ","), trim), lambda t: t != ""), first_spellings)


def step_list(c: Column) -> Column:
    """A pasted block of steps: one per non-empty line, list markers removed."""
    lines = F.split(c, r"\r?\n")
    marker = rf"^{WS}*(?:\d+[.)]{WS}*|[-*•]{WS}*)"
    steps = F.transform(lines, lambda l: trim(F.regexp_replace(l, marker, "")))
    return F.filter(steps, lambda l: l != "")


def first_glyph(c: Column) -> Column:
    """First emoji of a typed value, with the modifiers and joined parts that belong to it."""
    mod = r"\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}\x{20D0}-\x{20FF}"
    glyph = F.regexp_extract(trim(c), rf"(?s)^.(?:[{mod}]|(?<=\x{{200D}}).)*", 0)
    return F.nullif(glyph, F.lit(""))


def first_line(c: Column, limit: int = 160) -> Column:
    return F.substring(trim(F.substring_index(c, "\n", 1)), 1, limit)
