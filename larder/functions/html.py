"""Markup to text, entities, page metadata.

Each pattern below consumes what it scans, so a page costs time linear in its
length however broken it is: a lazy search for a closer either has one ahead of
it or ends the match at the end of the text, and tag patterns only ever run on
the part of the text that still has a ``>`` in front of it.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import WORD_END, collapse, let, let_sql, normalise_text, trim

# Named character references that are decoded.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘",
    "ldquo": "“", "rdquo": "”", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "ouml": "ö", "uuml": "ü", "auml": "ä", "deg": "°",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "middot": "·", "bull": "•",
    "copy": "©", "reg": "®", "trade": "™", "times": "×",
}
# Elements whose content is never readable text.
DROPPED_TAGS = (
    "script", "style", "noscript", "svg", "iframe", "template", "form", "nav",
    "footer", "header", "aside",
)
# Closing tags that end a line.
BLOCK_CLOSERS = r"(?i)</(?:p|div|li|tr|h[1-6]|section|article|ul|ol|blockquote)\s*>"

_SENTINEL = "\ue000"


# A reference is looked for only where it is whole: text is cut in front of nothing else.
_HEX, _DECIMAL = r"&#[xX][0-9a-fA-F]+;", r"&#\d+;"
# In front of the first piece of a text, so that every other one begins with a reference.
_START = "\ue001"


def _utf8(n: str) -> str:
    """Code point number to its character, put together as UTF-8 bytes; those that do not exist and surrogates give ''."""
    def joined(lead: int, shifts: tuple[int, ...]) -> str:
        first = f"(shiftright({n}, {6 * len(shifts)}) | {lead})"
        for i, s in enumerate(shifts):
            first = f"(shiftleft({first}, 8) | (shiftright({n}, {s}) & 63 | 128))"
        return first

    number = (f"CASE WHEN {n} < 128 THEN {n} WHEN {n} < 2048 THEN {joined(0xC0, (0,))} WHEN {n} BETWEEN 55296 AND 57343 THEN NULL "
              f"WHEN {n} < 65536 THEN {joined(0xE0, (6, 0))} WHEN {n} <= 1114111 THEN {joined(0xF0, (12, 6, 0))} END")
    return f"coalesce(CAST(unhex(hex({number})) AS STRING), '')"


def _numeric(s: str, reference: str, digits_at: int, value) -> str:
    """Replace numeric references in one pass over the pieces that begin with one."""
    code = value(f"substring(p, {digits_at}, instr(p, ';') - {digits_at})")
    joined = (f"array_join(transform(split(concat('{_START}', {s}), r'(?={reference})'), (p, i) -> CASE WHEN i = 0 THEN p ELSE "
              f"concat(get(transform(array({code}), n -> {_utf8('n')}), 0), substring(p, instr(p, ';') + 1)) END), '')")
    return f"CASE WHEN regexp_like({s}, r'{reference}') THEN substring({joined}, 2) ELSE {s} END"


# Numbers that no long holds are out of range as well.
_FAR = 1 << 40


def _of_hex(digits: str) -> str:
    return f"coalesce(try_cast(conv({digits}, 16, 10) AS BIGINT), {_FAR})"


def _of_decimal(digits: str) -> str:
    return f"coalesce(try_cast({digits} AS BIGINT), {_FAR})"


def _decoding() -> str:
    numbers = (f"get(transform(array({_numeric('s', _HEX, 4, _of_hex)}), t -> {_numeric('t', _DECIMAL, 3, _of_decimal)}), 0)")
    names = "|".join(n for n in NAMED_ENTITIES if n != "amp")
    quoted = ["'" + x.replace("'", "\\'") + "'" for x in chain.from_iterable(NAMED_ENTITIES.items())]
    # What a reference stands for never makes another one, but for an ampersand: those come last.
    met = f"array_distinct(transform(regexp_extract_all(u, r'(?i)&({names});', 1), n -> lower(n)))"
    named = (f"regexp_replace(aggregate({met}, u, (t, n) -> regexp_replace(t, concat('(?i)&', n, ';'), "
             f"element_at(map({', '.join(quoted)}), n))), '(?i)&amp;', '&')")
    return (f"CASE WHEN contains(s, '&') THEN get(transform(array(CASE WHEN contains(s, '&#') THEN {numbers} ELSE s END), "
            f"u -> {named}), 0) ELSE s END")


_DECODING = _decoding()


def decode_entities(c: Column) -> Column:
    """Hexadecimal, then decimal, then named references; unknown names stay."""
    return let_sql(c, _DECODING)


def _before_last(c: Column, closer: str, rewrite) -> Column:
    """Rewrite the text up to and including the last ``closer``; keep what follows it."""

    def parts(s: Column) -> Column:
        rewritten = let(F.substring_index(s, closer, -1), lambda tail: F.concat(
            rewrite(F.substring(s, F.lit(1), F.char_length(s) - F.char_length(tail))), tail))
        return F.when(F.contains(s, F.lit(closer)), rewritten).otherwise(s)

    return let(c, parts)


def _up_to(s: Column, pattern: str, rewrite) -> Column:
    """Rewrite what a pattern that starts at the beginning finds; keep what follows it."""
    return let(F.regexp_extract(s, pattern, 0), lambda head: F.concat(
        rewrite(head), F.substring(s, F.char_length(head) + 1, F.char_length(s))))


def drop_non_text(c: Column) -> Column:
    """Remove non-text elements whole; an unclosed one swallows the rest."""
    per_tag = "|".join(
        rf"{t}{WORD_END}[^>]*>.*?(?:</{t}[^>]*(?:>|\z)|\z)" for t in DROPPED_TAGS
    )

    def parts(s: Column) -> Column:
        return let(F.substring_index(s, ">", -1), lambda tail: let(
            F.substring(s, F.lit(1), F.char_length(s) - F.char_length(tail)),
            lambda head: joined(head, tail)))

    def joined(head: Column, tail: Column) -> Column:
        # The mark survives unless an unclosed element swallowed everything after it.
        marked = F.concat(head, F.lit(_SENTINEL))
        return let(F.regexp_replace(marked, f"(?is)<(?:{per_tag})", " "), lambda kept: F.when(
            F.endswith(kept, F.lit(_SENTINEL)),
            F.concat(F.substring(kept, F.lit(1), F.char_length(kept) - 1), tail),
        ).otherwise(kept))

    return let(c, parts)


def strip_comments(c: Column) -> Column:
    return _before_last(c, "-->", lambda s: F.regexp_replace(s, r"(?s)<!--.*?-->", " "))


def strip_tags(c: Column, replacement: str = " ") -> Column:
    return _before_last(c, ">", lambda s: F.regexp_replace(s, r"<[^>]+>", replacement))


def html_to_text(c: Column, scan_chars: int | None = None) -> Column:
    """Readable text of a page. ``scan_chars`` optionally bounds the markup read."""
    if scan_chars:
        c = F.substring(c, 1, scan_chars)
    s = strip_comments(drop_non_text(c))
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, BLOCK_CLOSERS, "\n")
    s = _before_last(s, ">", lambda t: F.regexp_replace(
        F.regexp_replace(t, rf"(?i)<li{WORD_END}[^>]*>", "\n- "), r"<[^>]+>", " "))
    return normalise_text(F.regexp_replace(decode_entities(s), r"[ \t]{2,}", " "))


def page_title(c: Column) -> Column:
    """Content of the first title element.

    Only the text in front of the last closer is looked at, and an opening tag
    only counts where a ``>`` still follows: the first attempt is then the match.
    """
    head = F.regexp_extract(c, r"(?is)\A(.*)</title>", 1)

    def content(s: Column) -> Column:
        closed = F.substring(s, F.lit(1), F.char_length(s) - F.char_length(F.substring_index(s, ">", -1)))
        found = F.regexp_extract(
            F.concat(s, F.lit("</title>")), r"(?is)<title[^>]*+>(.*?)</title>", 1)
        return F.when(F.regexp_like(closed, F.lit("(?i)<title")), found).otherwise(F.lit(""))

    return trim(collapse(decode_entities(F.nullif(let(head, content), F.lit("")))))


def meta_content(c: Column, prop: str) -> Column:
    """Quoted ``content`` of the first meta tag with this property or name.

    Tags are taken out whole first, each in one attempt, and tested apart.
    """
    named = rf"""(?i)\A<meta[^>]+(?:property|name)\s*=\s*["']{prop}["']"""

    def first(tags: Column) -> Column:
        return F.get(F.filter(tags, lambda t: F.regexp_like(t, F.lit(named))), F.lit(0))

    tag = F.coalesce(first(F.regexp_extract_all(c, F.lit(r"(?i)<meta[^>]++(?:>|\z)"), F.lit(0))), F.lit(""))

    def value(t: Column) -> Column:
        closed = F.when(F.endswith(t, F.lit(">")), t).otherwise(F.lit(""))
        return F.regexp_extract(closed, r"""(?i)content\s*=\s*["']([^"']*)["']""", 1)

    return trim(decode_entities(F.nullif(let(tag, value), F.lit(""))))


def json_ld_blocks(c: Column) -> Column:
    """Bodies of every ld+json script, CDATA wrappers removed, blanks dropped."""
    # A tag that is no ld+json script is passed over whole; behind the last closer nothing can match.
    closed = F.regexp_extract(c, r"(?is)\A.*</script>", 0)
    found = F.filter(F.regexp_extract_all(
        closed,
        F.lit(r"""(?is)<script(?:[^>]*?type\s*=\s*["']?application/ld\+json["']?[^>]*+>(.*?)</script>|[^>]*+>)"""),
        F.lit(1),
    ), lambda b: b.isNotNull())

    def unwrap(block: Column) -> Column:
        block = F.regexp_replace(block, r"^\s*<!\[CDATA\[", "")
        return trim(F.regexp_replace(block, r"\]\]>\s*\z", ""))

    return F.filter(F.transform(found, unwrap), lambda b: b != "")


def embed_caption(c: Column) -> Column:
    """Caption text inside embed markup, or NULL when the marker is missing."""
    after = F.regexp_extract(c, r'(?s)<div class="Caption"[\s>].*', 0)
    inner = F.substring_index(after, '<div class="CaptionComments"', 1)
    inner = let(inner, lambda s: _up_to(s, r"(?is)\A.*</a>", lambda t: F.regexp_replace(
        t, r'(?is)\A(.*?)<a class="CaptionUsername".*?</a>', "$1")))
    s = F.regexp_replace(inner, r"(?i)<br\s*/?>", "\n")
    s = strip_tags(F.regexp_replace(s, r"(?i)</(?:p|div)\s*>", "\n"), "")
    s = normalise_text(decode_entities(s))
    s = trim(F.regexp_replace(s, r"(?im)^\s*View all \d+ comments\s*$", ""))
    return F.nullif(s, F.lit(""))


def embed_author(c: Column) -> Column:
    name = F.regexp_extract(c, r'(?i)<span class="UsernameText">([^<]+)</span>', 1)
    links = F.regexp_extract_all(c, F.lit(
        r'(?i)<a class="CaptionUsername"(?:[^>]*+>([^<]++)</a>|[^>]*+(?:>|\z))'), F.lit(1))
    link = F.coalesce(F.get(F.filter(links, lambda t: t != ""), F.lit(0)), F.lit(""))
    return trim(decode_entities(F.coalesce(F.nullif(name, F.lit("")), F.nullif(link, F.lit("")))))


def embed_thumbnail(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(
        r'(?i)<img(?:(?>[^>]+?class="EmbeddedMediaImage")[^>]+src="([^"]++)"|[^>]*+(?:>|\z))'), F.lit(1))
    src = F.get(F.filter(found, lambda t: t != ""), F.lit(0))
    return decode_entities(src)
