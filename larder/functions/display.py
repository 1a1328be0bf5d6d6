"""Labels and sentences shown next to rows. All times are parameters, never the clock."""

from __future__ import annotations

import unicodedata

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import js_round, let, trim

# Labels, glyphs and phrases.
PLATFORM_LABEL = {
    "instagram": "Instagram", "tiktok": "TikTok", "youtube": "YouTube", "web": "Web",
    "manual": "By hand",
}
PLATFORM_GLYPH = {
    "instagram": "\U0001F4F7", "tiktok": "\U0001F3B5", "youtube": "▶️",
    "web": "\U0001F310", "manual": "✍️",
}
TIER_PHRASE = {
    "tier0:json-ld": "read straight from the page's recipe data",
    "tier1:instagram-embed": "read from the Instagram caption",
    "tier1:tiktok-oembed": "read from the TikTok caption",
    "tier1:youtube": "read from the YouTube description",
    "tier1:website": "read from the page text",
    "tier1:supplied-text": "read from text you pasted",
}
PALETTE = (
    "#b4472a", "#8a5a2b", "#4f6d3a", "#2f6b6b", "#7a3f63", "#9b6a1f", "#3f5a86", "#7c4a2d",
)
STATUS_TEXT = {
    "pending": "Queued…", "done": "Done.", "not_recipe": "That didn't look like a recipe.",
    "failed": "That import didn't work.",
}
STAGE_TEXT = {
    "fetching": "Fetching the caption…", "transcribing": "Listening to the audio…",
    "structuring": "Writing it up…",
}
STAGE_PROGRESS = {"fetching": 0.3, "transcribing": 0.6, "structuring": 0.85}
STATUS_GLYPH = {"done": "✅", "failed": "⚠️", "not_recipe": "\U0001F914"}
TERMINAL = ("done", "failed", "not_recipe")
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def minutes_label(total: Column) -> Column:
    mins = js_round(total).cast("long")
    h, m = F.floor(mins / F.lit(60)).cast("string"), F.pmod(mins, F.lit(60))
    return (
        F.when(~(total > 0), F.lit(None).cast("string"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min")))
        .when(m == 0, F.concat(h, F.lit(" h")))
        .otherwise(F.concat(h, F.lit(" h "), m.cast("string"))))


def meta_line(total: Column, servings: Column, author: Column, platform: Column,
              compact: bool = False) -> Column:
    """Time, servings and author joined by dots; missing parts leave no gap."""
    a = F.nullif(trim(author), F.lit(""))
    handle = F.when(F.startswith(a, F.lit("@")), a).otherwise(F.concat(F.lit("@"), a))
    parts = [
        F.concat(F.lit("⏱️ "), minutes_label(total)),
        F.concat(F.lit("\U0001F37D️ "), F.nullif(trim(servings), F.lit(""))),
    ]
    if not compact:
        glyph = F.coalesce(_lookup(PLATFORM_GLYPH, platform), F.lit(""))
        parts.append(trim(F.concat(glyph, F.lit(" "), handle)))
    return F.concat_ws(" · ", *parts)


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def counts_line(ingredients: Column, steps: Column) -> Column:
    return F.concat(_plural(F.size(ingredients), "ingredient"), F.lit(" · "), _plural(F.size(steps), "step"))


def platform_label(platform: Column) -> Column:
    return _lookup(PLATFORM_LABEL, platform)


def describe_extraction(extraction: Column) -> Column:
    """Provenance in words: where the text came from, who structured it, how sure."""
    tiers = extraction["tiers"]
    phrase = F.get(F.filter(F.transform(tiers, lambda t: _lookup(TIER_PHRASE, t)),
                            lambda p: p.isNotNull()), F.lit(0))
    source = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 1 << 30))
    heard = F.when(F.exists(tiers, lambda t: F.startswith(t, F.lit("tier2:"))), F.lit("plus the spoken audio"))
    model = F.concat(F.lit("structured by "), F.nullif(extraction["model"], F.lit("")))
    sure = F.concat(js_round(extraction["confidence"] * 100).cast("string"), F.lit("% confident"))
    line = F.concat_ws(", ", source, heard, model)
    return F.when(extraction.isNull(), F.lit("")).otherwise(
        F.concat(F.when(line == "", "").otherwise(F.concat(line, F.lit(" · "))), sure))


def relative_time(at: Column, now: Column) -> Column:
    """Age bucket of a moment; older than 29 days gives the date."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))

    def bucket(ms: Column) -> Column:
        n = lambda unit: F.floor(ms / F.lit(unit)).cast("string")
        days = F.floor(ms / F.lit(86_400_000))
        return (
            F.when(ms < 60_000, "just now")
            .when(ms < 3_600_000, F.concat(n(60_000), F.lit(" min ago")))
            .when(ms < 86_400_000, F.concat(n(3_600_000), F.lit("h ago")))
            .when(days == 1, "yesterday")
            .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
            .otherwise(F.date_format(at, "d MMM yyyy")))

    return F.coalesce(let(F.floor(micros / F.lit(1000)), bucket), F.lit(""))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of the text, as a BIGINT."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.regexp_extract_all(digits, F.lit("...."), F.lit(0)), lambda unit: F.conv(
        unit, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (
        h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def monogram_color(seed: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in PALETTE]), (fnv1a(seed) % len(PALETTE)).cast("int"))


def _folded() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    bare = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))}
    pairs = [(c, b) for c, b in bare.items() if b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def monogram_initials(title: Column) -> Column:
    """Up to two letters; accents are folded, combined or not."""
    plain = F.translate(F.regexp_replace(title, r"[\x{0300}-\x{036F}]+", ""), *_folded())
    words = F.filter(F.split(plain, "[^A-Za-z0-9]+"), lambda w: w != "")

    def initials(w: Column) -> Column:
        first = F.get(w, F.lit(0))
        return (
            F.when(F.size(w) == 0, "?").when(F.size(w) == 1, F.upper(F.substring(first, 1, 2)))
            .otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(F.get(w, F.lit(1)), 1, 1)))))

    return let(words, initials)


def stage_message(status: Column, stage: Column) -> Column:
    return F.coalesce(_lookup(STATUS_TEXT, status), _lookup(STAGE_TEXT, stage), F.lit("Working on it…"))


def stage_progress(status: Column, stage: Column) -> Column:
    return F.when(status == "done", 1.0).when(status == "pending", 0.08).otherwise(
        F.coalesce(_lookup(STAGE_PROGRESS, stage), F.lit(0.18)))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def can_retry_with_text(status: Column) -> Column:
    return status.isin("failed", "not_recipe")


def poll_decision(status: Column, recipe_id: Column) -> Column:
    return (
        F.when(status.isin("pending", "running"), "keep-polling")
        .when((status == "done") & recipe_id.isNotNull(), "done")
        .when(can_retry_with_text(status), "retry-with-text")
        .otherwise("failed"))


def status_glyph(status: Column) -> Column:
    return F.coalesce(_lookup(STATUS_GLYPH, status), F.lit("⏳"))


def cooked_line(count: Column, relative: Column) -> Column:
    when = F.nullif(trim(relative), F.lit(""))
    base = F.concat(F.lit("Cooked "), count.cast("string"), F.lit("×"))
    return F.when(count <= 0, "Not cooked yet").otherwise(
        F.concat(base, F.coalesce(F.concat(F.lit(" · last "), when), F.lit(""))))


def folder_label(name: Column, emoji: Column) -> Column:
    return F.when(F.coalesce(emoji, F.lit("")) == "", name).otherwise(F.concat(emoji, F.lit(" "), name))
