"""Page and caption corpus: readable text, quality gate, routing, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import html as H
from larder.functions import scoring as S
from larder.functions.text import non_blank, normalise_text
from larder.operators.keyed import pin

# Thresholds of the gates.
MIN_WEB_CHARS = 80
MIN_VIDEO_CHARS = 40
MIN_TRANSCRIPT_CHARS = 80
MAX_AUDIO_SECONDS = 300
VIDEO_PLATFORMS = ("instagram", "tiktok", "youtube")
TIER3_PREFIX = "tier3:gemini:"
TIER2_PREFIX = "tier2:gemini-audio:"
TRANSCRIPT_MARK = "--- transcript ---"


def page_texts(pages: DataFrame, html: str = "html", scan_chars: int | None = None) -> DataFrame:
    """Pages with title and readable body; whole pages unless ``scan_chars`` bounds them."""
    c = F.col(html)
    return pin(pages.withColumns({
        "title": H.page_title(c), "body": H.html_to_text(c, scan_chars)}))


def web_texts(pages: DataFrame, html: str = "html", scan_chars: int | None = None,
              body_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable pages, rejects): heading and body joined, too little text rejected."""
    c = F.col(html)
    body = H.html_to_text(c, scan_chars)
    if body_chars:
        body = F.substring(body, 1, body_chars)
    heading = F.concat_ws("\n", H.page_title(c), H.meta_content(c, "og:description"))
    text = normalise_text(F.concat(heading, F.lit("\n\n"), body))
    built = pin(pages.select(
        *[k for k in pages.columns if k != html], text.alias("text"),
        H.meta_content(c, "og:site_name").alias("author"),
        H.meta_content(c, "og:image").alias("thumbnail_url"),
        F.lit("tier1:web-text").alias("tier")))
    enough = F.char_length("text") >= MIN_WEB_CHARS
    return built.where(enough), built.where(~enough).withColumn(
        "reason", F.lit("no readable text"))


def scored(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with their recipe score and the gate, which compares the unrounded score."""
    raw = pin(rows.withColumn("_raw", S.raw_score(F.col(text))))
    return raw.withColumns({
        "score": S.round_score(F.col("_raw")), "is_recipe": S.is_recipe(F.col("_raw")),
    }).drop("_raw")


def recipes_only(rows: DataFrame, text: str = "text") -> DataFrame:
    return scored(rows, text).where("is_recipe")


def distinct_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with consecutive repeated lines removed after cleaning.

    A document is one row, so its lines are compared inside the row.
    """
    from larder.functions.text import clean_line
    from larder.sources.tables import drop_repeats

    lines = F.filter(F.transform(F.split(text, r"\r?\n"), clean_line), lambda l: l != "")
    return docs.withColumn("lines", drop_repeats(lines))


def route(rows: DataFrame, max_seconds: int = MAX_AUDIO_SECONDS, supplied: str | None = None) -> DataFrame:
    """Cheapest tier that can answer, with the trace of tiers tried.

    Only a duration known to be too long rules audio out; an unknown one does not.
    Text that a person ``supplied`` ends the chain: it is structured as it is.
    """
    if supplied:
        given = non_blank(F.col(supplied))
        pasted = rows.where(given.isNotNull()).withColumns({
            "text": normalise_text(F.col(supplied)), "tier": F.lit("tier3"), "tiers": F.array(F.lit("tier1:supplied-text"))})
        rest = route(rows.where(given.isNull()), max_seconds)
        return rest.unionByName(scored(pasted), allowMissingColumns=True)
    judged = scored(rows)
    audio = (
        F.col("platform").isin(*VIDEO_PLATFORMS) & ~F.col("is_recipe")
        & (F.col("duration_seconds").isNull() | (F.col("duration_seconds") <= max_seconds)))
    tier = (
        F.when(F.col("has_json_ld"), "tier0").when(audio, "tier2").otherwise("tier3"))
    first = F.when(F.col("has_json_ld"), "tier0:json-ld").when(
        F.col("platform") == "web", "tier1:web-text").otherwise(
        F.concat(F.lit("tier1:"), F.col("platform")))
    tiers = F.when(tier == "tier2", F.array(first, F.lit("tier2:audio"))).otherwise(F.array(first))
    return judged.withColumns({"tier": tier, "tiers": tiers})


def source_text(supplied: Column, stored: Column, fetched: Column) -> tuple[Column, Column]:
    """(text, label): pasted text beats stored text beats fetched text; blank counts as absent."""
    given = F.coalesce(non_blank(supplied), non_blank(stored))
    label = F.when(given.isNotNull(), "tier1:supplied-text")
    return F.coalesce(given, non_blank(fetched)), label


def first_source(rows: DataFrame, routes: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """First route with non-blank text wins and names the tier.

    ``routes`` lists (tier label, text column, author column, thumbnail column)
    in order. Rows where no route has text get ``reason``.
    """
    texts = [non_blank(F.col(t)) for _, t, _, _ in routes]
    tier = F.lit(None).cast("string")
    for (label, _, _, _), t in reversed(list(zip(routes, texts))):
        tier = F.when(t.isNotNull(), F.lit(label)).otherwise(tier)
    # Author and picture come from the winning route first, then from earlier ones.
    none = F.lit(None).cast("string")
    author = thumb = none
    for i in reversed(range(len(routes))):
        earlier = [routes[i], *reversed(routes[:i])]
        a = F.coalesce(none, *[F.col(r[2]) for r in earlier if r[2]])
        p = F.coalesce(none, *[F.col(r[3]) for r in earlier if r[3]])
        author = F.when(texts[i].isNotNull(), a).otherwise(author)
        thumb = F.when(texts[i].isNotNull(), p).otherwise(thumb)
    text = normalise_text(F.coalesce(*texts))
    return rows.withColumns({
        "tier": tier, "text": text, "source_author": author, "source_thumbnail": thumb,
        "reason": F.when(tier.isNull(), F.lit("no caption"))})


def embed_then_metadata(rows: DataFrame) -> DataFrame:
    """Photo-post chain: embed caption, else the description in the video metadata.

    Columns e_text, e_author, e_thumbnail and m_description, m_author, m_thumbnail.
    """
    return first_source(rows, [
        ("tier1:instagram-embed", "e_text", "e_author", "e_thumbnail"),
        ("tier1:instagram-ytdlp", "m_description", "m_author", "m_thumbnail")])


def oembed_then_metadata(rows: DataFrame) -> DataFrame:
    """Short-video chain: oEmbed caption, else description or title in the video metadata.

    Columns o_text, o_author, o_thumbnail and m_description, m_title, m_author, m_thumbnail.
    """
    spoken = rows.withColumn("_m_text", F.coalesce("m_description", "m_title"))
    return first_source(spoken, [
        ("tiktok-oembed", "o_text", "o_author", "o_thumbnail"),
        ("tiktok-ytdlp", "_m_text", "m_author", "m_thumbnail")]).drop("_m_text")


def caption_or_transcript(rows: DataFrame) -> DataFrame:
    """Video text: the description when it is a recipe, else with the transcript appended."""
    d = normalise_text(F.coalesce("description", F.lit("")))
    judged = scored(rows.withColumn("_d", d), "_d").drop("score")
    use = (~F.col("is_recipe")) & F.coalesce(
        F.char_length("transcript") > MIN_TRANSCRIPT_CHARS, F.lit(False))
    joined = normalise_text(F.concat(
        F.col("_d"), F.lit(f"\n\n{TRANSCRIPT_MARK}\n"), F.col("transcript")))
    picked = judged.withColumns({
        "_text": F.when(use, joined).otherwise(F.col("_d")),
        "tiers": F.when(use, F.array(F.lit("tier1:youtube-description"), F.lit("tier1:youtube-captions")))
        .otherwise(F.array(F.lit("tier1:youtube-description")))})
    return picked.withColumns({
        "readable": F.char_length("_text") >= MIN_VIDEO_CHARS,
        "text": normalise_text(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("_text"))),
    }).drop("_d", "_text", "is_recipe")


def extraction(tiers: Column, confidence: Column, text: Column, raw_chars: int | None = None) -> Column:
    """Provenance: the trace, the model named by its last structuring tier, the source text."""
    last = F.try_element_at(F.filter(tiers, lambda t: F.startswith(t, F.lit(TIER3_PREFIX))), F.lit(-1))
    kept = F.substring(text, 1, raw_chars) if raw_chars else text
    return F.struct(
        tiers.alias("tiers"), F.substring(last, len(TIER3_PREFIX) + 1, 1 << 30).alias("model"),
        confidence.alias("confidence"), kept.alias("raw_text"))


def split_outcomes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, not recipes with the sentence that says so)."""
    sentence = "That link doesn't look like a recipe — no ingredients or method in it."
    return parsed.where("is_recipe"), parsed.where(~F.col("is_recipe")).withColumn(
        "error", F.lit(sentence))
