"""Table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas
from larder.functions import html as H
from larder.functions.text import non_blank, normalise_text


# Tasks a core that rows are dealt over, so that dear rows in one of them hold up little.
TASKS_PER_CORE = 4
# Dear rows a task gets at most: Python functions keep the rows of a task beside them, on disk beyond a memory page.
ROWS_DEALT = 10_000


def read_table(spark: SparkSession, folder: str, name: str, deal: bool = False) -> DataFrame:
    """One Parquet table of a data folder, file or folder of part files.

    Read as it lies, unless the session asks to deal rows out first
    (``larder.read.partitions``): a file of one row group is one task. With ``deal``
    they always are, over a few tasks for each core and for each split of the files,
    more if a task would get over ``ROWS_DEALT``: for rows that cost far more to work on than to send.
    """
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    dealt = spark.conf.get("larder.read.partitions", None)
    if dealt:
        return rows.repartition(int(dealt))
    if deal:
        tasks = TASKS_PER_CORE * max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        return rows.repartition(max(tasks, -(-rows.count() // ROWS_DEALT)))
    return rows


def json_or(text: Column, schema: str, fallback: Column) -> Column:
    """Parsed JSON text; empty, malformed or JSON ``null`` text gives the fallback."""
    return F.coalesce(F.from_json(text, schema), fallback)


def decode_nested(rows: DataFrame) -> DataFrame:
    """Decode the JSON text columns; a malformed value never fails the scan."""
    empty = F.array()
    return rows.withColumns({
        "ingredients": json_or(
            F.col("ingredients"), schemas.INGREDIENTS, empty.cast(schemas.INGREDIENTS)),
        "steps": json_or(F.col("steps"), "ARRAY<STRING>", empty.cast("ARRAY<STRING>")),
        "tags": json_or(F.col("tags"), "ARRAY<STRING>", empty.cast("ARRAY<STRING>")),
        "extraction": F.from_json("extraction", schemas.EXTRACTION),
    })


def scan_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Page corpus with its size; ``max_bytes`` marks pages a size policy would cut.

    The text itself is kept whole: cutting is left to the consumer.
    """
    size = F.octet_length("html")
    over = F.lit(False) if max_bytes is None else size > max_bytes
    return pages.select("*", size.cast("long").alias("html_bytes"), over.alias("over_cap"))


def scan_embeds(rows: DataFrame, html: str = "html") -> DataFrame:
    """Caption, author and thumbnail of embed markup; no marker means no caption."""
    c = F.col(html)
    return rows.withColumns({
        "caption": H.embed_caption(c),
        "author": H.embed_author(c),
        "thumbnail_url": H.embed_thumbnail(c),
    }).drop(html)


def scan_oembed(rows: DataFrame, value: str = "value") -> DataFrame:
    """oEmbed records; a value that is not JSON gives NULL fields."""
    o = F.from_json(value, schemas.OEMBED)
    return rows.withColumn("_o", o).withColumns({
        "caption": non_blank(F.col("_o.title")),
        "author": non_blank(F.col("_o.author_name")),
        "thumbnail_url": F.col("_o.thumbnail_url"),
    }).drop("_o", value)


def _caption_url(meta: Column) -> Column:
    """VTT track of the first English language key; human subtitles win a key clash."""
    auto, human = meta["automatic_captions"], meta["subtitles"]
    none = F.array().cast("ARRAY<STRING>")
    auto_keys = F.coalesce(F.map_keys(auto), none)
    human_keys = F.coalesce(F.map_keys(human), none)
    keys = F.array_distinct(F.concat(auto_keys, human_keys))
    english = F.filter(keys, lambda k: (k == "en") | F.startswith(k, F.lit("en-")))
    key = F.try_element_at(english, F.lit(1))
    tracks = F.coalesce(F.try_element_at(human, key), F.try_element_at(auto, key))
    return F.try_element_at(F.filter(tracks, lambda t: t["ext"] == "vtt"), F.lit(1))["url"]


def scan_video_meta(rows: DataFrame, value: str = "value") -> DataFrame:
    """Video metadata records with the caption track to read."""
    parsed = rows.withColumn("_m", F.from_json(value, schemas.VIDEO_META))
    m = F.col("_m")
    return parsed.withColumns({
        "title": m["title"],
        "description": m["description"],
        "author": F.coalesce(m["uploader"], m["channel"]),
        "thumbnail_url": m["thumbnail"],
        "duration_seconds": F.floor(m["duration"] + F.lit(0.5)).try_cast("int"),
        "webpage_url": m["webpage_url"],
        "caption_url": _caption_url(m),
    }).drop("_m", value)


# Transcript lines that carry no speech.
VTT_HEADERS = r"^(?:NOTE|STYLE|REGION|Kind:|Language:)"


def vtt_text(value: Column) -> Column:
    """Spoken text of a WebVTT transcript, rolling-window repeats removed.

    The repeats are looked for among the kept lines of one transcript, so the
    whole job stays inside the row.
    """
    from larder.functions.text import clean_line, trim

    raw = F.transform(F.split(value, r"\r?\n"), trim)
    kept = F.filter(raw, lambda l: (
        (l != "") & (l != "WEBVTT") & ~F.regexp_like(l, F.lit(VTT_HEADERS))
        & ~F.regexp_like(l, F.lit(r"^\d+\z")) & ~F.contains(l, F.lit("-->"))))
    plain = F.transform(kept, lambda l: clean_line(F.regexp_replace(l, r"<[^>]+>", "")))
    return normalise_text(F.array_join(drop_repeats(F.filter(plain, lambda l: l != "")), " "))


def drop_repeats(lines: Column) -> Column:
    """Array without nulls and elements equal to their left neighbour; the array is computed once."""
    from larder.functions.text import let

    return let(lines, lambda ls: F.filter(
        ls, lambda now, i: now.isNotNull() & ~now.eqNullSafe(F.get(ls, i - 1))))


def scan_transcripts(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.withColumn("transcript", vtt_text(F.col(value))).drop(value)
