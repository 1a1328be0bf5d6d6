"""Removal of lines that spread over many sites.

Every line hash gets a HyperLogLog sketch of the sites it stands on; sketches
merge on the input tasks and after the shuffle. Far from the threshold the
estimate decides; lines within the error of a sketch get their sites counted
exactly. Either the hashes of removed lines or, if they are too many, the places
of these lines go back to the documents.

* A line is what stands between line feeds, without white space at its ends;
  blank lines are never removed. Null texts count as empty.
* A null site is a site of its own. Repeated rows add no site.
* The lines that stay are kept byte for byte and in order.
* Texts are read whole, whatever their length. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.common import columns, fresh, numbered, utf8, whole
from larder.operators.keyed import attach
from larder.session import materialise

# A line on at least this many sites is boilerplate.
MIN_SITES = 5
# Registers of a sketch (power of two), and three standard errors of its estimate.
REGISTERS = 10
BAND = 3 * 1.04 / 2 ** (REGISTERS / 2)
# Hashes of boilerplate that are sent to the tasks: 8 MB, about 60 MB as a set.
MOST_SENT = 1_000_000
_STRIP = b" \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_STRIP.decode()))


def lines(docs: DataFrame, site: str, number: str | None = None) -> DataFrame:
    """row (the column ``number``, or a number given here), nth, site and hash of every line that is not blank."""
    # A sketch passes over empty strings, so that the missing site needs a name.
    named = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("none"))
    # Rows are numbered before they are taken apart: a generator would number its output.
    place = F.col(number) if number else F.monotonically_increasing_id()
    rows = docs.select(place.alias("row"), named.alias("site"), whole().alias("body"))
    apart = rows.select("row", "site", F.posexplode(F.split("body", "\n")).alias("nth", "line"))
    plain = apart.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return plain.select("row", "nth", "site", F.xxhash64("line").alias("hash"))


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS,
                band: float = BAND) -> DataFrame:
    """hash and n_lines of the lines on at least ``min_sites`` sites."""
    spread = materialise(
        found.groupBy("hash").agg(F.hll_sketch_agg("site", registers).alias("sites"), F.count("*").alias("n_lines"))
        .select("hash", "n_lines", F.hll_sketch_estimate("sites").alias("estimate"))
        .where(F.col("estimate") * (1 + band) + 1 > min_sites), "spread")
    near = (F.col("estimate") * (1 - band) - 1) <= min_sites
    close = spread.where(near).select("hash")
    exact = found.select("hash", "site").join(close, "hash", "left_semi").distinct().groupBy("hash").agg(
        F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites).select("hash")
    sure = spread.where(~near).select("hash")
    return materialise(spread.join(exact.unionByName(sure), "hash", "left_semi").select("hash", "n_lines"), "boilerplate")


def without_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                         registers: int = REGISTERS, band: float = BAND, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs`` without cross-site boilerplate, with columns n_lines and n_removed added.

    Up to ``most_sent`` hashes of boilerplate, which is counted first, are sent
    to the tasks, and texts stay where they are. More of them are joined to the
    lines, and documents then meet the places of their removed lines by a shuffle.
    """
    found = lines(docs, site)
    shared = boilerplate(found, min_sites, registers, band)
    if shared.count() <= most_sent:
        return _sent(docs, frozenset(shared.select("hash").toArrow()["hash"].to_pylist()))
    return _joined(docs, site, shared)


def _sent(docs: DataFrame, hashes: frozenset[int]) -> DataFrame:
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            every = text.as_py().split(b"\n")
            bare = [line.strip(_STRIP) for line in every]
            kept = [line for line, b in zip(every, bare) if not b or line_hash(b) not in hashes]
            out.append({"text": b"\n".join(kept).decode() if len(kept) < len(every) else None,
                        "n_lines": len(every), "n_removed": len(every) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())]))

    made, n_lines, n_removed = fresh(docs, "made", "n_lines", "n_removed")
    cleaned = docs.withColumn(made, F.arrow_udf(clean, "text string, n_lines long, n_removed long")(utf8()))
    out = cleaned.withColumns({
        "text": F.coalesce(F.col(made)["text"], F.col("text")),
        n_lines: F.col(made)["n_lines"], n_removed: F.col(made)["n_removed"]})
    return out.select(*columns(docs), n_lines, n_removed)


def line_hash(line: bytes) -> int:
    """What ``xxhash64`` gives a string."""
    value = xxh64_intdigest(line, 42)
    return value - (1 << 64) if value >> 63 else value


def _joined(docs: DataFrame, site: str, shared: DataFrame) -> DataFrame:
    marked = shared.withColumn("hit", F.lit(True))
    row, gone, n_lines, n_removed, all_lines = fresh(docs, "row", "gone", "n_lines", "n_removed", "all_lines")
    rows = numbered(docs, row)
    hits = attach(lines(rows, site, row).select("row", "nth", "hash"), marked, ["hash"], "n_lines", spread=["row", "nth"]).where("hit")
    places = materialise(hits.groupBy("row").agg(F.collect_list("nth").alias("gone")), "places")
    places = places.select(F.col("row").alias(row), F.col("gone").alias(gone))
    joined = rows.join(places, row, "left")
    cut = joined.withColumn(all_lines, F.split(whole(), "\n"))
    at = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(at, lambda i: F.get(F.col(all_lines), i)), "\n")
    out = cut.withColumns({
        n_lines: F.size(all_lines).cast("long"),
        n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)})
    return out.select(*columns(docs), n_lines, n_removed)


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
plain AS (SELECT *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare FROM lines),
spread AS (SELECT bare FROM plain WHERE bare <> '' GROUP BY bare
  HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (s.bare IS NOT NULL) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (s.bare IS NULL), '')) AS text_sha256
FROM plain LEFT JOIN spread s ON plain.bare = s.bare GROUP BY doc_id
"""
