"""Redaction with a table of secrets of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.ordered import numbered
from larder.session import materialise, ship_package

# Secrets shorter than this are left alone, and what stands for the others.
SHORTEST, MASK = 8, "***"
# Bytes of secrets that are sent to every task at once.
BLOCK_BYTES = 16 << 20


def secret_blocks(secrets: DataFrame, secret: str, order: str, block_bytes: int = BLOCK_BYTES):
    """Lists of secrets in order, each of about ``block_bytes`` at most: what is broadcast is bounded."""
    usable = secrets.where(F.char_length(secret) >= SHORTEST).select(F.col(order).alias("_order"), F.col(secret).alias("_secret"))
    placed = materialise(numbered(usable, [F.col("_order"), F.col("_secret")], "_place"), "secrets")
    size = F.sum(F.octet_length("_secret") + 64)
    rows, total = placed.agg(F.count("*"), size).first()
    count = max(1, -(-(total or 0) // block_bytes))
    while count < rows:
        block = F.floor((F.col("_place") - 1) * count / F.lit(rows))
        if placed.groupBy(block).agg(size.alias("b")).agg(F.max("b")).first()[0] <= 2 * block_bytes:
            break
        count *= 2
    for k in range(count if rows else 0):
        part = placed.where(F.floor((F.col("_place") - 1) * count / F.lit(rows)) == k).orderBy("_place").select("_secret")
        yield [r[0] for r in part.collect()]


def redact(rows: DataFrame, secrets: DataFrame, text: str = "text", secret: str = "secret", order: str = "position",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` with every listed secret of eight characters or more blanked out, one after the other in list order.

    An Aho-Corasick automaton finds which secrets a text has at all; only those are
    replaced, in order. What a replacement leaves cannot make another secret of the
    list, unless that has an asterisk: such secrets are always tried. A list beyond
    ``block_bytes`` is applied in blocks, in order, each to the text the last one left.
    Null texts stay null; null secrets are none.
    """
    ship_package(rows.sparkSession)
    for block in secret_blocks(secrets, secret, order, block_bytes):
        rows = rows.withColumn(text, _redactor(rows.sparkSession.sparkContext.broadcast(block))(F.col(text)))
    return rows


def _redactor(shared):
    held = {}

    def blank(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not held:
            found = ahocorasick.Automaton()
            for place, word in enumerate(shared.value):
                if not found.exists(word):
                    found.add_word(word, place)
            found.make_automaton()
            held["found"], held["always"] = found, {i for i, w in enumerate(shared.value) if "*" in w}
        out = []
        for text in texts.to_pylist():
            if text is not None:
                met = {place for _, place in held["found"].iter(text)} | held["always"]
                for place in sorted(met):
                    text = text.replace(shared.value[place], MASK)
            out.append(text)
        return pa.array(out, pa.string())

    return F.arrow_udf(blank, "string")
