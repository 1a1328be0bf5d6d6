"""Token counts as delta-maintained rollups.

A change is a row of signed numbers: an insert adds a document and its tokens,
a delete takes them away, a revision adds the difference. Changes are summed
per source, language and tokenizer version on the input tasks, and a batch
stores only its sums. A batch becomes visible with one small row in the ledger,
written after its sums are complete; a batch that is in the ledger already is
not applied again. A failed or repeated job thus neither loses nor doubles
counts, and totals are the sum of what the ledger names.

* Null sources, languages and tokenizers are groups of their own; null texts have no tokens.
* Groups whose documents and tokens have all been taken back are not listed.
* An empty batch is committed like any other.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "source string, lang string, tokenizer string, docs long, tokens long"
LEDGER = "batch_id string, folder string, covers array<string>, at timestamp"


def counter(path: str):
    """Column function: number of tokens of a UTF-8 text under a vocabulary of ranks."""

    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(path).encode_ordinary
        return pa.array([len(encode(t.as_py().decode())) for t in texts], pa.int64())

    return F.arrow_udf(count, "long")


_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import base64

        import tiktoken

        from larder.llm.bpe import Vocabulary

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=Vocabulary.SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _change(rows: DataFrame, tokenizer: Column, docs: Column, tokens: Column) -> DataFrame:
    return rows.select("source", "lang", tokenizer.alias("tokenizer"), docs.cast("long").alias("docs"),
                       F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def inserts(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    return _change(rows, F.lit(tokenizer), F.lit(1), F.col(tokens))


def deletes(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    return _change(rows, F.lit(tokenizer), F.lit(-1), -F.col(tokens))


def revisions(rows: DataFrame, tokenizer: str, before: str, after: str) -> DataFrame:
    """The document stays where it is; only its count changes."""
    return _change(rows, F.lit(tokenizer), F.lit(0), F.col(after) - F.coalesce(F.col(before), F.lit(0)))


class Rollup:
    """Totals kept in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _ledger(self) -> list:
        """Rows of the ledger in force: one for each batch not yet folded, and the last fold."""
        try:
            ledger = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        rows = sorted(ledger.collect(), key=lambda r: (r["at"], r["folder"]))
        fold = max((r for r in rows if r["batch_id"] is None), key=lambda r: len(r["covers"]), default=None)
        seen, out = set(fold["covers"] if fold else ()), [fold] if fold else []
        for r in rows:
            if r["batch_id"] is not None and r["batch_id"] not in seen:
                seen.add(r["batch_id"])
                out.append(r)
        return out

    def _record(self, batch_id: str | None, folder: str, covers: list[str]) -> None:
        self.spark.range(1).select(
            F.lit(batch_id).cast("string").alias("batch_id"), F.lit(folder).alias("folder"),
            F.array(*[F.lit(c) for c in covers]).cast("array<string>").alias("covers"),
            F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def committed(self) -> set[str]:
        rows = self._ledger()
        return {r["batch_id"] for r in rows if r["batch_id"]} | {b for r in rows if not r["batch_id"] for b in r["covers"]}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it had been applied before."""
        if batch_id in self.committed():
            return False
        folder = f"{self.root}/sums/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(folder)
        self._record(batch_id, folder, [])
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over all committed batches."""
        folders = [r["folder"] for r in self._ledger()]
        if not folders:
            return self.spark.createDataFrame([], CHANGES)
        sums = self.spark.read.schema(CHANGES).parquet(*folders)
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
            "docs <> 0 or tokens <> 0")

    def fold(self) -> None:
        """Replace the batches so far by one set of sums; readers see either state whole."""
        folder, covers = f"{self.root}/sums/{uuid.uuid4().hex}", sorted(self.committed())
        self.totals().write.parquet(folder)
        self._record(None, folder, covers)

    def sink(self, prefix: str):
        """For ``writeStream.foreachBatch``: a micro-batch that runs again commits nothing twice."""
        return lambda changes, number: self.commit(f"{prefix}-{number}", changes)


def without_repeated_lines(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def maintained(docs: DataFrame, labels: DataFrame, root: str, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Totals after four batches over a corpus; ``old`` and ``new`` are (version, vocabulary path).

    Every document is inserted; the toxic ones are deleted; lines repeated inside
    a document are dropped and its count revised; what is left is counted again
    under the new tokenizer version, beside the old one.
    """
    from larder.llm.common import utf8, whole
    from larder.session import materialise

    version, path = old
    rows = docs.select("doc_id", "source", "lang", whole().alias("body"))
    toxic = materialise(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(
        "toxic > 0 and doc_id is not null").select("doc_id"), "toxic")
    counted = materialise(rows.select(
        "doc_id", "source", "lang", counter(path)(utf8("body")).alias("tokens")), "counted")
    slim = without_repeated_lines(F.col("body"))
    left = rows.join(toxic, "doc_id", "left_anti")
    rollup = Rollup(docs.sparkSession, root)
    rollup.commit("insert", inserts(counted, version))
    rollup.commit("delete", deletes(counted.join(toxic, "doc_id", "left_semi"), version))
    changed = left.withColumn("slim", slim).where("slim <> body").select(
        "source", "lang", counter(path)(utf8("body")).alias("before"), counter(path)(utf8("slim")).alias("after"))
    rollup.commit("revise", revisions(changed, version, "before", "after"))
    rollup.commit("upgrade", inserts(left.select(
        "source", "lang", counter(new[1])(slim.cast("binary")).alias("tokens")), new[0]))
    return rollup.totals()
