"""Per-key facts and how to hand them back to the rows, hot keys included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import materialise

# Rows of one key that a single task may receive.
ROWS_PER_TASK = 1_000_000


def attach(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], weight: str,
    how: str = "left", rows_per_task: int = ROWS_PER_TASK, spread: Sequence[str] = (),
) -> DataFrame:
    """Join one-row-per-key facts back to all rows of the key.

    ``weight`` names the column of ``per_key`` with the number of rows per key.
    A key with more than ``rows_per_task`` rows is dealt over
    ``ceil(weight / rows_per_task)`` copies of its fact row, so a task gets
    about ``rows_per_task`` of it however heavy it is. There are at most
    (all rows / rows_per_task) such keys; that bounds what is broadcast. Rows
    are dealt by the columns ``spread``, by default all that can be hashed.
    Rows without a key match nothing and go round the join.
    """
    keys = list(keys)
    hashable = list(spread) or [
        f.name for f in rows.schema.fields
        if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    hot = per_key.where(F.col(weight) > rows_per_task).select(
        *keys, F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int").alias("_salts"))
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = rows.where(~keyless).join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), salts).cast("int"),
    ).drop("_salts")
    right = per_key.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", weight)
    joined = left.join(right, [*keys, "_salt"], how).drop("_salt")
    if how != "left":
        return joined
    return joined.unionByName(rows.where(keyless), allowMissingColumns=True)


def lookup(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a one-row-per-key table; rows without a key go round the join.

    Otherwise all of them would meet in one task, as nulls hash alike.
    """
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    joined = rows.where(~keyless).join(per_key, list(keys), "left")
    return joined.unionByName(rows.where(keyless), allowMissingColumns=True)


# Keys that a sketch of the rows keeps apart, and the most of them that are treated as hot.
TRACKED, HOTTEST = 20_000, 1_000


def heavy_keys(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows, at most ``HOTTEST``, and the copies to deal each over.

    Found by one sketch of bounded size that tasks merge: the rows are not grouped.
    Written out, as both sides of a join must see the same.
    """
    top = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {HOTTEST}, {TRACKED})").alias("_top"))
    met = top.select(F.explode("_top").alias("_t")).select(F.col("_t.item").alias(key), F.col("_t.count").alias("_n"))
    return materialise(met.where(F.col("_n") > rows_per_task).select(
        key, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts")), "heavy-keys")


def spread_lookup(rows: DataFrame, per_key: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK,
                  spread: Sequence[str] = ()) -> DataFrame:
    """``lookup`` by one column where a key may hold any share of the rows, known to ``per_key`` or not.

    Rows of a hot key are dealt by the columns ``spread``, by default all, over as many
    copies of its fact; all other keys are joined as they are.
    """
    hot = heavy_keys(rows, key, rows_per_task)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread or rows.columns]), salts).cast("int")
    left = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left").withColumn("_salt", dealt).drop("_salts")
    right = per_key.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    joined = left.join(right, [key, "_salt"], "left").drop("_salt")
    return joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def pin(rows: DataFrame) -> DataFrame:
    """Rows whose expensive columns are computed once, whatever is filtered on later.

    A filter is normally pushed below the projection that feeds it, which would
    write a costly expression out a second time. Generated columns stop that.
    """
    whole = F.explode_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return rows.select(whole.alias("_row")).select("_row.*")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, not a window: each input task keeps one candidate per key, so
    a hot key is reduced before the shuffle.
    """
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def earliest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def newest_n_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
) -> DataFrame:
    """At most ``n`` newest rows per key; Spark limits each group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
