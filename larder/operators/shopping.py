"""Shopping-list jobs: consolidation, matching lines to ingredients, list upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import quantity as Q
from larder.functions.text import clean_line, let, trim
from larder.operators import ordered
from larder.operators.ordered import CHUNK, Chunked, previous_value
from larder.session import materialise

# Hashes of owners that lines are counted by: the average bucket stays far below a chunk.
OWNER_BUCKETS = 1 << 17
# Fractional parts a spelled quantity can have: eighths, sixths and tenths.
_PARTS = sorted({round(n / d, 9): n / d for d in (8, 6, 10) for n in range(d)}.values())


def ingredient_rows(recipes: DataFrame, keep: Sequence[str | Column], factor: float = 1) -> DataFrame:
    """One row per scaled ingredient with its position, rendered line and merge key."""
    scaled = Q.scale_ingredients(F.col("ingredients"), factor)
    exploded = recipes.select(*keep, F.posexplode(scaled).alias("pos", "_i"))
    kept = [c for c in exploded.columns if c not in ("pos", "_i")]
    return exploded.select(
        *kept, "pos", Q.ingredient_line(F.col("_i")).alias("text"),
        F.coalesce(Q.merge_key(F.col("_i.item")), F.lit("")).alias("key")).where(F.col("text") != "")


def consolidate(
    lines: DataFrame, owner: str, order: Sequence[str], text: str = "text", key: str = "key",
    chunks: int | None = None,
) -> DataFrame:
    """Merge lines of one owner that name the same item and measure it alike.

    The first line of a key owns it. A later line joins it when both have a
    quantity and the same remaining text; anything else stays a line of its own,
    so nothing is ever dropped. Each addition is spelled as kitchen text before
    the next one, which makes the sum an ordered fold. Ownership goes by the
    whole key: a line is never merged into one whose text merely ends alike.

    Lines are sent once, by owner: a task then folds whole owners. Owners that may hold
    more lines than a task should get are found by counting the lines per hash of the
    owner; theirs are cut into chunks inside the key (``chunks`` asks for that many, of all lines).
    """
    if chunks:
        return _consolidate_chunked(lines, owner, order, text, key, chunks)
    # Counted, then sent: what makes the lines is run once.
    lines = materialise(lines.select(owner, key, *order, text), "lines", lean=True)
    total = lines.count()
    tasks = max(1, -(-total // ordered.ROWS_PER_CHUNK))
    if tasks == 1:
        return _consolidate_owners(lines, owner, order, text, key, tasks)
    bucket = F.pmod(F.xxhash64(owner), F.lit(OWNER_BUCKETS)).alias("_bucket")
    large = materialise(lines.groupBy(bucket).agg(F.count("*").alias("_n")).where(
        F.col("_n") > ordered.ROWS_PER_CHUNK).select("_bucket"), "large-owners")
    if large.isEmpty():
        return _consolidate_owners(lines, owner, order, text, key, tasks)
    parted = lines.withColumn("_bucket", bucket)
    few = parted.join(F.broadcast(large), "_bucket", "left_anti").drop("_bucket")
    many = parted.join(F.broadcast(large), "_bucket", "left_semi").drop("_bucket")
    return _consolidate_owners(few, owner, order, text, key, tasks).unionByName(
        _consolidate_chunked(many, owner, order, text, key, None))


def _consolidate_owners(
    lines: DataFrame, owner: str, order: Sequence[str], text: str, key: str, tasks: int,
) -> DataFrame:
    """``consolidate`` for owners that each fit a task: one exchange, everything else inside the groups."""
    at = lambda l: F.struct(*[l[o] for o in order])
    line = lambda l, merged_text, merged: F.struct(
        *[l[o].alias(o) for o in order], merged_text.alias("text"), merged.cast("long").alias("merged"))
    grouped = lines.repartition(tasks, owner).groupBy(owner, key).agg(
        F.collect_list(F.struct(*order, F.col(text).alias("_text"))).alias("_lines"))

    def read(l: Column) -> Column:
        return F.struct(*[l[o].alias(o) for o in order], Q.leading_quantity(l["_text"]).alias("_qty"),
                        l["_text"].alias("_text"), Q.after_quantity(l["_text"]).alias("_rest"))

    def settled(rows: Column) -> Column:
        return let(F.get(rows, F.lit(0)), lambda head: owned(rows, head))

    def owned(rows: Column, head: Column) -> Column:
        def merges(l: Column) -> Column:
            return (at(l) != at(head)) & l["_qty"].isNotNull() & head["_qty"].isNotNull() & (
                F.lower(l["_rest"]) == F.lower(head["_rest"]))

        def first(adds: Column) -> Column:
            total = F.aggregate(adds, head["_qty"], lambda acc, a: Q.spelled_value(acc + a["_qty"]))
            spelled = trim(F.concat_ws(" ", Q.format_quantity(total), head["_rest"]))
            return line(head, F.when(F.size(adds) > 0, spelled).otherwise(head["_text"]), F.size(adds))

        others = F.filter(rows, lambda l: (at(l) != at(head)) & ~F.coalesce(merges(l), F.lit(False)))
        return F.concat(F.array(let(F.filter(rows, merges), first)), F.transform(
            others, lambda l: line(l, l["_text"], F.lit(0))))

    as_they_are = F.transform("_lines", lambda l: line(l, l["_text"], F.lit(0)))
    # A line alone under its key, and lines without a key, stay as they are: nothing is read off them.
    settled_lines = F.when((F.size("_lines") > 1) & (F.col(key) != ""), let(
        F.array_sort(F.transform("_lines", read)), settled)).otherwise(as_they_are)
    return grouped.select(owner, key, F.explode(settled_lines).alias("_l")).select(owner, key, "_l.*")


def _consolidate_chunked(
    lines: DataFrame, owner: str, order: Sequence[str], text: str, key: str, chunks: int | None,
) -> DataFrame:
    """``consolidate`` for owners of any size.

    Spelling rounds to a short list of fractional parts and ignores whole units,
    so a chunk in the middle of a key is summarised by where each fractional
    part (and the owner's own quantity, if nothing merged yet) would end up.
    """
    c = Chunked(lines, [owner, key], order, chunks)
    # Quantities are read off the text after the cut: finding the cuts reads the rows once more.
    split = {"_qty": Q.leading_quantity(F.col(text)), "_rest": Q.after_quantity(F.col(text))}
    own = F.struct(*order, text, "_qty", "_rest")
    rows = c.rows.withColumns(split).withColumn("_head", F.first(own).over(c.running))
    first = c.summaries(c.rows, F.min_by(F.struct(*order, text), F.struct(*order)).alias("_f"))
    heads = first.select(owner, key, CHUNK, "_f.*").withColumns(split).withColumn(
        "_h", own).groupBy(
        owner, key).agg(F.min_by("_h", CHUNK).alias("_key_head"), F.min(CHUNK).alias("_first"))
    rows = rows.join(F.broadcast(heads), [owner, key], "left").withColumn(
        "_head", F.coalesce("_key_head", "_head")).drop("_key_head")

    is_head = F.struct(*order) == F.struct(*[F.col(f"_head.{o}") for o in order])
    alike = (
        F.col("_qty").isNotNull() & F.col("_head._qty").isNotNull()
        & (F.lower("_rest") == F.lower("_head._rest")) & (F.col(key) != ""))
    role = F.when(is_head & (F.col(key) != ""), "head").when(alike, "merge").otherwise("own")
    rows = rows.withColumn("_role", role)

    passed = rows.where(F.col("_role") == "own").select(
        owner, key, *order, F.col(text).alias("text"), F.lit(0).cast("long").alias("merged"))

    per_chunk = rows.where(F.col("_role") != "own").groupBy(owner, key, CHUNK).agg(
        F.array_sort(F.collect_list(F.when(
            F.col("_role") == "merge", F.struct(*order, "_qty")))).alias("_adds"),
        F.any_value("_head").alias("_head"), F.any_value("_first").alias("_first"))

    def fold(start: Column) -> Column:
        return F.aggregate(
            F.col("_adds"), start, lambda acc, a: Q.spelled_value(acc + a["_qty"]))

    start = F.col("_head._qty")
    parts = F.array(*[F.lit(p) for p in _PARTS])
    inner = F.coalesce(F.col("_first"), F.col(CHUNK)) != F.col(CHUNK)
    ends = per_chunk.select(
        owner, key, CHUNK, "_head", F.size("_adds").cast("long").alias("_n"),
        fold(start).alias("_from_head"),
        F.when(inner, F.transform(parts, fold)).alias("_from_part"))
    composed = ends.groupBy(owner, key).agg(
        F.array_sort(F.collect_list(F.struct(
            CHUNK, "_n", "_from_head", "_from_part"))).alias("_chunks"),
        F.any_value("_head").alias("_head"), F.sum("_n").alias("merged"))

    def enter(value: Column, table: Column) -> Column:
        def exit_of(part: Column) -> Column:
            at = F.array_position(
                F.transform(parts, lambda p: F.round(p, 6)), F.round(part, 6)).cast("int")
            # A fraction outside the list would lose the quantity without a trace.
            return F.when(at == 0, F.raise_error(F.lit("a quantity has a fraction that cannot be spelled")).cast("double")).otherwise(
                F.get(table, at - 1))

        return F.floor(value + F.lit(1e-7)) + let(
            F.greatest(F.lit(0.0), value - F.floor(value + F.lit(1e-7))), exit_of)

    def step(acc: Column, chunk: Column) -> Column:
        following = F.when(acc["n"] == 0, chunk["_from_head"]).otherwise(
            enter(acc["v"], chunk["_from_part"]))
        return F.when(chunk["_n"] == 0, acc).otherwise(F.struct(
            following.alias("v"), (acc["n"] + chunk["_n"]).alias("n")))

    total = F.aggregate(
        F.col("_chunks"),
        F.struct(F.col("_head._qty").alias("v"), F.lit(0).cast("long").alias("n")), step)["v"]
    merged_text = trim(F.concat_ws(" ", Q.format_quantity(total), F.col("_head._rest")))
    owners = composed.select(
        owner, key, *[F.col(f"_head.{o}").alias(o) for o in order],
        F.when(F.col("merged") > 0, merged_text).otherwise(F.col(f"_head.{text}")).alias("text"),
        "merged")
    return owners.unionByName(passed)


def match_open_lines(
    lines: DataFrame, keys: DataFrame, owner: str, order: Sequence[str],
    line_id: str = "id", text: str = "text", key: str = "key",
) -> DataFrame:
    """Oldest open line per ingredient key: equal to the key or ending in ``' ' + key``.

    A suffix test would be a nested loop. Every word suffix of a line becomes a
    row instead, reduced to the oldest line per suffix before an equi join. Only
    suffixes of as many words as the longest key are made.
    """
    longest = keys.agg(F.max(F.size(F.split(key, " ")))).first()[0] or 1
    words = F.split(Q.merge_key(F.col(text)), " ")
    opened = lines.where(~F.col("checked")).select(
        owner, F.struct(*order).alias("_at"), F.col(line_id).alias("line_id"),
        F.col(text).alias("line_text"), words.alias("_w"))
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("_w") - F.lit(longest - 1)), F.size("_w")),
        lambda i: F.array_join(F.slice(F.col("_w"), i, F.size("_w")), " "))
    oldest = opened.withColumn(key, F.explode(suffixes)).where(F.col(key) != "").groupBy(
        owner, key).agg(F.min_by(F.struct("line_id", "line_text"), "_at").alias("_line"))
    wanted = keys.where(F.col(key) != "").select(owner, key).distinct()
    return wanted.join(oldest, [owner, key], "inner").select(owner, key, "_line.*")


def add_recipes(
    requests: DataFrame, lines: DataFrame, request: str, owner: str, order: Sequence[str],
    line_id: str = "id", chunks: int | None = None,
) -> DataFrame:
    """What adding each recipe to its owner's list changes: (request, action, line_id, pos, text).

    ``requests`` are the scaled ingredients (request, owner, pos, text, key) as
    ``ingredient_rows`` gives them, ``lines`` the lists as they are. The oldest
    open line that names an ingredient owns it, else the ingredient's first
    mention; checked lines are left alone. What measures alike is added up: an
    open line gets an ``update`` with its new text, everything else a ``create``.
    Requests see the lists as they were, not each other. If two ingredients
    change one line, the one that comes later in the recipe stands.
    """
    matches = match_open_lines(lines, requests, owner, order, line_id)
    wanted = requests.where("key <> ''").groupBy(request, owner, "key").agg(F.max("pos").alias("_last"))
    owned = wanted.join(matches, [owner, "key"]).select(
        request, "key", "line_id", "_last", F.lit(0).alias("_kind"), F.lit(-1).alias("pos"), F.col("line_text").alias("text"))
    both = owned.select(request, "key", "_kind", "pos", "text").unionByName(
        requests.select(request, "key", F.lit(1).alias("_kind"), "pos", "text"))
    merged = consolidate(both, request, ["_kind", "pos"], chunks=chunks)
    changed = merged.where("_kind = 0 and merged > 0").join(owned.select(request, "key", "line_id", "_last"), [request, "key"])
    updates = changed.groupBy(request, "line_id").agg(F.max_by("text", F.struct("_last", "key")).alias("text")).select(
        request, F.lit("update").alias("action"), "line_id", F.lit(None).cast("int").alias("pos"), "text")
    none = F.lit(None).cast(updates.schema["line_id"].dataType)
    return updates.unionByName(merged.where("_kind = 1").select(
        request, F.lit("create").alias("action"), none.alias("line_id"), F.col("pos").cast("int").alias("pos"), "text"))

def add_recipe_series(
    requests: DataFrame, lines: DataFrame, request: str, owner: str, order: Sequence[str],
    line_id: str = "id", chunks: int | None = None,
) -> DataFrame:
    """The lists after several recipes were added one after the other: (owner, action, line_id, request, pos, text).

    Each request, in order of ``request``, finds the list the one before it left. The line
    that owns an ingredient is the oldest open one that names it: of the list as it was
    or, where none does, the first line that an earlier request put there; inside the
    request that names it first, its first mention. What an owner takes in over all
    requests is one ordered fold per line, whatever their number; lines that took nothing
    in are not listed unless they are new.
    """
    known = match_open_lines(lines, requests, owner, order, line_id)
    wanted = materialise(requests.select(owner, request, "pos", "text", "key").join(
        known.withColumnRenamed("line_id", "_line"), [owner, "key"], "left"), "series")
    fresh = wanted.where("key <> '' and _line is null")
    mention = F.struct(F.col(request).alias("request"), F.col("pos").alias("pos"))
    put = fresh.select(owner, request, "pos", "text", F.lit(False).alias("checked"), mention.alias("_mention"))
    first = match_open_lines(put, fresh, owner, [request, "pos"], "_mention").select(
        owner, "key", F.col("line_id.request").alias("_first"), F.col("line_id.pos").alias("_at"))
    own = fresh.groupBy(owner, request, "key").agg(F.min("pos").alias("_own"))
    aimed = wanted.join(first, [owner, "key"], "left").join(own, [owner, request, "key"], "left")

    def named(kind: str, *parts: Column) -> Column:
        return F.concat(F.lit(kind), F.concat_ws(":", *[p.cast("string") for p in parts]))

    target = (
        F.when(F.col("key") == "", "").when(F.col("_line").isNotNull(), named("line ", F.col("_line")))
        .when(F.col(request) > F.col("_first"), named("new ", F.col("_first"), F.col("_at")))
        .otherwise(named("new ", F.col(request), F.col("_own"))))
    rows = aimed.select(
        owner, target.alias("target"), F.lit(1).alias("_kind"), request, "pos", "text", "_line")
    none = F.lit(None).cast(requests.schema[request].dataType)
    # A line of the list stands before all requests, whichever it is dated by.
    heads = wanted.where("_line is not null").groupBy(owner, "_line", "line_text").agg(F.min(request).alias(request)).select(
        owner, named("line ", F.col("_line")).alias("target"), F.lit(0).alias("_kind"), request,
        F.lit(-1).alias("pos"), F.col("line_text").alias("text"), "_line")
    merged = consolidate(heads.drop("_line").unionByName(rows.drop("_line")), owner, ["_kind", request, "pos"], key="target", chunks=chunks)
    made = merged.where("_kind = 1").select(
        owner, F.lit("create").alias("action"), F.lit(None).cast(known.schema["line_id"].dataType).alias("line_id"),
        request, F.col("pos").cast("int").alias("pos"), "text")
    changed = merged.where("_kind = 0 and merged > 0").select(owner, "target", "text").join(
        heads.select(owner, "target", "_line"), [owner, "target"]).select(
        owner, F.lit("update").alias("action"), F.col("_line").alias("line_id"), none.alias(request),
        F.lit(None).cast("int").alias("pos"), "text")
    return changed.unionByName(made)



def source_labels(
    items: DataFrame, owner: str, order: Sequence[str], title: str = "recipe_title",
    chunks: int | None = None,
) -> DataFrame:
    """``from <title>`` once per run of neighbours with the same label."""
    name = F.coalesce(trim(F.col(title)), F.lit(""))
    labelled = items.withColumn(
        "_label", F.when(name == "", F.lit("")).otherwise(F.concat(F.lit("from "), name)))
    seen = previous_value(labelled, [owner], order, "_label", "_before", chunks)
    shown = F.when(F.col("_before") == F.col("_label"), F.lit("")).otherwise(F.col("_label"))
    return seen.withColumn("source_label", shown).drop("_label", "_before")


def progress(items: DataFrame, owner: str) -> DataFrame:
    """Checked and total lines per list, with the sentence shown above it."""
    counted = items.groupBy(owner).agg(
        F.count_if("checked").alias("checked_count"), F.count("*").alias("total"))
    return counted.withColumn("progress", F.concat(
        F.col("checked_count").cast("string"), F.lit(" of "),
        F.col("total").cast("string"), F.lit(" in the basket")))


def split_by_checked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.where(~F.col("checked")), items.where("checked")


def clean_items(rows: DataFrame, text: str = "text") -> DataFrame:
    """Trim and collapse typed lines; blank ones are dropped."""
    return rows.withColumn(text, clean_line(F.col(text))).where(F.col(text) != "")


def list_order(*created: str) -> list[Column]:
    """Open lines first, then by age."""
    return [F.asc("checked"), *[F.asc(c) for c in created]]


def clear_checked(items: DataFrame, checked: bool | None) -> DataFrame:
    """Remove ticked lines; refuses to run without the explicit opt-in."""
    if checked is not True:
        raise ValueError("pass checked=True to clear checked items")
    return items.where(~F.col("checked"))
