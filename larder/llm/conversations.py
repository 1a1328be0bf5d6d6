"""Repair of conversation structure: the cheapest edits that give system?, (user, assistant)*.

Every row is kept, given another role or deleted, and rows may be inserted. The cheapest
audit, and of equals the least as text, comes from a dynamic programme over four states
(nothing yet, after system, after user, after assistant). Its edit prefixes are nodes of a
shared tree: a node has its parent, its edit, a rolling hash and its 2**k-th ancestors, so
a tie is settled by a search for the longest common prefix in log n steps. Equal hashes are
verified: nodes are interned, so equal prefixes are one node and others are a collision.

A conversation may hold any share of all rows. Rows are range-sorted by conversation,
turn and digest and written once; a run of one conversation inside a partition is cut
into blocks of ``BLOCK`` rows. Blocks that may belong to a longer conversation give the
cheapest audit for every entry and exit state; these compose block by block in the same
tree, with the rank of a block's audit as the edit. A digest over a whole conversation is
serial by nature: repaired text reaches it as a stream of pieces, never as one value.

* A null role or text counts as one space, and so does a null id or turn in the damage key;
  rows without an id are one conversation. Null turns come first.
* Rows of one turn are ordered by the SHA-256 of their length-prefixed role and text, so
  results do not follow the order of rows in the table; repeated rows are duplicates.
* A role's initial is its first character; a role without one cannot be kept.
* A conversation of which nothing is left has zeros, an empty audit and the digest of the
  empty string; an empty table gives no rows. Texts are read whole, whatever their length.
* ``gaps`` beyond a long is null. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larder.operators import keyed
from larder.session import materialise, ship_package

# Rows of a block.
BLOCK = 1 << 16
# Bytes of a piece of repaired text.
PIECE = 1 << 20
# ASCII white space, as the characters themselves.
BLANKS = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
# State after a role's initial, by state before it; what is missing is not allowed.
AFTER = {(SYSTEM, NONE): SYSTEM, (USER, NONE): USER, (USER, SYSTEM): USER, (USER, ASSISTANT): USER,
         (ASSISTANT, USER): ASSISTANT}
# State after a row whose role is chosen for it.
GIVEN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINE, BLANK, TRUNCATED, DUPLICATE = range(4)
_PRIME, _BASE = (1 << 61) - 1, 0x1E3779B97F4A7C15


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Prefixes:
    """Edit prefixes as interned nodes; node 0 is the empty prefix."""

    def __init__(self):
        self.symbol, self.hash, self.up, self.depth = [None], [0], [()], [0]
        self.known: dict[int, list[int]] = {}
        self.collisions = 0

    def mixed(self, value: int, symbol: int) -> int:
        return (value * _BASE + symbol + 2) % _PRIME

    def extend(self, node: int, symbol: int) -> int:
        value = self.mixed(self.hash[node], symbol)
        same = self.known.setdefault(value, [])
        for other in same:
            if self.up[other][0] == node and self.symbol[other] == symbol:
                return other
        new = len(self.symbol)
        same.append(new)
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.symbol.append(symbol)
        self.hash.append(value)
        self.up.append(tuple(ups))
        self.depth.append(self.depth[node] + 1)
        return new

    def same(self, a: int, b: int) -> bool:
        if self.hash[a] != self.hash[b]:
            return False
        self.collisions += a != b
        return a == b

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Is prefix ``a`` before ``b``: by the first symbol after their longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if not self.same(p, q):
                    x, y = p, q
        return self.symbol[x] < self.symbol[y]

    def path(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.up[node][0]
        return out[::-1]


D, I, K, R = map(ord, "DIKR")


class Search:
    """Cheapest audit per state, edit by edit."""

    def __init__(self, entry: int, costs: Costs):
        self.tree, self.costs = Prefixes(), costs
        self.best: dict[int, tuple[int, int]] = {entry: (0, 0)}

    def offer(self, best: dict, state: int, cost: int, node: int, symbol: int) -> bool:
        known = best.get(state)
        if known and known[0] < cost:
            return False
        new = self.tree.extend(node, symbol)
        if known and known[0] == cost and not self.tree.less(new, known[1]):
            return False
        best[state] = (cost, new)
        return True

    def inserts(self) -> None:
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in list(self.best.items()):
                changed |= self.offer(self.best, GIVEN[state], cost + self.costs.insert, node, I)

    def row(self, initial: int, fault: int) -> None:
        self.inserts()
        new: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            self.offer(new, state, cost + self.costs.delete, node, D)
            if fault not in (BLANK, DUPLICATE):
                left = cost + self.costs.truncated * (fault == TRUNCATED)
                to = AFTER.get((initial, state))
                if to is not None:
                    self.offer(new, to, left, node, K)
                self.offer(new, GIVEN[state], left + self.costs.rerole, node, R)
        self.best = new

    def block(self, paths: list[tuple[int, int, int, int]]) -> None:
        """A block as one edit: (entry, exit, cost, rank) of its cheapest audits."""
        new: dict[int, tuple[int, int]] = {}
        for entry, leave, cost, rank in paths:
            if entry in self.best:
                before, node = self.best[entry]
                self.offer(new, leave, before + cost, node, rank)
        self.best = new

    def end(self) -> tuple[int, int]:
        """Cost and node of the cheapest whole audit."""
        self.inserts()
        ends = [self.best[s] for s in (NONE, ASSISTANT) if s in self.best]
        if len(ends) == 2 and (ends[1][0] < ends[0][0] or ends[1][0] == ends[0][0] and self.tree.less(ends[1][1], ends[0][1])):
            return ends[1]
        return ends[0]


def _letters(symbols: list[int]) -> str:
    return bytes(symbols).decode()


def audit(rows: list[tuple[int, int]], costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and audit of one conversation given as (initial, fault) per row."""
    search = Search(NONE, costs)
    for initial, fault in rows:
        search.row(initial, fault)
    cost, node = search.end()
    return cost, _letters(search.tree.path(node))


def transfers(rows: list[tuple[int, int]], costs: Costs = Costs()) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a block; inserts stand before a row of it, never at its end."""
    out = []
    for entry in range(4):
        search = Search(entry, costs)
        for initial, fault in rows:
            search.row(initial, fault)
        out += [(entry, leave, cost, _letters(search.tree.path(node))) for leave, (cost, node) in search.best.items()]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with every fifth row or so damaged by a hash of its place; ``gone`` marks dropped rows."""
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])), F.lit(20)).cast("int")
    named = named.withColumn("_kind", kind)
    return named.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(True), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _spelled(value: Column) -> Column:
    """A value with its length, so that joined values cannot be read in another way."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.when(value.isNull(), "-").otherwise(F.octet_length(text).cast("string")), F.lit(":"), text)


def stored(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation, turn and digest, with their place ``at``, fault and digest, written once."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    named = named.withColumns({
        "kind": F.unhex(F.sha2(F.concat(_spelled(F.col("conv_id")), _spelled(F.col("role")), _spelled(F.col("text"))), 256)),
        "initial": F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NONE),
        "fault": F.when(ends == "", BLANK).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED),
        # Equal rows are told apart by where they were read, so that a range may end between them.
        "tie": F.monotonically_increasing_id()})
    ranged = named.orderBy("conv_id", F.col("turn").asc_nulls_first(), "kind", "tie").drop("tie")
    return materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "conversations")


def _part() -> Column:
    return F.shiftright("at", 33)


def marked(rows: DataFrame) -> DataFrame:
    """Place, turn, initial and fault of stored rows, duplicates told."""
    kinds = materialise(rows.where((F.col("fault") != BLANK) & ~F.col("gone")).groupBy("kind").agg(
        F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    narrow = rows.select("conv_id", "turn", "kind", "initial", "fault", "gone", "at")
    found = keyed.attach(narrow, kinds, ["kind"], "n", spread=["at"])
    late = (F.col("fault") != BLANK) & (F.col("at") > F.col("first"))
    return found.withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault"))).drop("kind", "first")


def _plus(a, b, pick):
    return b if a is None else a if b is None else pick(a, b)


@dataclass
class Facts:
    """What is counted over rows in order, and added up over blocks in order."""

    counts: list[int]
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: int | None = None
    last: int | None = None

    def add(self, turn: int | None, initial: int, fault: int) -> None:
        one = Facts([int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)], 0, turn, turn, int(turn is not None), initial, initial)
        self.join(one)

    def join(self, other: Facts) -> None:
        """The facts of this and what follows it."""
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]
        between = self.last is not None and other.first is not None and (self.last, other.first) not in (
            (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.illegal += other.illegal + between
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low, self.high = _plus(self.low, other.low, min), _plus(self.high, other.high, max)
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    def row(self) -> dict:
        return {"blank": self.counts[0], "duplicate": self.counts[1], "truncated": self.counts[2], "illegal": self.illegal,
                "low": self.low, "high": self.high, "turns": self.turns, "first": self.first, "last": self.last}

    @staticmethod
    def read(r: dict) -> Facts:
        return Facts([r["blank"], r["duplicate"], r["truncated"]], r["illegal"], r["low"], r["high"], r["turns"], r["first"], r["last"])

    def gaps(self) -> int | None:
        wide = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return wide if wide < 2**63 else None


FACTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first int, last int"
PATHS = "whole boolean, pairs array<int>, costs array<long>, ranks array<int>, letters array<string>"
TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

_TOTALS, _FACTS = ([c.split()[0] for c in ddl.split(", ")] for ddl in (TOTALS, FACTS))


def _schema(conv: StructField, ddl: str) -> StructType:
    return StructType([StructField("conv_id", conv.dataType), *StructType.fromDDL(ddl).fields])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, at: int, edge: bool):
        self.conv, self.at, self.edge, self.size, self.rows, self.facts = conv, at, edge, 0, [], Facts([0, 0, 0])

    def add(self, turn, initial, fault, gone) -> None:
        self.size += 1
        if not gone:
            self.rows.append((initial, fault))
            self.facts.add(turn, initial, fault)

    def summary(self, edge: bool, costs: Costs) -> dict:
        if edge:
            paths = transfers(self.rows, costs)
        else:
            cost, letters = audit(self.rows, costs)
            paths = [(NONE, NONE, cost, letters)]
        rank = {s: i for i, s in enumerate(sorted({p[3] for p in paths}))}
        return {"conv_id": self.conv, "head": self.at, **self.facts.row(), "whole": not edge,
                "pairs": [4 * p[0] + p[1] for p in paths], "costs": [p[2] for p in paths],
                "ranks": [rank[p[3]] for p in paths], "letters": [p[3] for p in paths]}


def blocks(marks: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """A row per block: its facts and cheapest audits; whole conversations inside a partition are done."""
    out = _schema(marks.schema["conv_id"], f"head long, {FACTS}, {PATHS}")

    def summarise(batches):
        shape, run = _arrow(out), None
        for batch in batches:
            done = []
            for conv, turn, initial, fault, gone, at in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "initial", "fault", "gone", "at"))):
                new_part = run is None or at >> 33 != run.at >> 33
                full = run is not None and run.size >= block
                if new_part or full or conv != run.conv:
                    if run is not None:
                        done.append(run.summary(run.edge or new_part or full and conv == run.conv, costs))
                    # The first run of a partition, and what follows a full block, may be a continuation.
                    run = _Run(conv, at, new_part or conv == run.conv)
                run.add(turn, initial, fault, gone)
            yield pa.RecordBatch.from_pylist(done, shape)
        if run is not None:
            yield pa.RecordBatch.from_pylist([run.summary(True, costs)], shape)

    dealt = marks.repartition(_part()).sortWithinPartitions("at")
    return materialise(dealt.mapInArrow(summarise, out), "blocks")


def chosen(parts: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row per block: its letters of the cheapest audit, its entry state and the conversation's totals."""
    conv = parts.schema["conv_id"]
    out = _schema(conv, f"head long, many boolean, pick int, tail string, {TOTALS}")

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("head").to_pylist()
        search, facts = Search(NONE, costs), Facts([0, 0, 0])
        for r in rows:
            facts.join(Facts.read(r))
            search.block([(p // 4, p % 4, c, k) for p, c, k in zip(r["pairs"], r["costs"], r["ranks"])])
        depth = len(rows)
        cost, node = search.end()
        ranks = search.tree.path(node)
        done, state = [], NONE
        for r, rank in zip(rows, ranks):
            pick = next(i for i, (p, k) in enumerate(zip(r["pairs"], r["ranks"])) if p // 4 == state and k == rank)
            state = r["pairs"][pick] % 4
            done.append({"conv_id": r["conv_id"], "head": r["head"], "many": depth > 1, "pick": pick, "tail": "",
                         "gaps": facts.gaps(), "blank": facts.counts[0], "duplicate": facts.counts[1],
                         "truncated": facts.counts[2], "illegal": facts.illegal, "cost": cost})
        done[-1]["tail"] = "I" * (len(ranks) - depth)
        return pa.Table.from_pylist(done, _arrow(out))

    edges = parts.where(~F.col("whole")).select("conv_id", "head", *_FACTS, "pairs", "costs", "ranks")
    composed = edges.groupBy("conv_id").applyInArrow(compose, out)
    letters = parts.select("head", "pairs", "letters")
    split = composed.join(letters, "head").select(
        "conv_id", "head", "many", F.concat(F.get("letters", "pick"), "tail").alias("letters"),
        F.expr("get(pairs, pick) div 4").cast("int").alias("entry"), *_TOTALS)
    gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("turns")),
                      F.when(F.col("low").isNull(), F.lit(0).cast("long")))
    whole = parts.where("whole").select(
        "conv_id", "head", F.lit(False).alias("many"), F.get("letters", F.lit(0)).alias("letters"), F.lit(0).alias("entry"),
        gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("costs", F.lit(0)).alias("cost"))
    return whole.unionByName(split)


def _walk(batches):
    """Events of a stream in which a block's letters come before its rows: blocks, and their repaired rows."""
    letters, place, state = "", 0, NONE

    def inserted():
        nonlocal place, state
        while place < len(letters) and letters[place] == "I":
            place, state = place + 1, GIVEN[state]
            yield "row", (None, None, NAMES[state], b"", "I")

    for batch in batches:
        names = batch.schema.names
        columns = {c: batch.column(c) for c in names}
        heads = columns["letters"].is_valid().to_pylist()
        for i, head in enumerate(heads):
            if head:
                yield from inserted()
                r = {c: columns[c][i].as_py() for c in ("conv_id", "at", "letters", "entry", "many", *_TOTALS)}
                letters, place, state = r["letters"], 0, r["entry"]
                yield "block", r
            elif not columns["gone"][i].as_py():
                yield from inserted()
                edit, place = letters[place], place + 1
                if edit == "D":
                    continue
                role = columns["role"][i].as_py()
                if edit == "R":
                    state = GIVEN[state]
                    role = NAMES[state]
                else:
                    state = AFTER[columns["initial"][i].as_py(), state]
                yield "row", (columns["at"][i].as_py(), columns["turn"][i].as_py(), role, columns["text"][i].as_py(), edit)
        yield "batch", None
    yield from inserted()
    yield "end", None


def _stream(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Stored rows with each block's letters before its first row."""
    texts = rows.select(
        "conv_id", "at", "turn", "initial", "gone", F.col("role").cast("binary").alias("role"),
        F.col("text").cast("binary").alias("text"), F.lit(1).alias("after"))
    heads = picks.withColumnRenamed("head", "at").withColumn("after", F.lit(0))
    both = texts.unionByName(heads, allowMissingColumns=True)
    return both.repartition(_part()).sortWithinPartitions("at", "after")


def prepared(rows: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """The stream of rows and letters for conversations ``rows`` (conv_id, turn, role, text and maybe gone)."""
    ship_package(rows.sparkSession)
    kept = stored(rows)
    return _stream(kept, chosen(blocks(marked(kept), costs, block), costs))


def repaired(rows: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """The repaired rows: conv_id, place, turn (null where inserted), role, text and edit."""
    stream = prepared(rows, costs, block)
    out = _schema(stream.schema["conv_id"], "place long, nth int, turn long, role string, text string, edit string")

    def lines(batches):
        shape, done, conv, at, nth = _arrow(out), [], None, 0, 0
        for event, r in _walk(batches):
            if event == "block":
                conv, at, nth = r["conv_id"], r["at"] - 1, 0
            elif event == "row":
                # An inserted row stands right after the one before it.
                at, nth = (at, nth + 1) if r[0] is None else (r[0], 0)
                done.append({"conv_id": conv, "place": at, "nth": nth, "turn": r[1], "role": r[2].decode(),
                             "text": r[3].decode(), "edit": r[4]})
            elif done:
                yield pa.RecordBatch.from_pylist(done, shape)
                done = []

    return stream.mapInArrow(lines, out)


def audited(rows: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """A row per conversation: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired text."""
    stream = prepared(rows, costs, block)
    shape = _schema(stream.schema["conv_id"], f"at long, nth int, many boolean, {TOTALS}, audit string, repaired_sha256 string, piece binary")

    def digest(batches):
        arrow, done, block, hasher, begun = _arrow(shape), [], None, None, False
        piece, size, nth = [], 0, 0

        def row(**more):
            return {**{c: block[c] for c in ("conv_id", "at", "many", *_TOTALS)}, **more}

        def flush():
            nonlocal piece, size, nth
            done.append(row(nth=nth, audit="" if nth else block["letters"], repaired_sha256=None, piece=b"".join(piece)))
            piece, size, nth = [], 0, nth + 1

        def close():
            if block is not None and block["many"]:
                flush()
            elif block is not None:
                done.append(row(nth=0, audit=block["letters"], repaired_sha256=hasher.hexdigest(), piece=None))

        for event, r in _walk(batches):
            if event == "block":
                close()
                block, hasher, begun, nth = r, hashlib.sha256(), False, 0
            elif event == "row":
                line = b"\n%b:%b" % (r[2], r[3])
                if block["many"]:
                    if size + len(line) > PIECE and piece:
                        flush()
                    piece.append(line)
                    size += len(line)
                else:
                    hasher.update(line if begun else line[1:])
                    begun = True
            else:
                if event == "end":
                    close()
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()

    found = materialise(stream.mapInArrow(digest, shape), "digests")
    out = _schema(stream.schema["conv_id"], f"{TOTALS}, audit string, repaired_sha256 string")
    names = out.names

    def joined(batches):
        """Pieces of conversations in order, to one digest each."""
        arrow, block, hasher, letters, begun = _arrow(out), None, None, [], False

        def row():
            return {**block, "audit": "".join(letters), "repaired_sha256": hasher.hexdigest()}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if block is None or r["conv_id"] != block["conv_id"]:
                    if block is not None:
                        done.append(row())
                    block = {c: r[c] for c in ("conv_id", *_TOTALS)}
                    hasher, letters, begun = hashlib.sha256(), [], False
                letters.append(r["audit"])
                if r["piece"]:
                    hasher.update(r["piece"] if begun else r["piece"][1:])
                    begun = True
            yield pa.RecordBatch.from_pylist(done, arrow)
        if block is not None:
            yield pa.RecordBatch.from_pylist([row()], arrow)

    split = found.where("many").repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth")
    return found.where(~F.col("many")).select(*names).unionByName(split.mapInArrow(joined, out))
