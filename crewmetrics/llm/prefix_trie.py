"""Which conversations share which beginnings: a trie of turns, built from ternary search trees per range of conversations.

Turns get numbers from a dictionary, a conversation is a row of numbers, and equal conversations are one row beforehand.
The rows are dealt out by range of their order, so that a beginning lies in one shard, or in shards side by side.  A
shard puts its rows into a ternary search tree, the median first, so that each binary level is balanced, and adds up
members, leaves and savings from the last nodes to the first.  Only the nodes on the way to a shard's first and last row
can be in another shard too: these stay open, and runs of neighbouring shards merge theirs, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.scratch import written

#: turns for one shard, shards that merge at a time, and conversation ids (as bits) that one entry of a member list spans
SHARD_TURNS, MERGED_SHARDS, LIST_BITS = 200_000, 64, 12

EMPTY = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<id:bigint,size:bigint>>"
_NODE = "depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"
#: ``closed`` nodes have their final figures; ``key`` is a digest of the beginning, ``up`` that of one turn less (only where needed)
_ROW = f"unit long, closed boolean, first boolean, last boolean, key binary, up binary, size long, {_NODE}"


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, digest, size, id``: turns with the number of their role and text, and the bytes of the text."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)
    rows = written(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.sha2(both, 256)).alias("digest"),
        F.octet_length(what).cast("long").alias("size"),
    ))
    # numbers of a written table: a task that is run again gives the same ones
    dictionary = written(rows.select("digest").distinct()).withColumn("id", F.monotonically_increasing_id())
    return rows.join(dictionary, "digest")


def shared_beginnings(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """``conv, turns``: the first ``taken`` (at most ``most``) turns of conversation ``base``, then the own turns behind as many."""
    own = turns.withColumn("base", base).repartition("base").groupBy("base", "conv")
    own = own.agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size"))).alias("rows"))
    own = own.select("base", "conv", F.transform("rows", lambda r: F.struct(r["id"], r["size"])).cast(_TURNS).alias("turns"))
    heads = own.where(F.col("conv") == F.col("base")).select("base", F.slice("turns", 1, most).alias("head"))
    joined = own.join(heads, "base", "left").withColumn("_h", taken)
    head = F.slice(F.coalesce("head", F.array().cast(_TURNS)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns") + 1)
    return joined.select("conv", F.concat(head, rest).alias("turns"))


class Tree:
    """A ternary search tree of rows of numbers; node 0 is the empty beginning."""

    def __init__(self):
        self.id, self.low, self.high, self.down, self.parent, self.depth, self.size = ([0], [-1], [-1], [-1], [-1], [0], [0])
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends = ([0], [None], [0], [0], [0], [None])

    def _new(self, number: int, parent: int, size: int) -> int:
        for column, value in (
            (self.id, number), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.size, size),
            (self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None),
        ):
            column.append(value)
        return len(self.id) - 1

    def _child(self, at: int, number: int, size: int) -> int:
        """The node behind ``at`` by ``number``, made where it is missing."""
        here = self.down[at]
        if here < 0:
            self.down[at] = self._new(number, at, size)
            return self.down[at]
        while True:
            if number == self.id[here]:
                return here
            side = self.low if number < self.id[here] else self.high
            if side[here] < 0:
                made = self._new(number, at, size)
                side[here] = made
                return made
            here = side[here]

    def _count(self, at: int, n: int, conv: int) -> None:
        self.n[at] += n
        if self.conv[at] is None or conv < self.conv[at]:
            self.conv[at] = conv

    def insert(self, numbers: list[int], sizes: list[int], n: int, conv: int, ends: str) -> list[int]:
        """Add a row with its ``n`` conversations; gives its nodes, the empty beginning first."""
        at, path = 0, [0]
        self._count(0, n, conv)
        for number, size in zip(numbers, sizes, strict=True):
            at = self._child(at, number, size)
            path.append(at)
            self._count(at, n, conv)
        self.ends[at] = ends
        return path


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each stretch before its halves."""
    stretches = [(0, n)]
    while stretches:
        halves = []
        for a, b in stretches:
            if a < b:
                middle = (a + b) // 2
                yield middle
                halves += [(a, middle), (middle + 1, b)]
        stretches = halves


def _keys(numbers: list[int]) -> list[bytes]:
    """A digest of each beginning of a row."""
    held = hashlib.blake2b(digest_size=16)
    out = [held.digest()]
    for number in numbers:
        held.update(number.to_bytes(8, "little", signed=True))
        out.append(held.copy().digest())
    return out


def _closed(row: dict, n_children: int, n_leaves: int, saved: int) -> tuple[int, int, int]:
    """Children, leaves and savings of a node and all below it."""
    return n_children, n_leaves if n_children else 1, saved + (row["n_convs"] - 1) * row["size"]


def _shard_rows(rows: list[tuple], unit: int) -> list[dict]:
    """The nodes of one shard from its distinct rows in order: (numbers, sizes, n, conv, ends)."""
    if not rows:
        return []
    tree, paths = Tree(), {}
    for i in _medians(len(rows)):
        path = tree.insert(*rows[i])
        if i in (0, len(rows) - 1):
            paths[i] = path
    first, last = paths[0], paths[len(rows) - 1]
    keys = dict(zip(first, _keys(rows[0][0]), strict=True)) | dict(zip(last, _keys(rows[-1][0]), strict=True))
    on_first, on_last, out = set(first), set(last), []
    # a node is made after the one it hangs on: backwards, all below a node comes before it
    for at in range(len(tree.id) - 1, -1, -1):
        up, still_open = tree.parent[at], at in keys
        row = {"unit": unit, "closed": not still_open, "first": at in on_first, "last": at in on_last, "key": keys.get(at), "up": keys.get(up), "size": tree.size[at], "depth": tree.depth[at], "conv": tree.conv[at], "n_convs": tree.n[at], "ends": tree.ends[at]}
        figures = tree.children[at], tree.leaves[at], tree.saved[at]
        if not still_open:
            figures = _closed(row, *figures)
            tree.children[up] += 1
            tree.leaves[up] += figures[1]
            tree.saved[up] += figures[2]
        row["parent_conv"] = None if up < 0 or up in keys else tree.conv[up]
        row["n_children"], row["n_leaves"], row["saved"] = figures
        out.append(row)
    return out


def _merged_rows(rows: list[dict], unit: int, final: bool) -> list[dict]:
    """The open nodes of shards side by side: figures of the same beginning added up, all inside the run closed."""
    units = [r["unit"] for r in rows]
    held: dict[bytes, dict] = {}
    for row in rows:
        at = held.setdefault(row["key"], row | {"unit": unit, "first": False, "last": False, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0})
        for name in ("n_convs", "n_children", "n_leaves", "saved"):
            at[name] += row[name]
        at["conv"] = min(at["conv"], row["conv"])
        at["ends"] = at["ends"] or row["ends"]
        at["first"] |= row["first"] and row["unit"] == min(units)
        at["last"] |= row["last"] and row["unit"] == max(units)
    for row in sorted(held.values(), key=lambda r: -r["depth"]):
        row["closed"] = final or not (row["first"] or row["last"])
        if row["closed"]:
            row["n_children"], row["n_leaves"], row["saved"] = _closed(row, row["n_children"], row["n_leaves"], row["saved"])
            up = held.get(row["up"])
            if up:
                up["n_children"] += 1
                up["n_leaves"] += row["n_leaves"]
                up["saved"] += row["saved"]
    for row in held.values():
        up = held.get(row["up"])
        if row["closed"] and up and (final or not (up["first"] or up["last"])):
            row["parent_conv"] = up["conv"]
    return list(held.values())


def _merger(final: bool):
    def merge(table: pa.Table) -> pa.Table:
        return _table(_merged_rows(table.drop_columns(["run"]).to_pylist(), table["run"][0].as_py(), final), _schema())

    return merge


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in _ROW.split(", "))])


def members(rebuilt: DataFrame) -> DataFrame:
    """``turns, block, n, conv, listed``: equal conversations in one row for each stretch of ids, which bounds the list."""
    return rebuilt.groupBy("turns", F.shiftright("conv", LIST_BITS).alias("block")).agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"),
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("listed"),
    )


def trie(rebuilt: DataFrame, n_turns: int) -> DataFrame:
    """The nodes of all conversations of ``conv, turns``; ``n_turns``, about how many turns they have, sets the shards."""
    spark, schema = rebuilt.sparkSession, _schema()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], None  # the row that is being read: numbers, sizes, n, conv, digest of its list
        for batch in batches:
            turns = batch.column("turns").to_pylist()
            for row, n, conv, listed in zip(turns, *(batch.column(c).to_pylist() for c in ("n", "conv", "listed")), strict=True):
                numbers = [t["id"] for t in row]
                if held and held[0] == numbers:
                    held[2] += n
                    held[4].update(b",")
                else:
                    if held:
                        rows.append((*held[:4], held[4].hexdigest()))
                    held = [numbers, [t["size"] for t in row], n, conv, hashlib.sha256()]
                held[3] = min(held[3], conv)
                held[4].update(listed.encode())
        if held:
            rows.append((*held[:4], held[4].hexdigest()))
        out = _shard_rows(rows, TaskContext.get().partitionId())
        for at in range(0, len(out), 10_000):
            yield from _table(out[at : at + 10_000], schema).to_batches()

    dealt = members(rebuilt).repartitionByRange(shards, "turns").sortWithinPartitions("turns", "block")
    rounds = [written(dealt.mapInArrow(build, _ROW))]
    while True:
        final = (rounds[-1].agg(F.max("unit")).first()[0] or 0) < MERGED_SHARDS

        run = rounds[-1].where(~F.col("closed")).withColumn("run", F.floor(F.col("unit") / MERGED_SHARDS).cast("long"))
        rounds.append(written(run.groupBy("run").applyInArrow(_merger(final), _ROW)))
        if final:
            break
    return _with_parents(rounds)


def _with_parents(rounds: list[DataFrame]) -> DataFrame:
    """All closed nodes; the least member of a parent that closed in a later round is looked up, shard by shard.

    Nodes that wait for the same parent stand in as many groups as there are shards, so no group is larger than a shard.
    """
    found = rounds[1].where("closed")
    for rows in rounds[2:]:
        found = found.unionByName(rows.where("closed"))
    least = found.select(F.col("key"), F.col("conv").alias("_least"))
    parts = []
    for rows in rounds:
        still = rows.where(~F.col("closed")).select("unit", "key").join(least, "key").select("unit", F.col("key").alias("up"), "_least")
        nodes = rows.where("closed").join(still, ["unit", "up"], "left")
        parts.append(nodes.withColumn("parent_conv", F.coalesce("parent_conv", "_least")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 8,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """A row for each distinct beginning of the conversations: its smallest member, depth, parent, members, children, leaves, savings.

    A conversation starts with the first ``taken`` turns (at most ``most``) of conversation ``base``, columns of ``conv``; by
    default none are taken.  Turns follow their number, null first; equal numbers follow the digest of role and text.  A null role or
    text is empty.  Rows without a conversation id are left out; repeated rows are turns of their own.  An empty table
    has no node.  ``conv`` is an integer column; other columns are not read.

    Texts are never moved, only their digests are.  A member list is hashed as a stream of bounded stretches.  The
    numbers of one conversation's turns are held in one row; texts of any length and groups of any size are not.
    """
    turns = written(numbered_turns(conversations, conv, turn, role, text))
    base = F.col("conv") if base is None else base
    taken = F.lit(0) if taken is None else taken
    return trie(shared_beginnings(turns, base, taken, most), turns.count())
