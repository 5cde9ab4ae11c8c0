"""The trie against plain loops over prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crewmetrics.llm import prefix_trie, queries


def plain(rows, base=lambda c: c, taken=lambda c: 0):
    """Node rows of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(held)] for c, held in own.items()}
    rebuilt = {c: turns.get(base(c), [])[: taken(c)] + held[taken(c) :] for c, held in turns.items()}
    members = defaultdict(list)
    for conv, held in rebuilt.items():
        for d in range(len(held) + 1):
            members[tuple(held[:d])].append(conv)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(
        (
            min(held), len(path), min(members[path[:-1]]) if path else -1, len(held), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(path)).encode()).hexdigest(),
        )
        for path, held in members.items()
    )


def found(nodes):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in nodes.select(names).collect())


def some_rows(n, seed, turns=6, texts=4):
    """Conversations that share many beginnings; one in three is the same."""
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        own = [("user", "hot é"), ("assistant", "same")] if conv % 3 == 0 else [(draw.choice(["user", None]), draw.choice(["", None, "x", "é" * 3][:texts])) for _ in range(draw.randrange(1, turns))]
        rows += [(conv * 7 - 20, turn, *own_turn) for turn, own_turn in enumerate(own)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("shard", "merged", "bits"), [(200_000, 64, 12), (1, 2, 1), (3, 2, 2)])
def test_against_loops(shared, monkeypatch, shard, merged, bits):
    """Many small shards, merged over several rounds, give the same nodes as few large ones."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefix_trie, "MERGED_SHARDS", merged)
    monkeypatch.setattr(prefix_trie, "LIST_BITS", bits)
    rows = some_rows(60, 1)
    assert found(prefix_trie.prefix_trie(shared.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_beginnings_of_other_conversations(shared):
    rows = some_rows(50, 2, turns=9)
    conv, taken = F.col("conv"), lambda c: zlib.crc32(str(c).encode()) % 9
    base = lambda c: c - int(c - 5 * int(c / 5))  # noqa: E731  the sign follows the dividend
    nodes = prefix_trie.prefix_trie(
        shared.createDataFrame(rows, SCHEMA), base=conv - conv % 5, taken=(F.crc32(conv.cast("string").cast("binary")) % 9).cast("int"), most=8,
    )
    assert found(nodes) == plain(rows, base, taken)


def test_odd_rows(shared):
    """Null ids, turns, roles and texts, equal turn numbers, repeated rows, one long conversation, other columns with clashing names."""
    rows = [
        (None, 1, "user", "left out"), (1, None, "user", "first"), (1, 0, None, None), (2, None, "user", "first"), (2, 0, "", ""), (2, 0, "", ""),
        (3, 5, "a", "b"), (3, 5, "b", "a"), (4, 5, "b", "a"), (4, 5, "a", "b"), (-9, 1, "ab", ""), (-8, 1, "a", "b"), *((7, i, "user", f"t{i}") for i in range(3000)),
    ]
    frame = shared.createDataFrame([(*r, "k", 1) for r in rows], f"{SCHEMA}, key string, unit int")
    nodes = found(prefix_trie.prefix_trie(frame))
    # the loop compares prefixes whole: the long conversation is left to a count
    short = [r for r in rows if r[0] != 7]
    assert [n for n in nodes if n[1] and n[0] != 7] == [n for n in plain(short) if n[1]]
    assert [n[1] for n in nodes if n[0] == 7] == list(range(1, 3001))
    root, others = next(n for n in nodes if n[1] == 0), next(n for n in plain(short) if n[1] == 0)
    assert root[3:6] == tuple(x + 1 for x in others[3:6]) and root[6] == others[6]


def test_empty_tables(shared):
    empty = prefix_trie.prefix_trie(shared.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "ends_sha256" in empty.columns
    assert prefix_trie.prefix_trie(shared.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_turnless_conversations(shared):
    """Whoever takes more turns than there are, and has none of its own behind them, ends at the root."""
    rows = [(11, 0, "user", "x"), (12, 0, "user", "x"), (20, 0, "user", "x")]
    nodes = prefix_trie.prefix_trie(shared.createDataFrame(rows, SCHEMA), base=F.col("conv") + 100, taken=F.when(F.col("conv") == 20, 0).otherwise(1))
    assert found(nodes) == plain(rows, lambda c: c + 100, lambda c: 0 if c == 20 else 1)


def test_trees_are_balanced():
    tree = prefix_trie.Tree()
    for i in prefix_trie._medians(1023):
        tree.insert([i], [1], 1, i, "")
    depth = {tree.down[0]: 1}
    for at in range(1, len(tree.id)):
        for side in (tree.low[at], tree.high[at]):
            if side >= 0:
                depth[side] = depth[at] + 1
    assert len(depth) == 1023 and max(depth.values()) == 10


def test_query(shared, folder):
    rows = [tuple(r) for r in shared.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(shared, folder)) == plain(rows, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
