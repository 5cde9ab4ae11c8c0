"""Near duplicates, components and decontamination against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewmetrics.llm import components, decontaminate, near_dup
from tests.llm import brute


def check_near(table, size, percent=80):
    expected = brute.near([(r.doc_id, r.text) for r in table.collect()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table, size, percent).collect()}
    assert got == expected
    return expected


@pytest.fixture(scope="module")
def copies(shared):
    """Groups of near copies around the threshold, chains and a large group."""
    draw, rows = random.Random(4), []
    for group in range(12):
        base = [f"g{group}w{draw.randrange(200)}" for _ in range(draw.choice((6, 40, 120)))]
        for _ in range(40 if group == 0 else 6):
            own = list(base)
            for _ in range(draw.randrange(0, 4)):
                own[draw.randrange(len(own))] = f"n{draw.randrange(10**6)}"
            rows.append(" ".join(own))
            if draw.random() < 0.3:
                base = own  # a chain
    draw.shuffle(rows)
    return shared.createDataFrame(list(enumerate(rows, 5)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("size", [4, 5, 2])
def test_near_duplicates(shared, documents, odd, copies, size):
    check_near(odd, size)
    found = check_near(copies, size)
    assert len({c for _, c in found.values()}) < len(found)
    if size == 4:
        check_near(documents, size)


def test_blocks_of_a_crowded_key(shared, copies, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 100)
    check_near(copies, 4)


def test_every_pair_within_the_distance_shares_a_key():
    draw = np.random.default_rng(1)
    for errors in range(near_dup.DISTANCE + 1):
        one = draw.integers(0, 2**16, (50, near_dup.SYMBOLS), np.uint16)
        other = one.copy()
        for row in other:
            row[draw.choice(near_dup.SYMBOLS, errors, replace=False)] ^= 1
        shared = (near_dup.index_keys(one) == near_dup.index_keys(other)).any(axis=1)
        assert shared.all()


def test_near_duplicates_of_repeated_and_nameless_rows(shared):
    text = "a b c d e f g"
    table = shared.createDataFrame([(7, text), (7, text), (None, text), (9, text.upper()), (7, "other words here"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(table, 4).collect())
    assert got == sorted([("7", 4, "7", True), ("7", 4, "7", True), ("None", 4, "7", False), ("9", 4, "7", False), ("7", 1, "7", True), ("None", 0, "None", True), ("3", 0, "3", True)])
    assert near_dup.near_duplicates(table.limit(0), 4).collect() == []


def test_deduplicated_keeps_one_of_each_group_and_all_columns(shared, copies):
    table = copies.withColumn("node", F.lit("clash")).withColumn("digest", F.lit(1))
    kept = near_dup.deduplicated(table, 4)
    expected = brute.near([(r.doc_id, r.text) for r in copies.collect()], 4, 80)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()}


def test_components(shared):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (4, None), (100, 101)]
    table = shared.createDataFrame(edges, "a long, b long")
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(table).collect()}
    assert got == {k: find(k) for k in list(root)}
    assert components.components(table.limit(0)).collect() == []


ITEMS = ["the quick brown fox jumps over the lazy dog while seven wizards boil green tea tonight", "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi", "too short"]


def test_leaks_with_substitutions(shared):
    pad = "here is some other text that nobody asked for "
    exact, changed = pad + ITEMS[0] + " " + pad, pad + ITEMS[1].replace("delta", "DELTAS").replace("lamda", "l") + " end"
    broken = pad + " ".join(w if i % 2 else "zz" for i, w in enumerate(ITEMS[1].split()))
    docs = [(1, exact), (2, changed), (3, broken), (4, pad * 30), (5, None), (6, ""), (7, ITEMS[0].upper()), (8, "too short"), (None, exact), (1, exact)]
    table = shared.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, hash string")
    items = shared.createDataFrame([(0, ITEMS[0]), (1, ITEMS[1]), (2, ITEMS[2]), (3, None), (4, ITEMS[1])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(table, items).collect())
    assert got == [(1, 0), (2, 1), (2, 4), (7, 0)]
    rows = decontaminate.contaminated(table, items).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows if r.contaminated} == {1, 2, 7}
    kept = decontaminate.clean(table, items)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "8", "None"]
    assert decontaminate.overlaps(table, items.limit(0)).collect() == [] and decontaminate.contaminated(table.limit(0), items).collect() == []


def _best(a: list, b: list) -> int:
    """The best score of aligned stretches of two texts."""
    top = 0
    for shift in range(-len(b) + 1, len(a)):
        score = 0
        for i in range(max(0, shift), min(len(a), shift + len(b))):
            score = max(0, score + (1 if a[i] == b[i - shift] else decontaminate.OTHER))
            top = max(top, score)
    return top


def test_leaks_against_all_alignments(shared, documents, folder):
    """No document without a stretch of the least score is found, and all with one that holds a seed are."""
    bench = shared.read.parquet(f"{folder}/benchmark.parquet")
    items = {r.item_id: brute.words(brute.lower(r.text)) for r in bench.collect()}
    found = {r.doc_id for r in decontaminate.overlaps(documents, bench).collect()}
    texts = {r.doc_id: brute.words(brute.lower(r.text)) for r in documents.collect()}
    exact = {k for k, w in texts.items() for x in items.values() for i in range(len(x) - 11) if tuple(x[i : i + 12]) in {tuple(w[j : j + 12]) for j in range(len(w) - 11)}}
    assert exact <= found and exact
    for k in found - exact:
        assert max(_best(texts[k], x) for x in items.values()) >= decontaminate.LEAST


def test_masks_find_any_single_substitution():
    draw = np.random.default_rng(0)
    one = draw.integers(0, 2**63, decontaminate.SPAN, np.uint64)
    for i in range(decontaminate.SPAN):
        other = one.copy()
        other[i] ^= np.uint64(1)
        assert any((a == b).all() for a, b in zip(decontaminate.seeds(one), decontaminate.seeds(other)))


def test_cells_of_a_loose_crowd(shared, monkeypatch):
    """Copies of one text that mostly miss the threshold among themselves, over several blocks and cells."""
    draw = random.Random(8)
    base, rows = [f"c{i}" for i in range(60)], []
    for _ in range(90):
        own = list(base)
        for _ in range(draw.randrange(0, 6)):
            own[draw.randrange(len(own))] = f"n{draw.randrange(40)}"
        rows.append(" ".join(own))
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 700)
    found = check_near(shared.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), 4)
    assert 1 < len({c for _, c in found.values()}) < len(rows)


def test_a_column_of_any_name_stays(shared):
    """Columns may have the names that the operator uses inside."""
    docs = shared.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, None, "z", 3)], "doc_id long, text string, _row string, node int")
    kept = near_dup.deduplicated(docs)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", "x", 1), (3, None, "z", 3)] and kept.columns == docs.columns


def loose(n):
    """Texts that are near each other, almost all of them under the threshold."""
    draw, rows = random.Random(n), []
    for i in range(n):
        own = [f"c{j}" for j in range(120)]
        for j in draw.sample(range(120), 6):
            own[j] = f"n{i}x{j}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("groups", [1, 16])
def test_no_table_of_a_loose_crowd_grows_with_its_square(shared, monkeypatch, groups):
    """Sixteen groups' room holds the crowd in one task, one compares it key by key."""
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 2000)
    monkeypatch.setattr(near_dup, "CLUSTER_GROUPS", groups, raising=False)
    write, rows = near_dup.written, {}

    def counted(df, *more):
        table = write(df, *more)
        name = ", ".join(df.columns)
        rows[n][name] = max(rows[n].get(name, 0), table.count())
        return table

    monkeypatch.setattr(near_dup, "written", counted)
    for n in (40, 160):
        rows[n] = {}
        check_near(shared.createDataFrame(loose(n), "doc_id long, text string").repartition(3), 4)
    assert all(many <= 6 * max(rows[40].get(name, 0), 40) for name, many in rows[160].items()), rows
