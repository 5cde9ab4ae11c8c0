"""Ranks and scores against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from crewmetrics.llm import queries, ranked_search


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    """(item, rank, doc, score) by item; docs and items are (id, text) rows."""
    held = [(key, Counter(own), len(own)) for key, own in ((key, plain_terms(text)) for key, text in docs) if own]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, own, _ in held for t in own)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, own in asked.items():
        ranked = []
        for key, counts, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in own if counts[t])
            if score > 0:
                ranked.append((-score, key is None, key or 0))
        out += [(item, rank, None if null else key, -score) for rank, (score, null, key) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[:2])


def both(spark, docs, items, k, **options):
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, score string, key string").repartition(3)
    index = ranked_search.build(frame)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    return found(ranked_search.search(index, asked, k=k, **options)), plain(docs, items, k)


def test_against_loops(shared, monkeypatch):
    """Small shards, few ranges at a time and blocks of few items change nothing."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ä", "été", "日本"]
    some = lambda n: " ".join(words[min(int(draw.expovariate(0.08)), 62)] for _ in range(n))
    docs = [(i * 3, some(draw.randrange(0, 60))) for i in range(400)] + [(5000 + i, "w1 w2 w3 w59") for i in range(90)]
    items = [(i, some(draw.randrange(0, 20))) for i in range(30)]
    one, want = both(shared, docs, items, 7)
    assert one == want
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 2000)
    monkeypatch.setattr(ranked_search, "ITEMS", 4)
    assert both(shared, docs, items, 7, block_pairs=40)[0] == want


def test_odd_rows(shared, odd):
    """Null, empty and very long texts, ties among copies, repeated rows, null ids, fewer documents than ranks."""
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(None, "one Two"), (None, "one two"), (6, "one two"), (6, "one two"), (6, None), (-5, "TWO one!")]
    items = [(1, "one, TWO one"), (2, None), (3, ""), (4, "nothing here"), (5, "w1x1 p3 日本"), (5, "x"), (None, "one"), (6, "x x x"), (6, "x x x")]
    for k in (2, 50):
        one, want = both(shared, docs, items, k)
        assert one == want


def test_empty_tables(shared):
    docs = shared.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = shared.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(docs.limit(0)), items).count() == 0
    empty = ranked_search.search(ranked_search.build(docs), items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.build(docs.where("doc_id = 2")).n_docs == 0


def _grid(points, rows, columns):
    """A shard of (row, column, value) points."""
    z = (ranked_search._spread(np.array([p[0] for p in points])) << np.uint64(1)) | ranked_search._spread(np.array([p[1] for p in points]))
    order = np.argsort(z)
    z, v = z[order], np.array([p[2] for p in points], np.uint32)[order]
    places, most = ranked_search.cells(z, v, ranked_search._levels(rows, columns))
    pack = ranked_search._squeezed
    columns_ = {
        "keys": [list(range(columns))], "terms": [ranked_search._listed(pa.array([b"%d" % r for r in range(rows)]))], "points": [pack(z)],
        "impacts": [pack(v)], "cells": [pack(places)], "maxima": [pack(most)],
    }
    return ranked_search.Grid(pa.RecordBatch.from_pydict({c: pa.array(x, pa.list_(pa.int64()) if c == "keys" else pa.binary()) for c, x in columns_.items()}), 0), places


def test_cells_hold_maxima():
    draw = random.Random(4)
    points = [(r, c, draw.randrange(1, 10**6)) for r in range(50) for c in range(70) if draw.random() < 0.1]
    grid, places = _grid(points, 50, 70)
    for level in range(8):
        for row in range(-(-50 >> level) + 1):
            for column in range((70 >> level) + 1):
                inside = [v for r, c, v in points if r >> level == row and c >> level == column]
                place = (ranked_search._spread(np.array([row])) << np.uint64(1)) | ranked_search._spread(np.array([column]))
                assert grid.greatest(np.array([level], np.uint64), place)[0] == max(inside, default=0)
    # a cell with one point is that point
    assert len(places) < len(points) * 2


def test_ranges_that_cannot_win_are_not_opened():
    """One document far above the rest of a long row: most of the row is never looked at."""
    columns = 1 << 12
    points = [(0, c, 10 if c != 77 else 10**6) for c in range(columns)]
    grid, _ = _grid(points, 1, columns)
    ranks = ranked_search.Ranks(1, 1)
    looked = ranked_search.search_grid(grid, np.array([0]), np.array([3]), (np.array([0]), np.array([0])), ranks, ranges=1)
    assert (ranks.score.tolist(), ranks.key.tolist()) == ([3 * 10**6], [77]) and looked < 60


def test_index_is_compressed(shared, documents):
    """The index is no larger than the texts."""
    index = ranked_search.build(documents.repartition(4))
    stored = index.shards.selectExpr("sum(length(terms) + length(points) + length(impacts) + length(cells) + length(maxima))").first()[0]
    assert stored < documents.selectExpr("sum(octet_length(text))").first()[0] * 1.5


def test_query(shared, folder, documents):
    items = [(r.item_id, r.text) for r in shared.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(queries.op13_ranked_search(shared, folder)) == plain(docs, items, 50)
