"""Exact search by pivots and approximate search by buckets, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewmetrics.operators import buckets, knn as nn
from crewmetrics.plans import blocks
from crewmetrics.sources import artifacts


def vectors(spark, matrix, start=0, name="vec_id"):
    rows = [(start + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(5)


def brute(corpus, queries, k, metric):
    out = {}
    for qi, q in enumerate(queries):
        if metric == "l2":
            score = ((corpus - q) ** 2).sum(axis=1)
            order = np.lexsort((np.arange(len(corpus)), score))
        else:
            length = np.linalg.norm(corpus, axis=1) * np.linalg.norm(q)
            score = np.round(np.divide(corpus @ q, length, out=np.zeros(len(corpus)), where=length > 0), 9)
            order = np.lexsort((np.arange(len(corpus)), -score))
        out[qi] = [(int(i), pytest.approx(float(score[i]), abs=1e-8)) for i in order[:k]]
    return out


def as_dict(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 6))
    corpus[100:200] = corpus[7]  # a third of the corpus are copies
    corpus[250] = 0.0
    queries = np.vstack([rng.normal(size=(8, 6)), corpus[7], np.zeros(6)])
    return corpus, queries


def small_groups(monkeypatch):
    monkeypatch.setattr(nn, "GROUP_QUERIES", 4)
    monkeypatch.setattr(nn, "GROUP_ROWS", 30)
    monkeypatch.setattr(nn, "BATCH_ROWS", 16)
    monkeypatch.setattr(nn, "BATCH_QUERIES", 3)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("partition_rows", [10_000, 20])
def test_knn_is_exact(spark, data, metric, partition_rows, monkeypatch):
    """In one partition, and in fifteen of which one holds the copies, cut into groups of 30 rows."""
    corpus, queries = data
    if partition_rows == 20:
        small_groups(monkeypatch)
    hits = nn.knn(
        vectors(spark, corpus), vectors(spark, queries, name="query_id"), key=["vec_id"], k=5, metric=metric, partition_rows=partition_rows,
    )
    assert as_dict(hits) == brute(corpus, queries, 5, metric)


def test_knn_small_corpus_and_arguments(spark, data):
    corpus, queries = data
    q = vectors(spark, queries, name="query_id")
    hits = nn.knn(vectors(spark, corpus[:3]), q, key=["vec_id"], k=5, metric="l2")
    assert hits.groupBy("query_id").count().where("count != 3").isEmpty()
    assert nn.knn(vectors(spark, corpus), q.limit(0), key=["vec_id"], k=5).isEmpty()
    nearer = nn.with_similarity(hits).where("rank = 1").first()
    assert 0 < nearer.score <= 1
    with pytest.raises(ValueError):
        nn.knn(q, q, key=["query_id"], metric="dot")


def test_rows_without_a_vector_are_left_out(spark, data):
    corpus, queries = data
    c = vectors(spark, corpus[:30]).unionByName(spark.createDataFrame([(900, None)], "vec_id long, vector array<double>"))
    q = vectors(spark, queries[:2], name="query_id").unionByName(spark.createDataFrame([(900, None)], "query_id long, vector array<double>"))
    assert as_dict(nn.knn(c, q, key=["vec_id"], k=3, metric="l2")) == brute(corpus[:30], queries[:2], 3, "l2")
    found = buckets.search(buckets.build(c, key=["vec_id"], bits=2), q, k=3)
    assert sorted(as_dict(found)) == [0, 1]


def clustered(seed=9, clusters=12, each=80, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=10.0, size=(clusters, dim))
    return np.vstack([c + rng.normal(scale=0.3, size=(each, dim)) for c in centres])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_far_partitions_are_not_compared(spark, metric):
    """On clustered vectors the queries visit few of the partitions, and find what all pairs find."""
    corpus = clustered()
    queries = corpus[::16] + 0.01
    c, q = vectors(spark, corpus), vectors(spark, queries, name="query_id")
    assert as_dict(nn.knn(c, q, key=["vec_id"], k=4, metric=metric, partition_rows=40)) == brute(corpus, queries, 4, metric)
    corpus_, queries_, dim = nn.checked(c, q, ["vec_id"], "query_id", metric, None)
    split = nn.partitions(corpus_, ["vec_id"], metric, dim, 40)
    size = dict(zip(split.numbers.tolist(), split.counts.tolist(), strict=True))
    first = split.visits(queries_, 4).collect()
    exact = {i: max(s if metric == "l2" else 2 - 2 * s for _, s in hits) ** 0.5 for i, hits in as_dict(nn.knn(c, q, key=["vec_id"], k=4, metric=metric)).items()}
    reach = spark.createDataFrame(list(exact.items()), "query_id long, _reach double")
    rest = split.visits(queries_.join(reach, "query_id"), 4, "_reach").collect()
    pairs = sum(size[r._p] for r in first + rest)
    assert len(split.numbers) > 15 and pairs < 0.35 * len(corpus) * len(queries)
    assert not {(r.query_id, r._p) for r in first} & {(r.query_id, r._p) for r in rest}


def test_groups_stay_small(spark, data, monkeypatch):
    """A partition with a third of the rows and queries that all want it meet in groups of bounded size."""
    small_groups(monkeypatch)
    rows = spark.createDataFrame([(i, 1 if i < 200 else i) for i in range(300)], "vec_id long, _p int")
    asked = spark.createDataFrame([(i, 1 + (i > 90)) for i in range(100)], "query_id long, _p int")
    left, right = nn.meet(rows, asked, ["_p"], ["vec_id"], ["query_id"], nn.GROUP_ROWS, nn.GROUP_QUERIES)
    on = ["_p", "_l", "_r"]
    assert left.groupBy(on).count().agg(F.max("count")).first()[0] < 60 and right.groupBy(on).count().agg(F.max("count")).first()[0] < 14
    pairs = left.join(right, on).select("vec_id", "query_id")
    assert pairs.count() == pairs.distinct().count() == 200 * 91


def test_approximate_search_always_finds_k(spark, data):
    """With buckets of one row or none, short queries look further and are then compared exactly."""
    corpus, queries = data
    c, q = vectors(spark, corpus), vectors(spark, queries, name="query_id")
    for metric in ("l2", "cosine"):
        index = buckets.build(c, key=["vec_id"], metric=metric, tables=1, bits=12)
        hits = as_dict(buckets.search(index, q, k=7, visits=1))
        want = brute(corpus, queries, 300, metric)
        assert {i: len(h) for i, h in hits.items()} == {i: 7 for i in range(len(queries))}
        for i, found in hits.items():
            assert len({v for v, _ in found}) == 7
            assert all(dict(want[i])[v] == s for v, s in found)
    small = buckets.search(buckets.build(vectors(spark, corpus[:3]), key=["vec_id"], bits=4), q, k=7, visits=1)
    assert {len(h) for h in as_dict(small).values()} == {3}
    assert buckets.search(index, q.limit(0), k=7).isEmpty() and buckets.search(buckets.build(c.limit(0), key=["vec_id"], dim=6), q, k=7).isEmpty()


def test_approximate_search_prunes_and_finds(spark):
    corpus = clustered()
    queries = corpus[::24] + 0.01
    c, q = vectors(spark, corpus), vectors(spark, queries, name="query_id")
    index = buckets.build(c, key=["vec_id"], tables=4, bits=8)
    near, exact = as_dict(buckets.search(index, q, k=4, visits=4)), as_dict(nn.knn(c, q, key=["vec_id"], k=4, metric="l2"))
    recall = sum(len({v for v, _ in near[i]} & {v for v, _ in exact[i]}) for i in exact) / (4 * len(queries))
    assert recall >= 0.9
    assert buckets.compared(index, q, visits=4).first().pairs < 0.4 * len(corpus) * len(queries) * index.tables


def test_saved_buckets_give_the_same_hits(spark, data, tmp_path):
    corpus, queries = data
    q = vectors(spark, queries, name="query_id")
    index = buckets.build(vectors(spark, corpus), key=["vec_id"], bits=4)
    artifacts.save_buckets(index, str(tmp_path / "b"))
    saved = artifacts.load_buckets(spark, str(tmp_path / "b"))
    assert as_dict(buckets.search(saved, q, k=3)) == as_dict(buckets.search(index, q, k=3))
    with pytest.raises(FileNotFoundError):
        artifacts.load_buckets(spark, str(tmp_path / "none"))


def test_cheapest_flips_come_first():
    rng = np.random.default_rng(1)
    for _ in range(20):
        costs = rng.random(6)
        total = lambda f: sum(c for i, c in enumerate(costs) if f >> i & 1)
        found = buckets.nearest_flips(costs, 64)
        assert sorted(found) == list(range(64)) and all(total(a) <= total(b) + 1e-12 for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_query_goes_once_to_a_region(spark, metric, monkeypatch):
    """Without structure all partitions are in reach: a query is copied for each region of them, in its own precision, and finds the same."""
    corpus = np.random.default_rng(4).normal(size=(600, 24)).astype(np.float32)
    c = vectors(spark, corpus).withColumn("vector", F.col("vector").cast("array<float>"))
    moved = []
    monkeypatch.setattr(nn, "GROUP_ROWS", 200)
    monkeypatch.setattr(nn, "meet", lambda left, right, *rest: moved.append(right) or blocks.meet(left, right, *rest))
    hits = nn.knn(c, c.withColumnRenamed("vec_id", "query_id"), key=["vec_id"], k=3, metric=metric, partition_rows=20)
    assert as_dict(hits) == brute(corpus.astype(float), corpus.astype(float), 3, metric)
    assert [m.schema["vector"].dataType.elementType.simpleString() for m in moved] == ["float"] * 2
    assert moved[1].groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_rows_are_found_in_single_precision(metric, monkeypatch):
    """Far from the origin, huge, tiny and with copies: which rows are near is seen in single precision, scores are exact; bounds leave rows out."""
    import pyarrow as pa

    monkeypatch.setattr(nn, "BATCH_ROWS", 90)
    monkeypatch.setattr(nn, "BATCH_QUERIES", 7)
    monkeypatch.setattr(nn, "EXACT_NUMBERS", 100)
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(400, 6))
    plain[50:120] = plain[3]
    for corpus in (plain, plain * 1e25, plain * 1e-25, 1e6 + plain * 1e-3 if metric == "l2" else plain):
        table = pa.table({"vec_id": np.arange(400), "vector": corpus.tolist()})
        best, to_matrix = nn.scorer(3, metric, ["vec_id"], 6)
        queries = corpus[::20] * 1.0001
        found = best(list(range(20)), queries, table.to_batches(70))
        want = brute(corpus, queries, 3, metric)
        got = {i: g["vec_id"].tolist() for i, g in found.groupby("query_id")}
        assert got == {i: [v for v, _ in w] for i, w in want.items()}
        score = found["score"].to_numpy().reshape(20, 3)
        bounded = best(list(range(20)), queries, table.to_batches(), (score if metric == "l2" else -score)[:, 1])
        assert {i: g["vec_id"].tolist()[:2] for i, g in bounded.groupby("query_id")} == {i: v[:2] for i, v in got.items()}
        if corpus is plain:
            assert len(best([0], queries[:1], table.to_batches(), np.array([-2.0]))) == 0


def test_second_visits_are_bounded(spark, monkeypatch):
    """What the first partitions give bounds the scores of the second visits, which send fewer rows on than k for each region."""
    corpus = np.random.default_rng(6).normal(size=(600, 8))
    c = vectors(spark, corpus)
    sent, scored = [], nn.scored
    monkeypatch.setattr(nn, "GROUP_ROWS", 60)
    monkeypatch.setattr(nn, "scored", lambda *args: sent.append(scored(*args)) or sent[-1])
    hits = nn.knn(c, c.withColumnRenamed("vec_id", "query_id"), key=["vec_id"], k=3, metric="l2", partition_rows=200)
    assert as_dict(hits) == brute(corpus, corpus, 3, "l2")
    # without bounds 3 for each of ten groups or more
    assert sent[1].count() < 600 * 3 * 7


def test_relevant_rows_are_made_once(spark):
    from crewmetrics.operators import evaluate
    from tests.test_plans import plan

    c = vectors(spark, np.random.default_rng(7).normal(size=(30, 4)))
    asked = c.withColumnRenamed("vec_id", "query_id")
    hits = nn.knn(c, asked, key=["vec_id"], k=4, metric="l2")
    relevant = nn.knn(c, asked, key=["vec_id"], k=2).where("rank = 2")
    made = evaluate.hit_at_k(hits, relevant, ["vec_id"], 4)
    # a plan names each twice, in the tree and below it
    assert plan(made).count("FlatMapCoGroupsInArrow") == 4
    assert made.first().queries == 30
