"""The attention model learns from every training id, whatever the partitions."""

import numpy as np
import pytest

from crewmetrics.llm import lm_scoring, quality, queries


def test_every_training_id_is_predicted(shared, documents, monkeypatch):
    predicted = []

    def counted(vectors, kind):
        out = sums(vectors, kind)
        if kind == np.dtype(float) and out is not None:
            predicted.append(out[0])
        return out

    sums = lm_scoring._vector_sums
    monkeypatch.setattr(lm_scoring, "_vector_sums", counted)
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 2000)
    rows = lm_scoring.score(documents, queries.TOKENIZER).collect()
    assert len(predicted) == lm_scoring.ROUNDS and sum(predicted) == sum(r.n_ids for r in rows if not r.held_out)


def test_scores_do_not_hang_on_partitions(shared, documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 2000)
    first, second = ({r.doc_id: r.score for r in lm_scoring.score(documents.repartition(n), queries.TOKENIZER).collect()} for n in (1, 5))
    assert first.keys() == second.keys() and all(first[k] == pytest.approx(second[k], rel=1e-4) for k in first)


def test_all_labelled_rows_set_ranges_and_threshold(shared, monkeypatch):
    """Trees draw from all good rows, and the threshold is that of plain loops over all labelled rows, however they are dealt."""
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(["word%d" % x for x in rng.integers(0, 400, 40)]) + (" # # #" * 9 if i % 7 == 0 else "")) for i in range(700)]
    docs = shared.createDataFrame(texts, "doc_id long, text string")
    labels = shared.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "TREES", 20)
    seen = []
    made = quality.fit_forest
    monkeypatch.setattr(quality, "fit_forest", lambda drawn, scale: seen.append((drawn, scale)) or made(drawn, scale))
    one, other = (quality.fit(docs.repartition(n), labels) for n in (1, 6))
    assert one.threshold == other.threshold and (one.cut == other.cut).all()
    drawn, scale = seen[0]
    counts = quality.statistics(docs).toPandas().sort_values("doc_id")
    x, good = quality.features({c: counts[c].to_numpy() for c in quality.COUNTS}), np.arange(700) % 7 > 0
    assert [len(d) for d in drawn] == [quality.TREE_ROWS] * 20
    assert {r.tobytes() for d in drawn for r in d} == {r.tobytes() for r in x[good]}
    assert scale == pytest.approx(np.ptp(x, axis=0))
    scores = one.scores(x)
    gains = [((scores[~good] >= c).mean() - (scores[good] >= c).mean(), -c) for c in scores if (scores[good] >= c).mean() <= quality.LOSS]
    cut = -max(gains)[1]
    assert one.threshold == pytest.approx((cut + scores[scores < cut].max()) / 2)


def test_counts_keep_their_value_in_few_bytes():
    for values in ([], [0, 255], [256, 1], [2**16], [2**32, 7]):
        data = lm_scoring._narrow(np.array(values, np.uint64))
        assert lm_scoring._wide(data).tolist() == values and len(data) <= 1 + 8 * len(values)
    assert len(lm_scoring._narrow(np.ones(100, np.uint64))) == 101
