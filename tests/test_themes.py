import numpy as np
import pytest
from pyspark.sql import functions as F

from crewmetrics.operators import themes

PLANTED = [["pay", "salary", "bonus", "raise"], ["travel", "flight", "hotel", "trip"], ["code", "review", "deploy", "bug"]]


@pytest.fixture(scope="module")
def surveys(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(PLANTED[i % 3], 12))
        rows.append((i, f"e{i % 10}", text))
    rows += [(90, "e1", None), (91, "e1", "  "), (92, "e2", "unseen")]
    return spark.createDataFrame(rows, "response_id int, employee_id string, free_text string").cache()


def test_planted_themes_are_found(surveys):
    fitted, vecs = themes.fit_themes(surveys, "response_id", n_themes=3)
    assert all(b <= a + 1e-9 for a, b in zip(fitted.losses, fitted.losses[1:]))
    # every vector has length 1, so without themes the error is their number
    assert (fitted.components >= 0).all() and fitted.losses[-1] < 0.6 * vecs.count()
    # the start knows the leading directions: few passes are left
    assert len(fitted.losses) <= 15 and fitted.losses[0] < vecs.count()
    tops = [set(" ".join(t.split(", ")[:4]).split()) for t in fitted.top_terms()]
    for words in PLANTED:
        assert any(len(set(words) & top) >= 3 for top in tops)
    assert all(len(t.split(", ")) == 9 for t in fitted.top_terms())
    scores = {r.response_id: r[1:] for r in fitted.scores(vecs, "response_id").collect()}
    owner = [np.argmax(scores[i]) for i in range(90)]
    assert len({tuple(owner[j::3]) for j in range(3)}) == 3 and all(len(set(owner[j::3])) == 1 for j in range(3))
    assert min(min(s) for s in scores.values()) >= 0
    assert fitted.term_table(surveys.sparkSession).count() == 3


def test_sparse_products(spark):
    rng = np.random.default_rng(2)
    dense = rng.random((40, 12)) * (rng.random((40, 12)) < 0.3)
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in dense]
    batch = spark.createDataFrame(rows, "indices array<int>, weights array<double>").toArrow().combine_chunks().to_batches()[0]
    times, transposed_times, squares = themes._products()
    by_term, by_row = rng.random((12, 3)), rng.random((40, 2))
    assert np.allclose(times(batch, by_term), dense @ by_term) and np.allclose(transposed_times(batch, by_row, 12), by_row.T @ dense)
    assert squares(batch) == pytest.approx((dense**2).sum())


def test_start_spans_the_leading_directions(spark):
    """On a matrix of three non-negative directions the start needs no more than to be scaled."""
    rng = np.random.default_rng(3)
    truth = np.zeros((3, 30))
    for i in range(3):
        truth[i, i * 10 : i * 10 + 10] = rng.random(10)
    dense = np.eye(3)[np.arange(200) % 3] * (rng.random((200, 1)) + 0.5) @ truth
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in dense]
    x = spark.createDataFrame(rows, "indices array<int>, weights array<double>").repartition(3)
    h = themes._start(x, 3, 30, 1)
    assert themes._pass(x, h)[2] < 0.01 * (dense**2).sum()
    assert themes._start(x.limit(2), 5, 30, 1).shape == (5, 30)


def test_fit_is_repeatable(surveys):
    a, _ = themes.fit_themes(surveys, "response_id", n_themes=2, max_iter=5)
    b, _ = themes.fit_themes(surveys.repartition(6), "response_id", n_themes=2, max_iter=5)
    assert np.allclose(a.components, b.components)


def test_scores_by_response(surveys):
    scored = themes.survey_themes(surveys, "response_id", 3, max_iter=5)
    rows = {r.response_id: r for r in scored.collect()}
    assert len(rows) == 93
    for i in (90, 91, 92):
        assert rows[i].theme_1_score == rows[i].theme_2_score == rows[i].theme_3_score == 0.0


def test_limits(spark, surveys):
    with pytest.raises(ValueError):
        themes.fit_themes(surveys, "response_id", n_themes=0)
    few = surveys.where("response_id in (0, 3)")
    assert themes.fit_themes(few, "response_id", n_themes=5, max_iter=2)[0].n_themes == 2
    with pytest.raises(ValueError):
        themes.fit_themes(surveys.where("response_id = 92"), "response_id")


def test_summary_ties_and_missing_team(spark):
    scored = spark.createDataFrame(
        [("a", 0.5, 0.5), ("b", 0.5, None), ("c", 9.0, 9.0)], "employee_id string, theme_1_score double, theme_2_score double"
    )
    people = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None)], "employee_id string, practice string")
    rows = themes.theme_summary(scored, people, 2).collect()
    assert [tuple(r) for r in rows] == [("P", 2, "Topic 1", 0.5, 0.5, 0.5)]
    with pytest.raises(ValueError):
        themes.theme_summary(scored.select("employee_id", F.lit(1.0).alias("theme_1_score")), people, 2)


def test_responses_are_tokenised_once(spark, tmp_path):
    """Each text is read from the given table for one pass only: an accumulator counts the rows that pass."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"alpha beta {'gamma delta' if i % 2 else 'epsilon zeta'} end{i % 3}") for i in range(30)] + [(30, None), (31, " ")]
    spark.createDataFrame(rows, "response_id long, free_text string").write.parquet(str(tmp_path / "r"))
    surveys = spark.read.parquet(str(tmp_path / "r"))
    scored = themes.survey_themes(surveys.mapInArrow(count, surveys.schema), "response_id", 2).orderBy("response_id").collect()
    assert seen.value == len(rows) == len(scored)
    fitted, vecs = themes.fit_themes(surveys, "response_id", n_themes=2)
    plain = {r.response_id: r.theme_1_score for r in fitted.scores(vecs, "response_id").collect()}
    assert all(abs(r.theme_1_score - plain.get(r.response_id, 0.0)) < 1e-9 for r in scored)
