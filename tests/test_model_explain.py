import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crewmetrics.operators import evaluate, explain, model, orders
from crewmetrics.plans import prefix
from crewmetrics.sources import artifacts
from tests.test_plans import plan


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(2.5 * x[:, 0] - 1.5 * x[:, 1] - 1.0)))
    y = (rng.random(n) < p).astype(int)
    rows = [(f"e{i}", "ab"[i % 2], *map(float, x[i]), int(y[i])) for i in range(n)]
    ddl = "employee_id string, grp string, up double, down double, noise double, left_company int"
    return spark.createDataFrame(rows, ddl).cache()


@pytest.fixture(scope="module")
def linear(people):
    return model.train(people, numeric=["up", "down", "noise"])


def test_split_is_exact_and_repeatable(spark, people):
    train, test = model.stratified_split(people, "left_company", "employee_id")
    sizes = {r.left_company: r["count"] for r in people.groupBy("left_company").count().collect()}
    for r in test.groupBy("left_company").count().collect():
        assert r["count"] == round(sizes[r.left_company] * 0.2)
    assert train.join(test, "employee_id").isEmpty() and train.count() + test.count() == 600
    again = model.stratified_split(people.repartition(7), "left_company", "employee_id")[1]
    assert {r.employee_id for r in again.collect()} == {r.employee_id for r in test.collect()}
    rough = model.stratified_split(people, "left_company", "employee_id", exact=False)[1].count()
    assert 80 < rough < 160


def test_linear_model_matches_its_objective(spark, people, linear):
    """The penalised, class-balanced optimum found by Newton steps on the same training rows."""
    train, _ = model.stratified_split(people, "left_company", "employee_id")
    pdf = train.toPandas()
    x, y = pdf[["up", "down", "noise"]].to_numpy(), pdf.left_company.to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    xb, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(4)
    penalty = np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ beta))
        beta -= np.linalg.solve((xb * (w * p * (1 - p))[:, None]).T @ xb + penalty, xb.T @ (w * (p - y)) + penalty @ beta)
    found = linear.pipeline.stages[-1]
    assert [*found.coefficients, found.intercept] == pytest.approx(beta, abs=1e-3)
    assert linear.metrics["auc"] > 0.85
    assert set(linear.metrics["classification_report"]) == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_importance_drivers_explanations(spark, people, linear):
    rows = explain.linear_importance(linear, spark).collect()
    assert [r.feature for r in rows] == ["up", "down", "noise"] and rows[0].coefficient > 0 > rows[1].coefficient
    shuffled = {r.feature: r for r in explain.permutation_importance(linear, people).collect()}
    assert shuffled["up"].importance > shuffled["down"].importance > 0.02 > abs(shuffled["noise"].importance)
    assert shuffled["up"].std >= 0
    other = {r.feature: r.importance for r in explain.permutation_importance(linear, people, seed=7).collect()}
    assert other["up"] == pytest.approx(shuffled["up"].importance, abs=0.05)
    assert {r.importance for r in explain.permutation_importance(linear, people.limit(0)).collect()} == {None}
    told = explain.explain_model(linear, people, ["e1"]).first()
    assert [d.feature for d in told.top_drivers] == ["up", "down", "noise"]
    assert told.top_drivers[0].description == "high up" and told.top_drivers[1].direction == "low"
    by_median = explain.explain_model(linear, people, method="permutation")
    assert by_median.count() == 600
    half = by_median.select(F.expr("filter(top_drivers, d -> d.feature = 'up')[0].direction").alias("d"))
    assert half.where("d = 'high'").count() == 300


def test_predict_some_and_reload(spark, people, linear, tmp_path):
    all_scores = {r.employee_id: r.attrition_risk for r in model.predict(linear, people).collect()}
    assert len(all_scores) == 600 and all(0 <= s <= 1 for s in all_scores.values())
    ids = spark.createDataFrame([("e3",), ("e5",), ("zz",)], "employee_id string")
    some = {r.employee_id: r.attrition_risk for r in model.predict(linear, people, ids).collect()}
    assert some == {k: all_scores[k] for k in ("e3", "e5")}
    assert model.predict(linear, people, []).count() == 600
    artifacts.save_model(linear, str(tmp_path / "m"))
    back = artifacts.load_model(str(tmp_path / "m"))
    assert back.metrics == linear.metrics and back.inputs == linear.inputs
    assert {r.employee_id: r.attrition_risk for r in model.predict(back, people).collect()} == pytest.approx(all_scores)
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(str(tmp_path / "none"))


def test_boosted_and_categorical(spark, people):
    boosted = model.train(people, model.BOOSTED, numeric=["up", "down"], categorical=["grp"], rounds=8, depth=3)
    assert boosted.pipeline.stages[-1].getNumTrees == 8
    assert boosted.metrics["auc"] > 0.8
    assert boosted.vector_names == ["up", "down", "grp=a", "grp=b", "grp=other"]
    assert explain.explain_model(boosted, people, ["e1", "e2"]).count() == 2
    with pytest.raises(ValueError):
        explain.linear_importance(boosted, spark)
    with pytest.raises(ValueError):
        model.train(people, "svm")
    with pytest.raises(ValueError):
        model.train(people.where("left_company = 0"), numeric=["up"])
    with pytest.raises(ValueError):
        model.train(people.drop("left_company"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000, 4096])
def test_permutations_are_one_to_one(n):
    numbers = np.arange(n)
    one, other = orders.permuted(numbers, n, 1), orders.permuted(numbers, n, 2)
    assert sorted(one) == sorted(other) == list(range(n))
    if n > 90:
        assert (one == numbers).mean() < 0.05 and (one == other).mean() < 0.05 and abs(np.corrcoef(numbers, one)[0, 1]) < 0.3
        assert (orders.permuted(numbers[5:9], n, 1) == one[5:9]).all()


def test_numbers_are_dense_and_moves_are_permutations(spark, tmp_path):
    spark.range(1000, numPartitions=7).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    starts, n = orders.split_starts(rows)
    own = {r._number: r.id for r in orders.numbered(rows, starts).collect()}
    assert n == 1000 and sorted(own) == list(range(1000)) and sorted(own.values()) == list(range(1000))
    sent = orders.numbered(rows, starts, moved="_rep", n=n, keys=[5, 6]).collect()
    for rep in (0, 1):
        assert sorted(r._number for r in sent if r._rep == rep) == list(range(1000))
        assert {r.id: r._number for r in sent if r._rep == rep} == {own[i]: int(j) for i, j in enumerate(orders.permuted(np.arange(1000), 1000, 5 + rep))}


def jobs_of(spark, work) -> int:
    """Jobs that ``work`` starts."""
    group = f"g{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_features(spark, people, linear):
    wide = people.select("*", *[(F.col("up") * i).alias(f"f{i}") for i in range(12)])
    one, many = (jobs_of(spark, lambda c=c: evaluate.medians(wide, c)) for c in (["up"], ["up", "down", *[f"f{i}" for i in range(12)]]))
    assert many == one
    broad = model.train(wide, numeric=["up", "down", "noise", *[f"f{i}" for i in range(1, 12)]], evaluate=False)
    assert jobs_of(spark, lambda: explain.permutation_importance(broad, wide)) <= jobs_of(spark, lambda: explain.permutation_importance(linear, people)) + 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, width=64), st.sampled_from([0.0, -0.0, 1.5])), max_size=25))
def test_medians_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v, 1.0, None) for v in values], "a double, b double, c double").repartition(3)
    known = sorted(v for v in values if v is not None)
    low, high = (known[(len(known) - 1) // 2], known[len(known) // 2]) if known else (None, None)
    got = evaluate.medians(df, ["a", "b", "c"])
    assert got["a"] == (low if low == high else (low + high) / 2.0)
    assert got["b"] == (1.0 if values else None) and got["c"] is None


def plain_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=40))
def test_auc_matches_pair_count(spark, rows):
    df = spark.createDataFrame([(float(s), y) for s, y in rows], "s double, y int")
    old, prefix.RANGE_ROWS = prefix.RANGE_ROWS, 2
    try:
        got = evaluate.auc_exact(df, "s", "y").first().auc
        middle = evaluate.medians(df, ["s"])["s"]
    finally:
        prefix.RANGE_ROWS = old
    assert got == (None if plain_auc(*zip(*rows)) is None else pytest.approx(plain_auc(*zip(*rows))))
    assert middle == float(np.median([s for s, _ in rows]))


def test_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 0)], "y int, p int")
    got = {r.name: tuple(r)[1:] for r in evaluate.classification_report(df, "y", "p").collect()}
    assert got["1"] == pytest.approx((1, 0.5, 2 / 3, 2)) and got["0"] == pytest.approx((0.5, 1, 2 / 3, 2))
    assert got["2"] == (0, 0, 0, 1) and got["accuracy"] == pytest.approx((0.6, 0.6, 0.6, 5))
    assert got["macro avg"] == pytest.approx((0.5, 0.5, 4 / 9, 5))
    assert got["weighted avg"][0] == pytest.approx(0.6)


def test_levels(spark):
    df = spark.createDataFrame([(0.71,), (0.70,), (0.30,), (0.31,)], "r double")
    assert [r[0] for r in df.select(explain.risk_level(F.col("r"))).collect()] == ["high", "medium", "low", "medium"]


def test_shuffled_columns_are_not_broadcast(spark, people):
    """A side of the join has every row, so it never goes through the driver, however small its files are."""
    rows = explain.written(people.select("left_company", "up", "down"))
    met, n = explain._meetings(rows, ["up", "down"], [1, 2])
    assert "BroadcastExchange" not in plan(met) and "SortMergeJoin" in plan(met)
    assert n == 600 and met.count() == 1200
    assert sorted(r[0] for r in met.where("_rep = 1").select("_other.up").collect()) == sorted(r.up for r in people.collect())
