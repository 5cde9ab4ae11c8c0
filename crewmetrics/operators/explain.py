"""Why a score is high: importances, drivers per person, risk levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.operators.evaluate import medians as exact_medians
from crewmetrics.operators.model import LINEAR, AttritionModel, scored
from crewmetrics.operators.orders import numbered, split_starts
from crewmetrics.operators.selection import among
from crewmetrics.plans.scratch import written


def linear_importance(model: AttritionModel, spark) -> DataFrame:
    """(feature, importance, coefficient), largest absolute coefficient first."""
    if model.kind != LINEAR:
        raise ValueError("coefficients exist for the linear model only")
    coefficients = model.pipeline.stages[-1].coefficients.toArray().tolist()
    rows = [(name, abs(c), c) for name, c in zip(model.vector_names, coefficients)]
    table = spark.createDataFrame(rows, "feature string, importance double, coefficient double")
    return table.orderBy(F.col("importance").desc(), "feature")


def permutation_importance(model: AttritionModel, features: DataFrame, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, std): mean and deviation of the accuracy lost when a column is shuffled.

    Key, label and inputs are written once as a narrow table, whose rows get dense numbers.  In each repeat a keyed one-to-one
    map of the numbers sends the inputs of every row to another row (``orders.permuted``), without a sort, so a column is
    shuffled over all rows.  Rows and what they were sent meet by number in one join; the accuracies of all features,
    all repeats and the unchanged rows come from one pass over the model, however many features there are.
    """
    label, inputs = model.label, model.inputs
    rows = written(features.where(F.col(label).isNotNull()).select(label, *inputs))
    met, n = _meetings(rows, inputs, [seed * 1_000_003 + repeat for repeat in range(repeats)])
    shuffled = met.withColumn("_f", F.explode(F.array(*[F.lit(name) for name in inputs]))).select(
        "_rep", "_f", label, *[F.when(F.col("_f") == c, F.col("_other")[c]).otherwise(F.col(c)).alias(c) for c in inputs],
    )
    unchanged = rows.select(F.lit(-1).alias("_rep"), F.lit("").alias("_f"), label, *inputs)
    right = F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a")
    # a row for each feature and repeat, and one more
    found = model.pipeline.transform(shuffled.unionByName(unchanged)).groupBy("_f", "_rep").agg(right).collect()
    accuracy = {(r["_f"], r["_rep"]): r.a for r in found}
    out = []
    for name in inputs:
        lost = [accuracy["", -1] - accuracy[name, r] for r in range(repeats)] if n else []
        out.append((name, float(np.mean(lost)) if lost else None, float(np.std(lost)) if lost else None))
    table = features.sparkSession.createDataFrame(out, "feature string, importance double, std double")
    return table.orderBy(F.col("importance").desc(), "feature")


def _meetings(rows: DataFrame, inputs: list[str], keys: list[int]) -> tuple[DataFrame, int]:
    """The rows of a written table, each once for every key beside the inputs sent to it (``_rep``, ``_other``), and their number."""
    starts, n = split_starts(rows)
    sent = numbered(rows.select(*inputs), starts, moved="_rep", n=n, keys=keys).select("_number", "_rep", F.struct(*inputs).alias("_other"))
    # both sides are as long as the data, whose files can be small enough for Spark to send a side through the driver to all tasks
    return numbered(rows, starts).join(sent.hint("merge"), "_number"), n


def top_features(importance: list[dict], n: int = 5) -> list[dict]:
    return sorted(importance, key=lambda row: (-row["importance"], row["feature"]))[:n]


def driver_array(
    features: DataFrame, importance: list[dict], n: int = 5, medians: dict[str, float] | None = None
) -> Column:
    """For each person the ``n`` most important features with value, direction and words.

    ``importance`` is a list of rows ``feature``, ``importance`` and, for a linear model,
    ``coefficient``: its sign is the direction.  Without coefficients a value above the median is
    high.  The list is no longer than the feature list, so it becomes part of the projection.
    """
    top = top_features(importance, n)
    undirected = [row["feature"] for row in top if row.get("coefficient") is None]
    if undirected and medians is None:
        medians = exact_medians(features, undirected)
    entries = []
    for row in top:
        name = row["feature"]
        value = F.col(name).cast("double")
        if row.get("coefficient") is not None:
            direction = F.lit("high" if row["coefficient"] > 0 else "low")
        else:
            direction = F.when(value > F.lit(medians[name]), "high").otherwise("low")
        entries.append(
            F.struct(
                F.lit(name).alias("feature"),
                value.alias("value"),
                direction.alias("direction"),
                F.concat(direction, F.lit(" " + name.replace("_", " "))).alias("description"),
            )
        )
    return F.array(*entries)


def risk_level(risk: Column) -> Column:
    """high above 0.7, medium above 0.3, else low."""
    return F.when(risk > 0.7, "high").when(risk > 0.3, "medium").otherwise("low")


def explain(
    people: DataFrame,
    importance: list[dict],
    key: str = "employee_id",
    shown: int = 3,
    medians: dict[str, float] | None = None,
) -> DataFrame:
    """(key, attrition_risk, risk_level, top_drivers) of rows that hold their score and features."""
    return people.select(
        key,
        "attrition_risk",
        risk_level(F.col("attrition_risk")).alias("risk_level"),
        F.slice(driver_array(people, importance, medians=medians), 1, shown).alias("top_drivers"),
    )


def explain_model(
    model: AttritionModel, features: DataFrame, ids: DataFrame | list | None = None, method: str = "auto"
) -> DataFrame:
    """Explanations from a trained model; ``method`` is ``lr``, ``permutation`` or ``auto``.

    Medians are those of all people, also when only some are explained.
    """
    if method == "auto":
        method = "lr" if model.kind == LINEAR else "permutation"
    linear = method == "lr" and model.kind == LINEAR
    table = linear_importance(model, features.sparkSession) if linear else permutation_importance(model, features)
    # as many rows as the model has inputs; a driver has a number as its value
    importance = [row.asDict() for row in table.collect() if row["feature"] in model.numeric]
    medians = None if linear else exact_medians(features, [row["feature"] for row in top_features(importance)])
    chosen = among(features, model.key, ids).select(model.key, *model.inputs)
    return explain(scored(model, chosen), importance, model.key, medians=medians)
