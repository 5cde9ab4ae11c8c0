"""Attrition models: stratified split, scaling, training, scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.operators.evaluate import auc_exact, classification_report
from crewmetrics.operators.selection import among
from crewmetrics.schemas import require

LINEAR, BOOSTED = "logistic_regression", "boosted_trees"
_ALIASES = {"xgboost": BOOSTED}
MAX_CLASSES = 100


@dataclass
class AttritionModel:
    pipeline: PipelineModel
    kind: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    label: str = "left_company"
    key: str = "employee_id"

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def vector_names(self) -> list[str]:
        """Names of the vector positions; a category becomes ``column=value``."""
        names = list(self.numeric)
        if self.categorical:
            for column, labels in zip(self.categorical, self.pipeline.stages[0].labelsArray):
                names += [f"{column}={value}" for value in labels]
                names.append(f"{column}=other")
        return names


def split_cutoffs(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> dict:
    """Per label the hash below which rows are test rows, so that ``share`` of the label are.

    A histogram over 65,536 hash ranges finds the range that holds the boundary; only that
    range, 1/65,536 of the rows, is ranked.  The split is then a literal filter on the hash:
    exact, repeatable, and without a sort or a shuffle of the data.
    """
    hashed = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("_y"), F.col(key).alias("_k"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h")
    )
    hashed = hashed.withColumn("_b", F.shiftright("_h", 48).cast("int"))
    histogram = hashed.groupBy("_y", "_b").agg(F.count("*").alias("n"))
    running = Window.partitionBy("_y").orderBy("_b")
    whole = Window.partitionBy("_y")
    placed = histogram.select(
        "_y", "_b", "n",
        F.sum("n").over(running).alias("upto"),
        F.round(F.sum("n").over(whole) * F.lit(share)).cast("bigint").alias("want"),
    )
    edge = placed.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    edges = edge.limit(MAX_CLASSES + 1).collect()  # one row per class
    if len(edges) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    if not edges:
        return {}
    at_edge, need = F.lit(False), F.lit(0)
    for e in edges:
        here = (F.col("_y") == F.lit(e["_y"])) & (F.col("_b") == e["_b"])
        at_edge = at_edge | here
        need = F.when(here, e["want"] - (e["upto"] - e["n"])).otherwise(need)
    by_hash = Window.partitionBy("_y").orderBy("_h", "_k")
    ranked = hashed.where(at_edge).withColumn("_r", F.row_number().over(by_hash))
    cut = ranked.where(F.col("_r") == need).select("_y", "_h").collect()
    return {row["_y"]: row["_h"] for row in cut}


def stratified_split(
    df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``share`` of every label in the test part.

    ``exact=False`` skips the two small counting jobs and takes the share by hash threshold.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    if exact:
        in_test = F.lit(False)
        for y, cutoff in split_cutoffs(df, label, key, share, seed).items():
            in_test = F.when(F.col(label) == F.lit(y), h <= cutoff).otherwise(in_test)
    else:
        in_test = F.pmod(h, F.lit(10000)) < int(share * 10000)
    known = df.where(F.col(label).isNotNull())
    return known.where(~in_test), known.where(in_test)


def numeric_columns(df: DataFrame, *leave_out: str) -> list[str]:
    return [
        f.name
        for f in df.schema
        if f.name not in leave_out and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def _class_weight(label: str, counts: dict[int, int], kind: str) -> Column:
    negatives, positives = counts[0], counts[1]
    if kind == LINEAR:  # balanced: n / (classes * n_class)
        total = negatives + positives
        weight = {1: total / (2.0 * positives), 0: total / (2.0 * negatives)}
    else:
        weight = {1: negatives / positives, 0: 1.0}
    return F.when(F.col(label) == 1, weight[1]).otherwise(weight[0])


def train(
    features: DataFrame,
    kind: str = LINEAR,
    *,
    label: str = "left_company",
    key: str = "employee_id",
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    share: float = 0.2,
    seed: int = 42,
    evaluate: bool = True,
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
) -> AttritionModel:
    """Train on a stratified 80 % and measure AUC and the report on the rest.

    The linear model minimises the class-balanced log loss with an L2 term of strength 1 on
    standardised columns: divided by the weight total n, that is ``regParam = 1/n``.  The boosted trees take ``rounds``, ``depth``
    and ``step`` (the usual defaults of gradient boosting libraries).
    """
    kind = _ALIASES.get(kind, kind)
    if kind not in (LINEAR, BOOSTED):
        raise ValueError(f"model kind {kind!r} is not supported")
    require(features, label, key)
    categorical = categorical or []
    numeric = numeric or numeric_columns(features, label, key)
    data = features.select(key, *numeric, *categorical, F.col(label).cast("double").alias(label))
    # split, class counts, scaling, fitting and measuring all read these narrow rows
    data = data.where(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _train(data, kind, label, key, numeric, categorical, share, seed, evaluate, {"maxIter": rounds, "maxDepth": depth, "stepSize": step})
    finally:
        data.unpersist()


def _train(data, kind, label, key, numeric, categorical, share, seed, evaluate, boosting) -> AttritionModel:
    train_part, test_part = stratified_split(data, label, key, share, seed)
    counts = {int(r[0]): r[1] for r in train_part.groupBy(label).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"training needs both classes of {label}; found {sorted(counts)}")
    weighted = train_part.withColumn("_weight", _class_weight(label, counts, kind))

    stages, inputs = [], list(numeric)
    if categorical:
        indexed, encoded = [f"_i_{c}" for c in categorical], [f"_e_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False))
        inputs += encoded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
    shared = {"featuresCol": "_scaled", "labelCol": label, "weightCol": "_weight"}
    if kind == LINEAR:
        stages.append(
            LogisticRegression(
                **shared, regParam=1.0 / sum(counts.values()), elasticNetParam=0.0, standardization=False, maxIter=1000
            )
        )
    else:
        stages.append(GBTClassifier(**shared, seed=seed, **boosting))
    model = AttritionModel(Pipeline(stages=stages).fit(weighted), kind, numeric, categorical, {}, label, key)
    if evaluate:
        tested = scored(model, test_part).select(label, "prediction", "attrition_risk")
        tested = tested.persist(StorageLevel.MEMORY_AND_DISK)
        report = classification_report(tested, label, "prediction").collect()  # one row per class + 3
        model.metrics = {
            "auc": auc_exact(tested, "attrition_risk", label).first()[0],
            "classification_report": {r["name"]: r.asDict() for r in report},
        }
        tested.unpersist()
    return model


def scored(model: AttritionModel, df: DataFrame) -> DataFrame:
    """``df`` with the model's columns and ``attrition_risk``."""
    return model.pipeline.transform(df).withColumn("attrition_risk", vector_to_array("probability")[1])


def predict(model: AttritionModel, features: DataFrame, ids: DataFrame | list | None = None) -> DataFrame:
    """(key, attrition_risk) for all people or the listed ones."""
    chosen = among(features, model.key, ids).select(model.key, *model.inputs)
    return scored(model, chosen).select(model.key, "attrition_risk")
