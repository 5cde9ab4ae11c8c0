"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query writes its whole result to the no-op sink.  A second section times the work the
question against a saved index.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from crewmetrics.operators import features, model, retrieval, sentiment  # noqa: E402
from crewmetrics.session import RECOMMENDED_CONF  # noqa: E402
from crewmetrics.sources import artifacts  # noqa: E402
from verification import adapters as a  # noqa: E402
from verification.queries import BY_NAME  # noqa: E402

HEADLINE = [
    "employee_features", "team_risk", "risk_rollup", "batch_team_risk", "next_steps", "upsert_next_steps", "internal_moves",
    "lexicon_sentiment", "weighted_sentiment", "team_sentiment", "tfidf_terms", "theme_summary", "themes_nmf", "auc_exact",
    "classification_report", "attrition_scores", "permutation_importance", "explain_levels", "chunks", "knn_l2", "knn_cosine",
    "sparse_retrieval", "ask", "career_plan", "skill_demand", "knn_approximate", "explained_people", "parsed_replies", "pto_spike", "monthly_sentiment",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    drain(spark.read.parquet(f"{folder}/lineitem.parquet"))
    a.table(spark, folder, "customer").limit(10).toArrow()

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        times[name] = round(time.time() - start, 3)

    for name in HEADLINE:
        timed(name, lambda: drain(BY_NAME[name](spark, folder)))
        spark.catalog.clearCache()

    people = features.employee_features(
        a.employees(spark, folder), a.skills(spark, folder), as_of=a.AS_OF, timesheets=a.timesheets(spark, folder),
        history=a.role_history(spark, folder), requirements=a.REQUIREMENTS, history_tie="o_orderkey",
    ).drop("role", "practice").cache()
    rows = people.count()
    held = {}
    timed("train_linear", lambda: held.update(model=model.train(people)))
    timed("score_all", lambda: drain(model.predict(held["model"], people)))
    timed("score_one", lambda: model.predict(held["model"], people, ["7"]).collect())
    timed("sentiment_all", lambda: drain(sentiment.lexicon_sentiment(a.surveys(spark, folder)).select("response_id", "sentiment_score")))
    path = tempfile.mkdtemp(prefix="bench-index-")
    timed("index_build", lambda: held.update(index=artifacts.build_and_save(a.policies(spark, folder), path)))
    question = spark.createDataFrame([(1, "what is the policy for and of the leave")], "query_id bigint, question string")

    def ask() -> None:
        hits = retrieval.retrieve(question, held["index"])
        retrieval.prompts(question, retrieval.contexts(hits, held["index"].chunks)).collect()

    ask()
    timed("ask_one", ask)
    sizes = {
        "employees": rows, "documents": a.table(spark, folder, "documents").count(), "auc": held["model"].metrics["auc"],
        "chunks": held["index"].chunks.agg(F.count("*")).first()[0],
    }
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1], "sizes": sizes}))


if __name__ == "__main__":
    main()
