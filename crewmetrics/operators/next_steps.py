"""Next-step records for every person, their prompts, model replies, saved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.plans.constants import bind
from crewmetrics.schemas import has

#: fields of a reply that have a type
REPLY = {
    "employee_id": "string", "attrition_risk": "double", "recommendations": "array<string>", "owner": "string", "suggested_check_in_weeks": "int",
}


def weakest_skills(skills: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` lowest skills per employee (ties by name) as an array.

    The rank limit is applied before the shuffle as well, so a long skill list is cut on the
    map side.
    """
    by_level = Window.partitionBy("employee_id").orderBy(F.col("level").asc_nulls_last(), "skill")
    low = skills.where(F.col("employee_id").isNotNull()).withColumn("_r", F.row_number().over(by_level))
    picked = low.where(F.col("_r") <= n).groupBy("employee_id")
    return picked.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "skill"))), lambda s: s["skill"]).alias("weak_skills")
    )


def _recommendations(weak: Column) -> Column:
    texts = []
    for template in ref.NEXT_STEP_RECOMMENDATIONS:
        head, mark, tail = template.partition("{weak_skills}")
        texts.append(F.concat(F.lit(head), weak, F.lit(tail)) if mark else F.lit(template))
    return F.array(*texts)


def person_prompts(people: DataFrame, skills: DataFrame) -> DataFrame:
    """One prompt per person from the risk profile and the skills, highest level first.

    Equal skill rows are counted before they are gathered, so the shuffle carries each
    (employee, skill, level) once.
    """
    counted = (
        skills.where(F.col("employee_id").isNotNull())
        .groupBy("employee_id", "skill", "level")
        .agg(F.count("*").cast("int").alias("copies"))
    )
    level = F.col("level")
    shown = F.when(level == F.floor(level), level.cast("bigint").cast("string")).otherwise(level.cast("string"))
    shown = F.coalesce(shown, F.lit("nan"))
    entry = F.format_string("{'skill': '%s', 'level': %s}", F.col("skill"), shown)
    highest_first = F.struct(level.isNull().alias("last"), (-level).alias("o"), "skill", entry.alias("e"), "copies")
    listed = counted.groupBy("employee_id").agg(F.sort_array(F.collect_list(highest_first)).alias("_l"))
    entries = F.flatten(F.transform("_l", lambda s: F.array_repeat(s["e"], s["copies"])))
    listed = listed.select("employee_id", F.array_join(entries, ", ").alias("_skills"))
    joined = people.join(listed, "employee_id", "left")

    def digits(name: str, n: int) -> Column:
        # the formatter rounds half up; half-even is wanted
        even = F.rint(F.col(name).cast("double") * 10.0**n) / 10.0**n
        return F.format_string(f"%.{n}f", even)

    prompt = F.format_string(
        ref.PERSON_PROMPT,
        F.col("employee_id"), F.col("practice"), F.col("tenure_weeks").cast("string"),
        digits("avg_hours_wk", 1), digits("pto_rate", 3), digits("avg_rating", 1),
        digits("workload_ratio", 2), digits("risk", 3),
        F.col("top_driver_1"), F.col("top_driver_2"), F.col("top_driver_3"),
        F.concat(F.lit("["), F.coalesce("_skills", F.lit("")), F.lit("]")),
    )
    return joined.select("employee_id", prompt.alias("prompt"))


def parse_reply(reply: Column) -> Column:
    """The reply as a struct, or null where it is not a JSON object (a name twice makes it none).

    Each field is read by itself: one that is missing or of another type is null and spoils no other.  ``other_fields`` holds
    what has no typed field, and the fields that did not fit their type, as they came (map<string,variant>).
    """

    def read(parsed: Column) -> Column:
        fields = [F.try_variant_get(parsed, f"$.{name}", kind).alias(name) for name, kind in REPLY.items()]
        whole = F.try_variant_get(parsed, "$", "map<string,variant>")

        def other(name: Column, value: Column) -> Column:
            unread = F.lit(False)
            for known, kind in REPLY.items():
                misfit = F.try_variant_get(parsed, f"$.{known}", kind).isNull() & ~F.is_variant_null(value)
                unread = unread | ((name == known) & misfit)
            return unread | ~name.isin(list(REPLY))

        return F.when(whole.isNotNull(), F.struct(*fields, F.map_filter(whole, other).alias("other_fields")))

    return bind(F.try_parse_json(reply), read)


def next_steps(people: DataFrame, skills: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """One record per person.

    ``replies`` (employee_id, response), if given, holds a model's answers: a JSON object
    supplies the fields and, as ``other_fields``, all that it says beside them; any other text is kept as
    ``model_response``, and a person without an answer gets the rule-based steps.
    """
    joined = people.join(weakest_skills(skills), "employee_id", "left")
    rules = _recommendations(F.coalesce(F.array_join("weak_skills", ", "), F.lit("")))
    own_risk = F.bround("risk", 3)
    if replies is None:
        answer = {
            "attrition_risk": own_risk, "recommendations": rules, "owner": F.lit("manager"),
            "suggested_check_in_weeks": F.lit(6), "model_response": F.lit(None).cast("string"),
            "other_fields": F.lit(None).cast("map<string,variant>"),
        }
    else:
        joined = joined.join(replies.select("employee_id", "response"), "employee_id", "left")
        joined = joined.withColumn("_reply", parse_reply(F.col("response")))
        silent = F.coalesce(F.col("response"), F.lit("")) == ""
        reply = F.col("_reply")
        answer = {
            "attrition_risk": F.coalesce(reply["attrition_risk"], own_risk),
            "recommendations": F.when(silent, rules).otherwise(reply["recommendations"]),
            "owner": F.coalesce(reply["owner"], F.lit("manager")),
            "suggested_check_in_weeks": F.coalesce(reply["suggested_check_in_weeks"], F.lit(6)),
            "model_response": F.when(~silent & reply.isNull(), F.col("response")),
            "other_fields": reply["other_fields"],
        }
    return joined.select(
        "employee_id",
        *[column.alias(name) for name, column in answer.items()],
        "practice",
        F.col("tenure_weeks").cast("double").alias("tenure_weeks"),
        F.col("avg_hours_wk").alias("avg_hours_last_12w"),
        F.col("pto_rate").alias("pto_rate_last_12w"),
        F.col("avg_rating").alias("avg_rating_last_3m"),
        "workload_ratio",
        F.array("top_driver_1", "top_driver_2", "top_driver_3").alias("top_drivers"),
    )


def saved_rows(records: DataFrame, created_at: Column) -> DataFrame:
    """Records in the shape of the saved table (``schemas.NEXT_STEPS``)."""
    steps = F.coalesce(F.to_json("recommendations"), F.to_json(F.array("model_response")))
    return records.select(
        "employee_id",
        "attrition_risk",
        F.array_join("top_drivers", ",").alias("top_drivers"),
        steps.alias("recommendations_json"),
        "owner",
        "suggested_check_in_weeks",
        "practice",
        "tenure_weeks",
        "avg_hours_last_12w",
        "pto_rate_last_12w",
        "avg_rating_last_3m",
        "workload_ratio",
        created_at.cast("timestamp_ntz").alias("created_at"),
    )


def latest_per_key(df: DataFrame, key: str, newest_first: list[Column]) -> DataFrame:
    """The newest row of each key; only one row per key and map task is shuffled."""
    newest = Window.partitionBy(key).orderBy(*newest_first)
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).drop("_r")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``target`` whose key is not in ``source``, and all rows of ``source``.

    ``source`` must hold a key once, or the job fails; reduce it with ``latest_per_key`` first if it may not.  Rows without
    a key match nothing and are added.
    """
    copies = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit(f"{key} occurs more than once in the source: "), F.col(key).cast("string"))
    once = F.when(F.col(key).isNotNull() & (F.col("_copies") > 1), F.raise_error(message)).otherwise(F.lit(True))
    source = source.withColumn("_copies", copies).where(once.cast("boolean")).drop("_copies")
    kept = target.join(source.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*[c for c in target.columns if has(source, c)]), allowMissingColumns=True)
