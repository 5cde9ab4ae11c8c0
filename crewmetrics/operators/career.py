"""Career plans: target role, courses, mentor, project; one row per employee, all in one plan.

The rule tables are literals; the two catalog extracts (first course per required skill, first
rows overall) are scalar subqueries bounded by the vocabulary and the course limit.  What is left
is one shuffle of the skills, one join by employee and one by practice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.operators.features import skill_levels
from crewmetrics.plans.constants import bind, constant
from crewmetrics.plans.skew import attach_groups
from crewmetrics.schemas import require

COURSE_LIMIT = 4
_COURSE = ["course_id", "title", "skill", "provider"]


def fallback_catalog(spark: SparkSession) -> DataFrame:
    rows = [(*course, i) for i, course in enumerate(ref.FALLBACK_CATALOG)]
    return spark.createDataFrame(rows, "course_id string, title string, skill string, provider string, ordinal bigint")


def employee_skills(skills: DataFrame) -> DataFrame:
    """(employee_id, skills map): of several rows for a skill the last one counts."""
    require(skills, "ordinal")
    last = (
        skills.where(F.col("employee_id").isNotNull() & F.col("skill").isNotNull())
        .groupBy("employee_id", "skill")
        .agg(F.max_by("level", "ordinal").alias("level"))
    )
    return last.groupBy("employee_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("skill", "level")))).alias("skills")
    )


def _needs_table(requirements: dict[str, dict[str, float]]) -> Column:
    table = {
        role: [{"ord": i, "skill": s, "need": float(n)} for i, (s, n) in enumerate(needs.items())]
        for role, needs in requirements.items()
    }
    return constant(table, "map<string,array<struct<ord:int,skill:string,need:double>>>")


def _role_gap(needs_table: Column, levels: Column, role: Column) -> Column:
    """struct(score, gaps) of one role; an unknown role scores 1 with no gaps."""
    no_gaps = F.array().cast("array<struct<ord:int,skill:string,gap:double>>")

    def measure(needs: Column) -> Column:
        gaps = F.transform(
            needs,
            lambda n: F.struct(
                n["ord"].alias("ord"),
                n["skill"].alias("skill"),
                F.greatest(F.lit(0.0), n["need"] - F.coalesce(F.try_element_at(levels, n["skill"]), F.lit(0.0))).alias(
                    "gap"
                ),
            ),
        )
        asked = F.aggregate(needs, F.lit(0.0), lambda a, n: a + n["need"])
        return bind(
            gaps,
            lambda g: F.struct(
                F.coalesce(F.try_divide(F.aggregate(g, F.lit(0.0), lambda a, x: a + x["gap"]), asked), F.lit(1.0)).alias(
                    "score"
                ),
                F.coalesce(g, no_gaps).alias("gaps"),
            ),
        )

    return bind(F.try_element_at(needs_table, role), measure)


def _with_levels(employees: DataFrame, skills: DataFrame, requirements: dict) -> DataFrame:
    levels = skill_levels(skills, ref.vocabulary(requirements), "last").select("employee_id", "levels")
    return employees.join(levels, "employee_id", "left")


def skill_gaps(
    targets: DataFrame, skills: DataFrame, requirements: dict[str, dict[str, float]] = ref.CAREER_REQUIREMENTS
) -> DataFrame:
    """Gap of each (employee_id, target_role) row: score and gap per required skill, zeros included."""
    measured = _with_levels(targets, skills, requirements).withColumn(
        "_g", _role_gap(_needs_table(requirements), F.col("levels"), F.col("target_role"))
    )
    return measured.select(
        *[targets[c] for c in targets.columns],
        F.col("_g.score").alias("skill_gap_score"),
        F.map_from_entries(F.transform("_g.gaps", lambda g: F.struct(g["skill"], g["gap"]))).alias("skill_gaps"),
    )


def career_targets(
    employees: DataFrame,
    skills: DataFrame,
    requirements: dict[str, dict[str, float]] = ref.CAREER_REQUIREMENTS,
    paths: dict[str, list[str]] = ref.CAREER_PATHS,
) -> DataFrame:
    """Adds target_role, skill_gap_score, gaps and wanted skills (largest gap first).

    Of the next roles the one with the smallest gap is chosen, of equal ones the first of the
    path; a role without a path is its own target.
    """
    next_roles = F.coalesce(
        F.try_element_at(constant(paths, "map<string,array<string>>"), F.col("role")), F.array("role")
    )
    needs = _needs_table(requirements)

    def option(role: Column, i: Column) -> Column:
        return bind(
            _role_gap(needs, F.col("levels"), role),
            lambda g: F.struct(
                g["score"].alias("score"), i.alias("i"), role.alias("target"), g["gaps"].alias("gaps")
            ),
        )

    best = _with_levels(employees, skills, requirements).withColumn("_b", F.array_min(F.transform(next_roles, option)))
    open_gaps = F.filter("_b.gaps", lambda g: g["gap"] > 0)
    by_size = F.sort_array(F.transform(open_gaps, lambda g: F.struct((-g["gap"]).alias("o"), g["ord"], g["skill"])))
    return best.select(
        *[employees[c] for c in employees.columns],
        F.col("_b.target").alias("target_role"),
        F.col("_b.score").alias("skill_gap_score"),
        F.col("_b.gaps").alias("gaps"),
        F.transform(by_size, lambda g: g["skill"]).alias("wanted_skills"),
    )


def recommend_courses(
    targets: DataFrame,
    catalog: DataFrame,
    vocabulary: list[str],
    limit: int = COURSE_LIMIT,
) -> DataFrame:
    """Adds recommended_courses: the first catalog course of each wanted skill, then padding.

    Padding repeats the catalog's first rows in their order, also if one is already listed.
    """
    require(catalog, "ordinal", *_COURSE)
    entry = F.struct(*_COURSE)
    first_of = (
        catalog.where(F.col("skill").isin(vocabulary))
        .groupBy("skill")
        .agg(F.min_by(entry, "ordinal").alias("c"))
        .agg(F.map_from_entries(F.collect_list(F.struct("skill", "c"))).alias("m"))
        .scalar()
    )
    head = catalog.orderBy("ordinal").limit(limit)
    listed = F.sort_array(F.collect_list(F.struct("ordinal", entry.alias("c"))))
    first_rows = head.agg(F.transform(listed, lambda r: r["c"]).alias("a")).scalar()
    given = targets.withColumns({"_first": first_of, "_head": first_rows})

    def course(c: Column, reason: Column) -> Column:
        return F.struct(*[c[name].alias(name) for name in _COURSE], reason.alias("reason"))

    known = F.filter(F.col("wanted_skills"), lambda s: F.try_element_at("_first", s).isNotNull())
    chosen = F.transform(
        F.slice(known, 1, limit),
        lambda s: course(F.try_element_at("_first", s), F.concat(F.lit("Address skill gap in "), s)),
    )
    padding = F.transform(F.col("_head"), lambda c: course(c, F.lit("General professional development")))
    listed = bind(chosen, lambda found: F.concat(found, F.slice(padding, F.lit(1), F.lit(limit) - F.size(found))))
    return given.withColumn("recommended_courses", listed).drop("_first", "_head")


def recommend_mentors(
    employees: DataFrame, seniority: dict[str, int] = ref.SENIORITY_RANK, carry: list[str] | None = None
) -> DataFrame:
    """Adds recommended_mentor: the first more senior employee of the practice, else of any.

    First means lowest ``ordinal``.  The "more senior than" comparison is reduced to one
    candidate per practice and rank, so employees are never paired with employees.
    """
    require(employees, "ordinal", "seniority", "practice", "role")
    rank = F.coalesce(F.try_element_at(constant(seniority, "map<string,int>"), F.col("seniority")), F.lit(0))
    person = F.struct("employee_id", "role", "practice")
    above = [
        F.min_by(person, F.when(F.col("_rank") > r, F.col("ordinal"))) for r in range(max(seniority.values()) + 1)
    ]
    ranked = employees.withColumn("_rank", rank)
    anyone = ranked.agg(F.array(*above).alias("a")).scalar()
    # employees of few practices would meet in as few tasks
    joined = attach_groups(ranked, ["practice"], {"_own": F.array(*above)}).withColumn("_any", anyone)
    pick = F.coalesce(F.get("_own", F.col("_rank")), F.get("_any", F.col("_rank")))
    joined = joined.withColumn("_m", pick)
    mentor = F.struct(
        F.col("_m.employee_id").alias("mentor_id"),
        F.concat(F.lit("Mentor "), F.col("_m.employee_id")).alias("mentor_name"),
        F.col("_m.role").alias("mentor_role"),
        F.col("_m.practice").alias("mentor_practice"),
        F.when(F.col("_m").isNull(), "No suitable mentors found")
        .otherwise(F.concat(F.lit("Senior "), F.col("_m.role"), F.lit(" in "), F.col("_m.practice"), F.lit(" practice")))
        .alias("reason"),
    )
    return joined.select(*(carry or employees.columns), mentor.alias("recommended_mentor"))


def recommend_projects(targets: DataFrame, projects: list[dict] = ref.PROJECT_ROTATIONS) -> DataFrame:
    """Adds recommended_project_rotation: the project that covers most of the two largest gaps."""
    table = constant(projects, "array<struct<title:string,skills:array<string>,duration:string>>")
    top = F.slice("wanted_skills", 1, 2)

    def choose(two: Column) -> Column:
        options = F.transform(
            table,
            lambda p, i: F.struct(F.size(F.array_intersect(two, p["skills"])).alias("n"), (-i).alias("o"), p.alias("p")),
        )
        return bind(
            F.array_max(options),
            lambda b: F.struct(
                b["p"]["title"].alias("title"),
                b["p"]["duration"].alias("duration"),
                b["p"]["skills"].alias("skills"),
                F.when(b["n"] > 0, F.concat(F.lit("Addresses skill gaps in "), F.array_join(two, ", ")))
                .otherwise("General skill development")
                .alias("reason"),
            ),
        )

    return targets.withColumn("recommended_project_rotation", bind(top, choose))


def career_plans(
    employees: DataFrame,
    skills: DataFrame,
    catalog: DataFrame | None = None,
    requirements: dict[str, dict[str, float]] = ref.CAREER_REQUIREMENTS,
    paths: dict[str, list[str]] = ref.CAREER_PATHS,
    projects: list[dict] = ref.PROJECT_ROTATIONS,
    seniority: dict[str, int] = ref.SENIORITY_RANK,
    limit: int = COURSE_LIMIT,
) -> DataFrame:
    """The full plan of every employee."""
    if catalog is None:
        catalog = fallback_catalog(employees.sparkSession)
    planned = career_targets(recommend_mentors(employees, seniority), skills, requirements, paths)
    planned = recommend_projects(recommend_courses(planned, catalog, ref.vocabulary(requirements), limit), projects)
    gaps = F.map_from_entries(F.transform("gaps", lambda g: F.struct(g["skill"], g["gap"].cast("double"))))
    return planned.select(
        "employee_id",
        F.col("role").alias("current_role"),
        "target_role",
        "skill_gap_score",
        gaps.alias("skill_gaps"),
        "recommended_courses",
        "recommended_mentor",
        "recommended_project_rotation",
    )


def skill_demand(
    employees: DataFrame, skills: DataFrame, requirements: dict[str, dict[str, float]] = ref.FEATURE_REQUIREMENTS
) -> DataFrame:
    """Skills most in demand per role: required level against supply, ranked by the total gap."""
    staffed = _with_levels(employees.select("employee_id", "role"), skills, requirements)
    needs = F.try_element_at(_needs_table(requirements), F.col("role"))
    rows = staffed.select("role", "levels", F.inline(needs))
    level = F.coalesce(F.try_element_at("levels", F.col("skill")), F.lit(0.0))
    demand = rows.groupBy("role", "skill").agg(
        F.max("need").alias("required_level"),
        F.count("*").alias("people"),
        F.avg(level).alias("avg_level"),
        F.sum(F.greatest(F.lit(0.0), F.col("need") - level)).alias("total_gap"),
    )
    # one row per role and required skill
    by_gap = Window.partitionBy("role").orderBy(F.col("total_gap").desc(), "skill")
    return demand.withColumn("demand_rank", F.row_number().over(by_gap))
