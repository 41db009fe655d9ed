"""Profile tables: filling them from parsed resumes and nesting them for prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow import fixed_values as fixed, schemas
from winnow.functions import text as t
from winnow.operators.grouping import numbered
from winnow.sources import profiles as store

FAN_OUT_TABLES = ["skills", "projects", "responsibilities", "misc"]
# One wide entry holds the columns of all tables, so one pass can feed them all.
_ENTRY = [
    ("category", "string"),
    ("skills", "array<string>"),
    ("project_name", "string"),
    ("tech_stack", "array<string>"),
    ("description", "string"),
    ("context_title", "string"),
    ("responsibilities", "array<string>"),
    ("content", "string"),
]
_COLUMNS = {
    "skills": ["category", "skills"],
    "projects": ["project_name", "tech_stack", "description"],
    "responsibilities": ["context_title", "responsibilities"],
    "challenges": ["title", "scenario", "solution", "impact"],
    "misc": ["category", "content"],
}


def fan_out(parsed: DataFrame, tables: list[str] = FAN_OUT_TABLES) -> DataFrame:
    """All profile entries of parsed resumes: (candidate_id, profile_table, seq, wide entry).

    One scan and one explode feed all four tables, or those that are named;
    write the result with partitionBy('profile_table') or take a table with
    `entries_of`.
    """

    def entries(table: str, source: str, fields: dict[str, object]) -> Column:
        def entry(item: Column, seq: Column) -> Column:
            cells = [F.lit(table).alias("profile_table"), seq.alias("seq")]
            for name, kind in _ENTRY:
                value = fields[name](item) if name in fields else F.lit(None)
                cells.append(value.cast(kind).alias(name))
            return F.struct(*cells)

        return F.coalesce(F.transform(F.col(source), entry), F.array())

    def same(name: str):
        return lambda item: item[name]

    titled = lambda item: t.or_default(item["role_title"], fixed.DEFAULT_CONTEXT_TITLE)
    every = {
        "skills": ("categorized_skills", {n: same(n) for n in _COLUMNS["skills"]}),
        "projects": ("projects", {n: same(n) for n in _COLUMNS["projects"]}),
        "responsibilities": ("responsibilities", {"context_title": titled, "responsibilities": same("responsibilities")}),
        "misc": ("misc", {n: same(n) for n in _COLUMNS["misc"]}),
    }
    wanted = F.concat(*[entries(table, *every[table]) for table in FAN_OUT_TABLES if table in tables])
    return parsed.select("candidate_id", F.explode(wanted).alias("e")).select("candidate_id", "e.*")


def entries_of(fanned: DataFrame, table: str) -> DataFrame:
    """The entries of one table in its own columns."""
    return fanned.filter(F.col("profile_table") == table).select(
        "candidate_id", "seq", *_COLUMNS[table]
    )


def populate_profile(parsed: DataFrame, root: str, dedupe: bool = False) -> None:
    """Write parsed resumes into the store: a candidate's skills are replaced, the other tables grow.

    A second run therefore repeats the entries of the other tables; dedupe=True
    leaves out those that the candidate has already. Candidates for whom no
    skills were parsed keep those stored.

    Each table takes its own entries from `parsed`, of which no copy is written
    on the way. Resumes that are costly to parse, or come out otherwise each
    time, are to be written by the caller.
    """
    spark = parsed.sparkSession
    for table in FAN_OUT_TABLES:
        entries = entries_of(fan_out(parsed, [table]), table).withColumn("seq", F.col("seq").cast("bigint"))
        if table == "skills":
            if not entries.isEmpty():
                store.overwrite_profile(entries, root, table)
            continue
        if dedupe:
            # Whole entries are compared, at their first place; no group is collected.
            whole = [c for c in entries.columns if c != "seq"]
            entries = entries.groupBy(*whole).agg(F.min("seq").alias("seq"))
            stored = store.read_profile(spark, root, table).select(*[F.col(c).alias("_" + c) for c in whole]).distinct()
            same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in whole]
            entries = entries.join(stored, same, "left_anti")
        store.append_profile(entries, root, table)


def skills_from_projects(projects: DataFrame, keys: list[str]) -> DataFrame:
    """One skills entry per project, named after it."""
    name = F.coalesce("project_name", F.lit("None"))
    return projects.select(
        *keys,
        F.format_string(fixed.PROJECT_STACK_CATEGORY, name).alias("category"),
        F.col("tech_stack").alias("skills"),
    )


def save_project(spark: SparkSession, projects: DataFrame, root: str) -> None:
    """Append candidates' projects and the skills entries derived from them."""
    key = ["candidate_id", "seq"]
    store.append_profile(projects.select(*key, *_COLUMNS["projects"]), root, "projects")
    store.append_profile(skills_from_projects(projects, key), root, "skills")


def skill_inventory(skills: DataFrame) -> DataFrame:
    """(category, n_skills, n_distinct): a skill listed under two categories counts in both."""
    return (
        skills.select("category", F.explode("skills").alias("skill"))
        .groupBy("category")
        .agg(
            F.count("*").alias("n_skills"),
            F.count_distinct(t.norm_skill(F.col("skill"))).alias("n_distinct"),
        )
    )


def profile_ready(skills: DataFrame, projects: DataFrame) -> DataFrame:
    """Candidates with any skills or projects entry."""
    return skills.select("candidate_id").unionByName(projects.select("candidate_id")).distinct()


def quick_glance(responsibilities: DataFrame) -> DataFrame:
    """(candidate_id, role_no, title, item_no, item); a role without a title is named by its place."""
    placed = numbered(responsibilities, "candidate_id", "seq", "role_no")
    title = F.coalesce("context_title", F.format_string(fixed.ROLE_CONTEXT_TITLE, F.col("role_no")))
    return placed.select(
        "candidate_id",
        "role_no",
        title.alias("title"),
        F.posexplode("responsibilities").alias("item_no", "item"),
    )


def build_context(tables: dict[str, DataFrame], entries_per_part: int = 1000) -> DataFrame:
    """(candidate_id, part, context, context_json): the five tables nested per candidate.

    `tables` maps table names to (candidate_id, seq, columns of the table). All
    are put into one stream and nested by one shuffle. A candidate with up to
    `entries_per_part` entries in each table is one row, part 0; one with more
    goes on in further parts, so no row grows without bound and none is lost.
    """
    parts = []
    for table in fixed.PROFILE_TABLES:
        if table not in tables:
            continue
        placed = numbered(tables[table], "candidate_id", "seq", "_place")
        entry = F.struct(F.col("_place"), F.struct(*_COLUMNS[table]).alias("entry"))
        parts.append(
            placed.select(
                "candidate_id",
                F.floor((F.col("_place") - 1) / entries_per_part).cast("bigint").alias("part"),
                entry.alias("_" + table),
            )
        )
    if not parts:
        raise ValueError("no profile tables given")
    stream = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def nested(table: str) -> Column:
        if table not in tables:
            kinds = schemas.PROFILE_ENTRIES[table].replace(", ", ",").replace(" ", ":")
            return F.array().cast(f"array<struct<{kinds}>>")
        in_order = F.array_sort(F.collect_list("_" + table))
        return F.transform(in_order, lambda e: e["entry"])

    grouped = stream.groupBy("candidate_id", "part").agg(
        F.struct(*[nested(table).alias(table) for table in fixed.PROFILE_TABLES]).alias("context")
    )
    return grouped.withColumn(
        "context_json", F.to_json("context", {"ignoreNullFields": "false"})
    )
