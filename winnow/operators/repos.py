"""Repository metadata: recency, cards, and skills verified against it.

`repos`: handle, name, html_url, description, language, topics,
stargazers_count, updated_at, pushed_at. `commits`: owner, repo, pos, sha, commit.

A handle may own any share of all repositories. Whatever is decided per handle
is therefore an aggregate (combined before the shuffle) or a ranked limit
(applied before the shuffle), never a window that holds all of a handle's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t
from winnow.operators.grouping import for_skewed_join, likely_among, salted_join
from winnow.operators.ordering import numbered_in_order, runs_of_rows, written

REPOS_PER_PART = 1000


def is_recent(cutoff: str) -> Column:
    """Pushed on a later day than the cutoff. ISO days order as text."""
    return F.coalesce(F.left("pushed_at", F.lit(fixed.DAY_CHARS)) > cutoff, F.lit(False))


def recent_or_all(repos: DataFrame, cutoff: str = fixed.ACTIVITY_CUTOFF) -> DataFrame:
    """Repositories pushed after the cutoff day, or all of a handle that has none such."""
    recent = is_recent(cutoff)
    active = repos.filter(recent).select("handle").distinct().withColumn("_active", F.lit(True))
    joined = salted_join(repos, active, ["handle"], "name", "left")
    return joined.filter(recent | F.col("_active").isNull()).drop("_active")


def top_recent_repos(
    repos: DataFrame, per_handle: int = fixed.MAX_REPOS_SHOWN, cutoff: str = fixed.ACTIVITY_CUTOFF
) -> DataFrame:
    """top_repos(recent_or_all(repos)) in one scan and without the join.

    Recent and other repositories are ranked apart, so the limit cuts both
    before the shuffle; of a handle only 2 * per_handle rows are then looked
    at to see whether it has any recent one.
    """
    apart = Window.partitionBy("handle", "_recent").orderBy(*_latest_first())
    ranked = repos.withColumn("_recent", is_recent(cutoff)).withColumn("rank", F.row_number().over(apart))
    few = ranked.filter(F.col("rank") <= per_handle)
    any_recent = F.max("_recent").over(Window.partitionBy("handle"))
    return few.withColumn("_any", any_recent).filter(F.col("_recent") == F.col("_any")).drop("_recent", "_any")


def _latest_first() -> list[Column]:
    return [F.desc_nulls_last("updated_at"), F.asc("name")]


def top_repos(repos: DataFrame, per_handle: int = fixed.MAX_REPOS_SHOWN) -> DataFrame:
    """The most recently updated repositories of each handle, missing dates last, with their rank."""
    order = Window.partitionBy("handle").orderBy(*_latest_first())
    return repos.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_handle)


def latest_repo(repos: DataFrame, cutoff: str = fixed.ACTIVITY_CUTOFF) -> DataFrame:
    """(handle, repo): the most recently updated repository of each handle."""
    return top_recent_repos(repos, 1, cutoff).select("handle", F.col("name").alias("repo"))


def recent_commits(
    repos: DataFrame,
    commits: DataFrame,
    per_repo: int = fixed.MAX_COMMITS_SHOWN,
    cutoff: str = fixed.ACTIVITY_CUTOFF,
) -> DataFrame:
    """The first listed commits of each handle's latest repository, with their rank.

    Commits of repositories that no handle has as its latest are left out by
    name where they are read, but for a few. Those of one repository are cut to
    the first few by each task, so they are shuffled once, and what is left of
    each meets the chosen repositories where the ranking has put it.
    """
    latest = written(latest_repo(repos, cutoff).withColumnRenamed("handle", "owner"), "latest-repos")
    ranked = top_commits(commits.filter(likely_among(latest, "repo")), per_repo)
    return ranked.join(latest, ["owner", "repo"], "left_semi")


def top_commits(commits: DataFrame, per_repo: int = fixed.MAX_COMMITS_SHOWN) -> DataFrame:
    order = Window.partitionBy("owner", "repo").orderBy("pos", "sha")
    return commits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_repo)


def repo_cards(repos: DataFrame, keys: list[str]) -> DataFrame:
    """Display columns: defaults filled, '|' and newlines made harmless, date cut to the day."""
    shown = F.translate(t.or_default(F.col("description"), fixed.NO_DESCRIPTION), "\n|", " -")
    return repos.select(
        *keys,
        F.coalesce("name", F.lit(fixed.NO_NAME)).alias("name"),
        F.coalesce("html_url", F.lit(fixed.NO_URL)).alias("html_url"),
        shown.alias("description"),
        t.or_default(F.col("language"), fixed.NO_LANGUAGE).alias("language"),
        F.coalesce("stargazers_count", F.lit(0)).alias("stars"),
        F.left(F.coalesce("updated_at", F.lit("")), F.lit(fixed.DAY_CHARS)).alias("updated"),
    )


def commit_cards(commits: DataFrame, keys: list[str]) -> DataFrame:
    message = F.coalesce("commit.message", F.lit(fixed.NO_COMMIT_MESSAGE))
    first_line = F.translate(F.substring_index(message, "\n", 1), "|", "-")
    return commits.select(
        *keys,
        t.cap(F.coalesce("sha", F.lit("")), fixed.COMMIT_SHA_CHARS).alias("sha"),
        t.cap(first_line, fixed.COMMIT_MESSAGE_CHARS).alias("message"),
        F.coalesce("commit.author.name", F.lit(fixed.UNKNOWN_AUTHOR)).alias("author"),
        t.cap(F.coalesce("commit.author.date", F.lit("")), fixed.DAY_CHARS).alias("day"),
    )


def repo_totals(repos: DataFrame) -> DataFrame:
    """Public repositories per handle: the stated total where a payload gave one, else the count."""
    counted = F.count("*")
    if "total_count" in repos.columns:
        counted = F.coalesce(F.max("total_count"), counted)
    return repos.groupBy("handle").agg(counted.alias("total"))


def language_mix(repos: DataFrame) -> DataFrame:
    """(handle, language, n, share): repositories per language."""
    counts = repos.groupBy(
        "handle", t.or_default(F.col("language"), fixed.NO_LANGUAGE).alias("language")
    ).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("handle"))  # a handle has few languages
    return counts.withColumn("share", F.col("n") / whole)


def repo_texts(repos: DataFrame) -> DataFrame:
    """(handle, updated_at, name, text): what there is to search of each repository.

    Languages and topics are lowered; in names and descriptions '-' and '_'
    also become spaces.
    """
    spaced = [
        F.translate(F.lower(F.coalesce(c, F.lit(""))), "-_", "  ") for c in ("name", "description")
    ]
    language = F.when(F.col("language") != "", F.array(F.lower("language")))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.coalesce(language, none),
        F.coalesce(F.transform("topics", F.lower), none),
        F.array(*spaced),
    )
    return repos.select("handle", "updated_at", "name", F.array_join(parts, " ").alias("text"))


def _as_listed() -> list[Column]:
    """Handles, and the repositories of each latest first, missing dates last."""
    return [F.col("handle"), F.desc(F.coalesce("updated_at", F.lit(""))), F.col("name")]


def repo_corpus(repos: DataFrame, per_handle: int | None = None, per_part: int = REPOS_PER_PART) -> DataFrame:
    """(handle, part, corpus): the texts of a handle's repositories, latest first, or of the latest of them.

    A handle of up to `per_part` repositories has one part, 0; others go on in
    further parts, so no cell grows with a handle. One search of the service
    that lists repositories returns `fixed_values.MAX_REPOS_SEARCHED`.
    """
    page = top_repos(repos, per_handle) if per_handle else repos
    numbered = numbered_in_order(repo_texts(page), _as_listed(), "_number")
    first = numbered.groupBy(F.col("handle").alias("_handle")).agg(F.min("_number").alias("_first"))
    placed = numbered.join(for_skewed_join(first, "_handle"), F.col("handle").eqNullSafe(F.col("_handle")))
    placed = placed.withColumn("_place", F.col("_number") - F.col("_first"))
    parts = runs_of_rows(placed, "handle", "_place", "text", per_part)
    return parts.select("handle", F.col("run").alias("part"), F.array_join("values", " ").alias("corpus"))


def skills_in_repos(repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """(handle, skill) of the wanted lower-case skills that a handle's repositories mention as whole words.

    A skill counts wherever it stands in the texts of the handle's repositories
    run together by spaces, latest first. One without a space lies within one
    repository, so each is tested by itself, in any order. A phrase may also
    run on from one repository to the next: then one of them ends with a first
    part of it. Only handles with such a phrase, not found yet, have their
    repositories put in order; they are looked through in runs that overlap by
    as many rows as the longest phrase can reach over.
    """
    texts = repo_texts(repos)
    words = F.split("skill", " ")
    lead = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
    )
    leads_on = F.when(F.contains("skill", F.lit(" ")), F.exists(lead, lambda p: F.endswith(F.col("text"), p))).otherwise(False)
    tested = texts.join(for_skewed_join(wanted, "handle"), "handle").select(
        "handle", "skill", t.contains_word(F.col("text"), F.col("skill")).alias("whole"), leads_on.alias("leads")
    )
    told = tested.filter("whole OR leads").groupBy("handle", "skill").agg(F.bool_or("whole").alias("whole"))
    told = written(told, "skills-in-repos")
    found = told.filter("whole").select("handle", "skill")
    open_ = told.filter("NOT whole").select("handle", "skill")
    longest = open_.agg(F.max(F.length("skill"))).first()[0]
    if longest is None:
        return found
    # Whole rows between two ends of a phrase take a character and a space of it at least.
    overlap = longest // 2 + 1
    few = texts.join(open_.select("handle").distinct(), "handle", "left_semi")
    numbered = numbered_in_order(few, _as_listed(), "_number")
    runs = runs_of_rows(numbered, "handle", "_number", "text", max(64, 4 * overlap), overlap)
    across = (
        runs.select("handle", F.array_join("values", " ").alias("text"))
        .join(open_, "handle")
        .filter(t.contains_word(F.col("text"), F.col("skill")))
    )
    return found.unionByName(across.select("handle", "skill").distinct())


def verify_skills(candidates: DataFrame, repos: DataFrame, per_handle: int | None = None) -> DataFrame:
    """Add verified_skills and verification to candidates (…, handle, skills).

    What is asked of a handle is looked for once, whoever asks; a candidate
    then meets the handle's list of found skills, which is bounded by what is
    asked. Every candidate keeps a row: without a handle the check is
    'skipped', without skills or repositories it is 'unable'.
    """
    page = top_repos(repos, per_handle) if per_handle else repos
    skills = F.filter(F.transform("skills", t.strip), lambda s: s != "")
    asked = candidates.select("handle", F.explode(F.array_distinct(F.transform(skills, F.lower))).alias("skill"))
    found = skills_in_repos(page, asked.filter(F.col("handle").isNotNull()).distinct())
    lists = found.groupBy("handle").agg(F.collect_set("skill").alias("_found"))
    known = page.select("handle").distinct().join(lists, "handle", "left").withColumn("_known", F.lit(True))
    status = (
        F.when(F.coalesce("handle", F.lit("")) == "", "skipped")
        .when(F.col("_known").isNull() | (F.coalesce(F.size("skills"), F.lit(0)) <= 0), "unable")
        .when(F.size("verified_skills") > 0, "yes")
        .otherwise("no")
    )
    none = F.array().cast("array<string>")
    verified = F.filter(skills, lambda s: F.array_contains(F.coalesce("_found", none), F.lower(s)))
    return (
        candidates.join(for_skewed_join(known, "handle"), "handle", "left")
        .withColumn("verified_skills", F.array_sort(F.array_distinct(verified)))
        .withColumn("verification", status)
        .drop("_found", "_known")
    )


def verified_rows(
    candidates: DataFrame, repos: DataFrame, keys: list[str], per_handle: int | None = None
) -> DataFrame:
    """One row per verified skill."""
    checked = verify_skills(candidates, repos, per_handle).select(*keys, "verified_skills")
    found = checked.select(*keys, F.explode_outer("verified_skills").alias("skill"))
    return found.filter(F.col("skill").isNotNull())
