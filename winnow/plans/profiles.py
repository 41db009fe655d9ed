"""Queries of the profile family: profile tables, prompts, replies, vectors, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.functions import replies as rep
from winnow.operators import conform, profiles, prompts, vectors
from winnow.plans import screening as screening_plans, tables as src
from winnow.plans.registry import query
from winnow.session import use_checkpoint_dir
from winnow.sources import arrivals, profiles as store
from winnow.streaming import screening as streaming

# --- profile tables ----------------------------------------------------------------


def parsed_resumes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as parsed resumes: every line gives an entry of each kind."""
    lines = F.split("text", "\n")

    def first(line):
        return F.regexp_extract(line, "^[^ ]*", 0)

    return src.load(spark, folder, "documents").select(
        F.col("doc_id").alias("candidate_id"),
        F.array("lang", "source").alias("roles"),
        F.transform(
            lines, lambda line: F.struct(first(line).alias("category"), F.split(line, " ").alias("skills"))
        ).alias("categorized_skills"),
        F.transform(
            lines,
            lambda line: F.struct(
                first(line).alias("project_name"), F.split(line, ", ").alias("tech_stack"), line.alias("description")
            ),
        ).alias("projects"),
        F.transform(
            lines,
            lambda line, i: F.struct(
                F.when(i > 0, first(line)).otherwise("").alias("role_title"),
                F.split(line, "\\. ").alias("responsibilities"),
            ),
        ).alias("responsibilities"),
        F.array(F.struct(F.col("lang").alias("category"), F.col("source").alias("content"))).alias("misc"),
    )


@query(
    "profile_fan_out",
    """WITH cut AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS seq FROM cut),
    p AS (SELECT *, string_split(line, ' ')[1] AS head FROM l)
    SELECT doc_id AS candidate_id, 'skills' AS profile_table, CAST(seq AS INTEGER) AS seq, head AS title,
      CAST(len(string_split(line, ' ')) AS INTEGER) AS n, '' AS body FROM p
    UNION ALL SELECT doc_id, 'projects', CAST(seq AS INTEGER), head, CAST(len(string_split(line, ', ')) AS INTEGER), line FROM p
    UNION ALL SELECT doc_id, 'responsibilities', CAST(seq AS INTEGER),
      CASE WHEN seq = 0 OR head = '' THEN 'General Experience' ELSE head END,
      CAST(len(string_split(line, '. ')) AS INTEGER), '' FROM p
    UNION ALL SELECT doc_id, 'misc', 0, lang, 0, source FROM documents""",
)
def profile_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    fanned = profiles.fan_out(parsed_resumes(spark, folder))
    items = F.coalesce("skills", "tech_stack", "responsibilities", F.array().cast("array<string>"))
    return fanned.select(
        "candidate_id",
        "profile_table",
        "seq",
        F.coalesce("category", "project_name", "context_title").alias("title"),
        F.size(items).alias("n"),
        F.coalesce("description", "content", F.lit("")).alias("body"),
    )


@query(
    "profile_store",
    """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
    t AS (SELECT doc_id, unnest(['skills', 'projects', 'responsibilities', 'misc']) AS profile_table, n FROM l)
    SELECT doc_id AS candidate_id, profile_table,
      CASE WHEN profile_table = 'misc' THEN 1 ELSE n END * CASE WHEN doc_id % 3 = 0 AND profile_table <> 'skills'
        THEN 2 ELSE 1 END AS n_entries,
      CASE WHEN profile_table = 'misc' THEN 1 ELSE n END * CASE WHEN doc_id % 3 = 0 AND profile_table <> 'skills'
        THEN 2 ELSE 1 END - 1 AS last_seq FROM t""",
)
def profile_store(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates written to the store, every third a second time, and read back."""
    root = _new_folder(spark)
    parsed = parsed_resumes(spark, folder)
    profiles.populate_profile(parsed, root)
    profiles.populate_profile(parsed.filter(F.pmod("candidate_id", F.lit(3)) == 0), root)
    return _stored_counts(spark, root, profiles.FAN_OUT_TABLES)


def _stored_counts(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    counted = None
    for table in tables:
        held = store.read_profile(spark, root, table)
        part = held.groupBy("candidate_id", F.lit(table).alias("profile_table")).agg(
            F.count("*").alias("n_entries"), F.max("seq").alias("last_seq")
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query(
    "stream_profile",
    """SELECT doc_id AS candidate_id, 'misc' AS profile_table, 2::BIGINT AS n_entries, 1::BIGINT AS last_seq FROM documents""",
)
def stream_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Entries put into the store by a batch job and, again, as a stream."""
    root = _new_folder(spark)
    fanned = profiles.entries_of(profiles.fan_out(parsed_resumes(spark, folder)), "misc")
    entries = fanned.withColumn("seq", F.col("seq").cast("bigint"))
    store.append_profile(entries, root, "misc")
    entries.write.parquet(f"{root}/arriving")
    arriving = spark.readStream.schema(entries.schema).parquet(f"{root}/arriving")
    streaming.append_stream(arriving, root, "misc", "form", f"{root}/state").awaitTermination()
    return _stored_counts(spark, root, ["misc"])


def order_roles(spark: SparkSession, folder: str) -> DataFrame:
    return src.load(spark, folder, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("seq"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("context_title"),
        F.split("o_orderpriority", "-").alias("responsibilities"),
    )


@query(
    "quick_glance",
    """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS role_no,
      nullif(o_orderstatus, 'P') AS title, string_split(o_orderpriority, '-') AS items FROM orders)
    SELECT o_custkey AS candidate_id, role_no, coalesce(title, 'Role Context #' || role_no) AS title,
      CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS item_no, unnest(items) AS item FROM r""",
)
def quick_glance(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.quick_glance(order_roles(spark, folder))


def context(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' profiles: their segment and place as skills, their orders as projects and roles."""
    nations = src.load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"
    )
    regions = src.load(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    customers = src.load(spark, folder, "customer").join(nations, "c_nationkey").join(regions, "n_regionkey")
    skills = customers.select(
        F.col("c_custkey").alias("candidate_id"),
        F.lit(0).cast("bigint").alias("seq"),
        F.col("c_mktsegment").alias("category"),
        F.array("n_name", "r_name").alias("skills"),
    )
    projects = src.load(spark, folder, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("project_name"),
        F.array("o_orderstatus", "o_orderpriority").alias("tech_stack"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("description"),
    )
    return profiles.build_context(
        {"skills": skills, "projects": projects, "responsibilities": order_roles(spark, folder)}
    )


@query(
    "profile_context",
    """WITH s AS (SELECT c_custkey AS id, [{'category': c_mktsegment, 'skills': [n_name, r_name]}] AS skills
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    o AS (SELECT o_custkey AS id,
      list({'project_name': 'order-' || o_orderkey, 'tech_stack': [o_orderstatus, o_orderpriority],
            'description': strftime(o_orderdate, '%Y-%m-%d')} ORDER BY o_orderkey) AS projects,
      list({'context_title': nullif(o_orderstatus, 'P'), 'responsibilities': string_split(o_orderpriority, '-')}
           ORDER BY o_orderkey) AS roles FROM orders GROUP BY 1)
    SELECT id AS candidate_id, CAST(0 AS BIGINT) AS part, CAST(to_json({'skills': coalesce(skills, []),
      'projects': coalesce(projects, []), 'responsibilities': coalesce(roles, []), 'challenges': [], 'misc': []}) AS VARCHAR) AS context_json
    FROM s FULL JOIN o USING (id)""",
)
def profile_context(spark: SparkSession, folder: str) -> DataFrame:
    return context(spark, folder).select("candidate_id", "part", "context_json")


@query(
    "skill_inventory",
    """SELECT p_brand AS category, count(*) AS n_skills, count(DISTINCT lower(skill)) AS n_distinct
    FROM (SELECT p_brand, unnest(list_concat(string_split(p_name, ' '), [p_type, upper(p_name)])) AS skill FROM part)
    GROUP BY 1""",
)
def skill_inventory(spark: SparkSession, folder: str) -> DataFrame:
    entries = src.load(spark, folder, "part").select(
        F.col("p_brand").alias("category"),
        F.concat(F.split("p_name", " "), F.array(F.col("p_type"), F.upper("p_name"))).alias("skills"),
    )
    return profiles.skill_inventory(entries)


@query(
    "project_stack",
    """SELECT p_partkey, 'Project Stack (' || p_name || ')' AS category, p_type || '|' || p_brand AS skills FROM part""",
)
def project_stack(spark: SparkSession, folder: str) -> DataFrame:
    projects = src.load(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("project_name"), F.array("p_type", "p_brand").alias("tech_stack")
    )
    derived = profiles.skills_from_projects(projects, ["p_partkey"])
    return derived.withColumn("skills", F.array_join("skills", "|"))


@query(
    "profile_ready",
    """SELECT DISTINCT candidate_id FROM (SELECT doc_id AS candidate_id FROM labels
      UNION ALL SELECT o_custkey FROM orders)""",
)
def profile_ready(spark: SparkSession, folder: str) -> DataFrame:
    skills = src.load(spark, folder, "labels").select(F.col("doc_id").alias("candidate_id"))
    projects = src.load(spark, folder, "orders").select(F.col("o_custkey").alias("candidate_id"))
    return profiles.profile_ready(skills, projects)


@query(
    "conform_rows",
    """SELECT conv_id, turn, role AS project_name, 0 AS n_stack, 'quality ' || quality AS description,
      CASE WHEN quality IS NULL THEN 'description' END AS reason
    FROM conversations LEFT JOIN labels ON doc_id = conv_id""",
)
def conform_rows(spark: SparkSession, folder: str) -> DataFrame:
    labels = src.load(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    rows = (
        src.load(spark, folder, "conversations")
        .join(labels, "conv_id", "left")
        .select(
            "conv_id",
            "turn",
            F.col("role").alias("project_name"),
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
        )
    )
    checked = conform.conform(rows, "project_entry", ["conv_id", "turn"])
    return checked.select(
        "conv_id", "turn", "project_name", F.size("tech_stack").alias("n_stack"), "description", "reason"
    )


@query(
    "conform_payloads",
    """SELECT event_id, event_type AS category,
      CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS content,
      CASE WHEN event_type = 'error' THEN 'content' END AS reason FROM events""",
)
def conform_payloads(spark: SparkSession, folder: str) -> DataFrame:
    content = F.when(
        F.col("event_type") != "error",
        F.concat(F.lit(',"content":"'), F.get_json_object("props", "$.k"), F.lit('"')),
    ).otherwise("")
    payload = F.concat(F.lit('{"category":"'), "event_type", F.lit('"'), content, F.lit("}"))
    rows = src.load(spark, folder, "events").select("event_id", payload.alias("payload"))
    return conform.conform_json(rows, "payload", "misc_entry", ["event_id"])


# --- prompts and replies -------------------------------------------------------------
def templates(spark: SparkSession) -> DataFrame:
    rows = [
        ("talk", "user", 'Turn {turn}: reply as {{"role": "{role}"}}.\n{text}'),
        ("talk", "assistant", "{text}\n-- {role} in {{conv_id}} {conv_id}"),
        ("talk", "system", "{{{role}}}"),
    ]
    return spark.createDataFrame(rows, "file string, key string, template string")


@query(
    "prompt_render",
    """SELECT conv_id, turn, CASE role
      WHEN 'user' THEN 'Turn ' || turn || ': reply as {"role": "user"}.' || chr(10) || '{turn}{' || text
      WHEN 'assistant' THEN '{turn}{' || text || chr(10) || '-- assistant in {conv_id} ' || conv_id
      ELSE '{system}' END AS prompt FROM conversations""",
)
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    requests = src.load(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat(F.lit("{turn}{"), "text").alias("text"),
        F.lit("talk").alias("file"), F.col("role").alias("key"),
    )
    slots = {name: F.col(name) for name in ("conv_id", "turn", "role", "text")}
    rendered = prompts.render_prompts(requests, templates(spark), slots)
    return rendered.select("conv_id", "turn", "prompt")


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as model replies: the user's in a fence, the assistant's bare, the system's as prose."""
    body = F.to_json(
        F.struct(
            F.col("role").alias("headline"),
            F.concat(F.lit(" "), "text", F.lit("\\nend ")).alias("about_section"),
            F.array(F.concat(F.lit("#"), "role"), F.lit(" "), F.lit("a#b ")).alias("featured_hashtags"),
        )
    )
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), body, F.lit("\n```  ")))
        .when(F.col("role") == "assistant", F.concat(F.lit(" "), body))
        .otherwise(F.concat(F.lit("Sure: "), "text", F.lit("\\nend")))
    )
    return src.load(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query(
    "reply_parse",
    """SELECT conv_id, turn, role <> 'system' AS parsed, CASE WHEN role <> 'system' THEN role ELSE '' END AS headline,
      trim(CASE WHEN role = 'system' THEN 'Sure: ' ELSE '' END || text, ' ' || chr(10)) || chr(10) || 'end' AS about
    FROM conversations""",
)
def reply_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = prompts.parse_reply(replies(spark, folder), "linkedin_reply")
    return parsed.select("conv_id", "turn", "parsed", "headline", F.col("about_section").alias("about"))


@query(
    "hashtags",
    """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN '#' || role || ' #ab' ELSE '' END AS hashtags
    FROM conversations""",
)
def hashtags(spark: SparkSession, folder: str) -> DataFrame:
    parsed = prompts.parse_reply(replies(spark, folder), "linkedin_reply")
    return prompts.with_hashtags(parsed).select("conv_id", "turn", "hashtags")


@query("fence_strip", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text FROM conversations")
def fence_strip(spark: SparkSession, folder: str) -> DataFrame:
    fenced = F.concat(F.lit(" ```json"), "text", F.lit("``` \n"))
    turns = src.load(spark, folder, "conversations")
    return turns.select("conv_id", "turn", rep.strip_fence(fenced).alias("text"))


# --- vectors -----------------------------------------------------------------------------
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label: averaged per position, then put together."""
    cells = src.load(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"])
    return means.groupBy("label").agg(vector.alias("embedding")).withColumnRenamed("label", "query_id")


@query(
    "cosine_topk",
    """WITH cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY ALL),
    q AS (SELECT label AS query_id, list(x ORDER BY pos) AS v FROM means GROUP BY 1),
    s AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score
      FROM embeddings, q)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
      doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    corpus = src.load(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = vectors.cosine_topk(corpus, centroids(spark, folder), 10)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(
    "vector_upsert",
    """WITH b AS (
      SELECT vec_id AS doc_id, embedding, 'old' AS metadata, CAST(5 AS BIGINT) AS version, 0 AS fresh FROM embeddings
      UNION ALL SELECT vec_id * 2, embedding, 'new', CAST(label AS BIGINT), 1 FROM embeddings)
    SELECT doc_id, metadata, version, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM b
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, fresh DESC) = 1""",
)
def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    table = src.load(spark, folder, "embeddings")
    stored = table.select(
        F.col("vec_id").alias("doc_id"),
        "embedding",
        F.lit("old").alias("metadata"),
        F.lit(5).cast("bigint").alias("version"),
    )
    new = table.select(
        (F.col("vec_id") * 2).alias("doc_id"),
        "embedding",
        F.lit("new").alias("metadata"),
        F.col("label").cast("bigint").alias("version"),
    )
    merged = vectors.upsert_vectors(stored, new, dimension=64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return merged.select("doc_id", "metadata", "version", F.round(total, 6).alias("total"))


# --- streaming --------------------------------------------------------------------------
def arriving_applications(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they lie in their folder, each arriving as an application."""
    arriving = arrivals.stream_parquet(spark, f"{folder}/documents.parquet", src.SCHEMAS["documents"]).select("doc_id")
    items = src.load(spark, folder, "benchmark").agg(F.count("*")).scalar()
    at = F.timestamp_seconds(F.col("application_id") + F.lit(1_700_000_000))
    return src.with_job(arriving, items).withColumn("submitted_at", at)


ROUTED = (
    "application_id bigint, resume_id bigint, jd_id bigint, n_required int, n_matched int, skill_match double, "
    "ids bigint, batch bigint, route string"
)


def _new_folder(spark: SparkSession) -> str:
    return f"{use_checkpoint_dir(spark).rstrip('/')}/screen-{uuid.uuid4().hex}"


@query("stream_screen", screening_plans.SCREEN_SQL)
def stream_screen(spark: SparkSession, folder: str) -> DataFrame:
    """The batch screening, run as a stream."""
    routed = streaming.screen_stream(
        arriving_applications(spark, folder), src.resumes(spark, folder), src.jds(spark, folder)
    )
    place = _new_folder(spark)
    routed = routed.select(*screening_plans.screen_columns())
    streaming.write_routed(routed, f"{place}/routed", f"{place}/state").awaitTermination()
    return arrivals.read_written(spark, f"{place}/routed", ROUTED).select(*routed.columns)


@query("screen_arrivals", screening_plans.SCREEN_SQL)
def screen_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The batch screening, batch by batch of what arrives."""
    place = _new_folder(spark)
    streaming.screen_arrivals(
        arriving_applications(spark, folder),
        src.resumes(spark, folder),
        src.jds(spark, folder),
        f"{place}/routed",
        f"{place}/state",
        ["application_id", "resume_id", "jd_id", "n_required", "n_matched", "skill_match", "route"],
    ).awaitTermination()
    return arrivals.read_written(spark, f"{place}/routed", ROUTED).select(*screening_plans.screen_columns())
