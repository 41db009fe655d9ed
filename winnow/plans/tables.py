"""The domain tables, derived by Spark from the whole given tables.

The given tables have no resumes or repositories, so documents stand in for
resumes and code files, benchmark items for job descriptions, orders and parts
for repositories, and so on. Every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow import fixed_values as fixed
from winnow.operators.grouping import for_skewed_join
from winnow.operators.ordering import written


# Declared, so that planning a query starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def raw_words(text: Column) -> Column:
    """Letter runs of three letters or more, as written, repeats included."""
    return F.regexp_extract_all(text, F.lit("\\p{L}{3,}"), F.lit(0))


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    labels = load(spark, folder, "labels").select("doc_id", "quality")
    return (
        load(spark, folder, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("resume_id"),
            F.col("text").alias("resume_text"),
            F.format_string("Candidate %d", "doc_id").alias("candidate_name"),
            (F.col("quality") * 10.0).alias("candidate_experience"),
            raw_words(F.col("text")).alias("candidate_skills"),
        )
    )


def jds(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("jd_id"),
        F.format_string("Company %d", "item_id").alias("company_name"),
        F.format_string("Position %d", "item_id").alias("job_title"),
        F.col("text").alias("job_description"),
        F.lit(None).cast("double").alias("experience_required"),
        raw_words(F.col("text")).alias("required_skills"),
    )


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """Every resume applies to one job description, in turn."""
    items = load(spark, folder, "benchmark").agg(F.count("*")).scalar()
    return with_job(load(spark, folder, "documents").select("doc_id"), items)


def with_job(docs: DataFrame, items: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("application_id"),
        F.col("doc_id").alias("resume_id"),
        F.pmod("doc_id", items).alias("jd_id"),
    )


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a source is a project, its first document the README."""
    docs = load(spark, folder, "documents").select("doc_id", "source", "text")
    # Written, so that Spark knows its size before it plans the join: where it can be broadcast, the texts stay where they are.
    first = written(docs.groupBy("source").agg(F.min("doc_id").alias("first_id")), "first-of-sources")
    ending = F.element_at(
        F.array(*[F.lit(e) for e in fixed.CODE_EXTENSIONS]),
        (F.pmod("doc_id", F.lit(len(fixed.CODE_EXTENSIONS))) + 1).cast("int"),
    )
    place = F.when(F.pmod("doc_id", F.lit(7)) == 0, "build/lib").otherwise("src")
    path = F.when(F.col("doc_id") == F.col("first_id"), fixed.README_NAME).otherwise(
        F.concat(place, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ending)
    )
    return docs.join(for_skewed_join(first, "source"), "source").select(
        F.col("source").alias("project"), path.alias("path"), F.col("text").alias("content")
    )


def order_repos(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as repositories of the customer who placed them."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return load(spark, folder, "orders").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("handle"),
        F.concat(F.lit("order-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("name"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("html_url"),
        F.nullif(F.concat("o_orderpriority", F.lit("|\n"), "o_orderstatus"), F.lit("5-LOW|\nP")).alias(
            "description"
        ),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("language"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("stargazers_count"),
        F.array("o_orderpriority").alias("topics"),
        stamp.alias("updated_at"),
        stamp.alias("pushed_at"),
    )


def part_repos(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as repositories of the suppliers, dealt out in turn."""
    suppliers = load(spark, folder, "supplier")
    count = suppliers.agg(F.count("*")).scalar()
    parts = load(spark, folder, "part").withColumn("s_suppkey", F.pmod("p_partkey", count))
    return parts.join(suppliers.select("s_suppkey", "s_name"), "s_suppkey").select(
        F.col("s_name").alias("handle"),
        F.concat(F.translate("p_name", " ", "-"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat("p_brand", F.lit(" for_the "), "p_type").alias("description"),
        F.col("p_type").alias("language"),
        F.array("p_brand", "p_type").alias("topics"),
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("updated_at"),
    )


def supplier_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as candidates whose skills are the words of the part with their number."""
    parts = load(spark, folder, "part").withColumnRenamed("p_partkey", "s_suppkey")
    skills = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.translate("p_name", " ", "-")))
    return load(spark, folder, "supplier").join(parts, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("candidate_id"), F.col("s_name").alias("handle"), skills.alias("skills")
    )


def line_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as commits of the order they belong to."""
    owners = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    key = F.concat_ws(
        "/",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string"),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    message = F.concat(
        F.lit("Ship part | number "),
        F.col("l_partkey").cast("string"),
        F.lit(" from the warehouse of the supplier that is number "),
        F.col("l_suppkey").cast("string"),
        F.lit("\nbody"),
    )
    author = F.struct(
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("name"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    return load(spark, folder, "lineitem").join(owners, "l_orderkey").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("owner"),
        F.concat(F.lit("order-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("repo"),
        F.col("l_linenumber").alias("pos"),
        F.md5(key).alias("sha"),
        F.struct(message.alias("message"), author.alias("author")).alias("commit"),
    )
