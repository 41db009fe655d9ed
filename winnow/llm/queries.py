"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

import itertools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.llm import collocations, disclosure, embedding_dedup, filter_audit, kneser_ney, licenses, mixing, order_minhash, packing, quality_classifier, quality_rules, sharding, warc
from winnow.llm.common import WORD, remainder_of_crc, shared_folder, stored
from winnow.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
SHARDS = 40


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first_id THEN first_id END AS refers_to,
  true AS verified
FROM f
"""


@query("op1_warc", _OP1_SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark, "warc")
    archives = stored(warc.write_archives(read(spark, folder, "pages"), place), "warc-list")
    files = archives.repartition(max(1, archives.count()))
    return warc.read_archives(files, place, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    keyed = stored(mixing.with_keys(read(spark, folder, "documents")).drop("row"), "mix-keys")
    plan = mixing.plan_mix(keyed, SOURCE_WEIGHTS)
    return mixing.with_copies(keyed, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rest = remainder_of_crc(F.col("doc_id"), 7)
    model = kneser_ney.train(docs, rest != 2)
    return kneser_ney.score(docs, model).select(
        "row.doc_id",
        (remainder_of_crc(F.col("row.doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op5_order_minhash")
def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, folder, "documents"))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a source is a tree of directories, every 25th document a licence file."""
    number = F.col("doc_id")
    name = F.when(F.pmod(number, F.lit(25)) == 0, "LICENSE").otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    level = [F.floor(number / 1000), F.pmod(F.floor(number / 100), F.lit(10))]
    path = F.concat_ws("/", "source", *[x.cast("string") for x in level], name)
    files = read(spark, folder, "documents").select(number.alias("id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("id", "doc_id")


_OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""


@query("op7_embedding_dedup", _OP7_SQL)
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, folder, "embeddings"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_rows(read(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_SPACE = r"[\x20\x09-\x0D]"
_OP9_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_number() OVER () AS r, doc_id, text,
    regexp_extract_all(text, '{WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM t
), runs AS (
  SELECT r, i, list_slice(words, i, i + 7) AS run
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, i - coalesce(before, i - 8))) AS n_repeat_words
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r
), facts AS (
  SELECT doc_id, text, len(lines) AS n_lines, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars > n_words * 20 OR word_chars < n_words * 2
    OR n_dup_lines * 2 > n_lines
    OR len(regexp_extract_all(text || chr(10), '(?:\.\.\.|\x{{2026}})\n')) * 10 > n_lines * 3
    OR len(regexp_extract_all(text, '\p{{L}}')) * 10 < word_chars * 6
    OR len(regexp_extract_all(text, '\p{{Lu}}')) * 10 > word_chars * 6) AS kept
FROM judged
"""


@query("op9_quality_rules", _OP9_SQL)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    rest = remainder_of_crc(F.col("doc_id"), 5)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    done = quality_classifier.classify(docs, read(spark, folder, "labels"), rest != 0)
    return done.select(
        "row.doc_id",
        (remainder_of_crc(F.col("row.doc_id"), 5) == 0).alias("held_out"),
        "score",
        "predicted",
    )


_OP11_ORDERS = [("".join(p), i + 1, p[i], "".join(p[:i])) for p in itertools.permutations("ABCDE") for i in range(5)]
_OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d LEFT JOIN l USING (doc_id)
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM w
), o(filter_order, step, own, before) AS (VALUES {", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in _OP11_ORDERS)}
), x AS (
  SELECT part, filter_order, step, own, contains(failed, own) AS fails, failed = own AS alone, good, toxic,
    len(list_filter(string_split(before, ''), lambda b: contains(failed, b) AND b <> '')) > 0 AS gone, count(*) AS n
  FROM f, o GROUP BY ALL
), s AS (
  SELECT part, filter_order, step::INT AS step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM s
"""


@query("op11_filter_audit", _OP11_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(spark, f"{folder}/documents.parquet", read(spark, folder, "labels"))


@query("op12_disclosure")
def op12_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.find(read(spark, folder, "documents"))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


_OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), t AS (
  SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang
), i AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (
  SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k FROM i, range(1, 6) AS r(k) WHERE i + k - 1 <= len(words)
), f AS (
  SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, n, cut, x.a AS l, y.a AS r, (1000 * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
), inside AS (
  SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1) x
  ANTI JOIN (SELECT f.* FROM f JOIN inside USING (lang, phrase) WHERE 100 * held >= 100 * f.a) d USING (lang, phrase)
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query("op13_collocations", _OP13_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))
