"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Each query runs to the end through Spark's noop sink, so every row and column
is produced and nothing is written or collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.plans import QUERIES  # noqa: E402
from winnow.session import local_session  # noqa: E402

HEADLINE = [
    "screen_applications",
    "screen_all_pairs",
    "gap_report",
    "route_funnel",
    "skill_tagging",
    "role_tagging",
    "compress_text",
    "html_to_text",
    "tier_pick",
    "redact_pii",
    "page_assembly",
    "top_hits",
    "code_proofs",
    "recent_or_all",
    "commit_cards",
    "word_match_verify",
    "repo_payload_shapes",
    "profile_context",
    "prompt_render",
    "reply_parse",
    "cosine_topk",
    "vector_upsert",
    "term_search",
    "search_status",
    "skill_badges",
    "profile_fan_out",
    "stream_screen",
    "screen_arrivals",
]


def laid_out(spark, folder: str) -> str:
    """The tables with texts in several files, as large tables are, so that small ones use all cores."""
    copy = tempfile.mkdtemp(prefix="winnow-bench-")
    for name in os.listdir(folder):
        os.symlink(f"{os.path.abspath(folder)}/{name}", f"{copy}/{name}")
    for table in ("documents", "pages", "conversations"):
        rows = spark.read.parquet(f"{folder}/{table}.parquet").repartition(2 * spark.sparkContext.defaultParallelism)
        os.unlink(f"{copy}/{table}.parquet")
        rows.write.parquet(f"{copy}/{table}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "16g"})
    # Start-up of the JVM's readers is not a property of the first query.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    given, folder = folder, laid_out(spark, folder)
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(given)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
