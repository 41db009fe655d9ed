"""Job pages: pick the first extraction that works."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from winnow.functions import html, text as t


def extract_pages(pages: DataFrame, html_column: str = "html", max_chars: int | None = None) -> DataFrame:
    """Add tier, title and text of the first usable extraction of each page.

    Tier 1 reads job-board postings only, tier 2 the whole body, tier 3 the
    page without its furniture. All three see the same row, so choosing needs
    no union and no shuffle, and later tiers run only if earlier ones fail.
    A page that none can read keeps its row with nulls. Texts are whole unless
    a length is given (`fixed_values.JD_TEXT_CAP` is a model's usual budget).
    """

    def tier(number: int, page):
        return F.when(
            page.isNotNull(), F.struct(F.lit(number).alias("tier"), page["title"], page["text"])
        )

    source = F.col(html_column)
    posting = F.when(t.is_job_posting(F.col("url")), html.job_posting(source, max_chars))
    rows = pages.withColumn("_p1", posting)
    rows = rows.withColumn("_p2", F.when(F.col("_p1").isNull(), html.body_text(source, max_chars)))
    missing = F.col("_p1").isNull() & F.col("_p2").isNull()
    rows = rows.withColumn("_p3", F.when(missing, html.web_page(source, max_chars)))
    chosen = F.coalesce(*[tier(n, F.col(f"_p{n}")) for n in (1, 2, 3)])
    rows = rows.withColumn("_page", chosen)
    return rows.select(*pages.columns, "_page.tier", "_page.title", "_page.text")


def pick_tier(extractions: DataFrame, key: str) -> DataFrame:
    """The lowest tier with text per key, from rows (key, tier, title, text) of separate tables."""
    usable = extractions.filter(F.coalesce("text", F.lit("")) != "")
    best = F.min(F.struct("tier", "title", "text")).alias("best")
    return usable.groupBy(key).agg(best).select(key, "best.*")


def latest_per_posting(pages: DataFrame) -> DataFrame:
    """One page per posting, the one with the largest page_id, whichever address led to it.

    Only ids are aggregated; the pages follow by id.
    """
    kept = pages.groupBy(t.job_posting_id(F.col("url")).alias("posting")).agg(
        F.max("page_id").alias("page_id")
    )
    return pages.join(kept, "page_id")


def infer_metadata(rows: DataFrame, text: str) -> DataFrame:
    """Title and required years guessed from seniority words."""
    return rows.withColumn("title", t.seniority_title(F.col(text))).withColumn(
        "years", t.seniority_years(F.col(text))
    )
