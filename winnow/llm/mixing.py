"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.llm.common import WORD, numbered_rows, stored, text_or_empty

# Rows of a source that are put in order together, about.
ORDERED_TOGETHER = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def quality_weight(text: str = "text") -> Column:
    """1 for plain prose, less with the share of figures and marks, 0.1 at least."""
    marks = F.regexp_count(text_or_empty(text), F.lit("[0-9#*$%&|<>{}\\[\\]_=+/\\\\~^@]"))
    return F.greatest(F.lit(0.1), 1.0 - 5.0 * marks / F.greatest(F.length(text_or_empty(text)), F.lit(1)))


def with_keys(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, key): rows with their size and their sampling key.

    The key is exponential with the quality weight as its rate, so the k
    smallest keys are a sample without replacement in which a row of twice the
    weight is twice as likely to come first. It follows from doc_id and weight,
    so a rerun draws the same rows. A null or negative weight counts as 0.001.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rate = F.greatest(F.coalesce(quality_weight() if weight is None else weight, F.lit(0.001)), F.lit(0.001))
    return docs.select(
        F.struct("*").alias("row"),
        "doc_id",
        "source",
        word_count().alias("size"),
        (-F.log(uniform) / rate).alias("key"),
    )


def source_targets(
    sizes: DataFrame, pattern: tuple[float, ...], share: float = 1.0, most_epochs: float = 3.0
) -> DataFrame:
    """Add `target` to (source, source_size, ...): words that the mix should take of each source.

    Sources in code point order, null last, weigh as `pattern` says, over and
    over. `share` of all words is dealt out by weight; a target stops at
    `most_epochs` times its source's size, and the excess goes to the others by
    weight until none is above. Sources are rows of a table all along; only
    three sums per round reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered = numbered_rows(sizes, order, "_number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (F.col("_number") % len(pattern) + 1).cast("int"))
    limit = F.col("source_size") * float(most_epochs)
    rows = stored(numbered.select("*", weight.alias("_weight"), limit.alias("_limit")).drop("_number"), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, most_epochs) * total
    level = 0.0
    while True:
        # Sources that reach their limit at this level give the rest of the words to the others.
        above = F.col("_weight") * level >= F.col("_limit")
        full, weights = rows.agg(
            F.sum(F.when(above, F.col("_limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))
        ).first()
        if not weights or (budget - full) / weights <= level:
            break
        level = (budget - full) / weights
    target = F.when(above, F.col("_limit")).otherwise(F.col("_weight") * level)
    return rows.withColumn("target", target).drop("_weight", "_limit")


def plan_mix(keyed: DataFrame, pattern: tuple[float, ...], share: float = 1.0, most_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target, epochs, bins, scale, cut_bin, cut_key): how each source is taken.

    Whole epochs come first; of what is then left of the target, the rows with
    the smallest keys are taken while their midpoint lies within it. To find
    the last of them, rows are summed in bins of the key and only the bin in
    which the target falls is put in order, so no source is ordered in one
    task. Bins grow in number with the source.
    """
    rows = keyed.select("source", "size", "key")
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / ORDERED_TOGETHER)).alias("bins"),
        F.avg("key").alias("scale"),
    )
    targets = source_targets(sizes, pattern, share, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    rest = F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))
    targets = stored(
        targets.withColumn("epochs", whole.cast("bigint")).withColumn("rest", rest), "mix-targets"
    )
    binned = rows.join(targets.select(F.col("source").alias("_source"), "bins", "scale", "rest"), F.col("source").eqNullSafe(F.col("_source")))
    binned = binned.withColumn("bin", key_bin())
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    falls = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest"))
    cuts = stored(sums.filter(falls).select("source", F.col("bin").alias("cut_bin"), "before"), "mix-cuts")
    cuts_at = cuts.select(F.col("source").alias("_cut_source"), "cut_bin", "before")
    near = binned.join(cuts_at, F.col("source").eqNullSafe(F.col("_cut_source")) & (F.col("bin") == F.col("cut_bin")))
    by_key = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("middle", F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0)) + F.col("size") / 2)
    last = near.filter(F.col("middle") <= F.col("rest")).groupBy("source").agg(F.max("key").alias("cut_key"))
    ends = (
        cuts.alias("c")
        .join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left")
        .select(F.col("c.source").alias("_end_source"), "c.cut_bin", "l.cut_key")
    )
    joined = targets.join(ends, F.col("source").eqNullSafe(F.col("_end_source")), "left").drop("_end_source", "rest")
    return stored(joined, "mix-plan")


def key_bin() -> Column:
    """The bin of a key: even for keys that are exponential with the mean `scale`."""
    return F.floor((1.0 - F.exp(-F.col("key") / F.col("scale"))) * F.col("bins")).cast("bigint")


def with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the source's plan and `copies`, how often the mix takes the row.

    A whole number of epochs for every row, one more for those up to the cut.
    Rows that repeat share a key and are taken alike.
    """
    renamed = plan.withColumnRenamed("source", "_plan_source")
    joined = keyed.join(renamed, F.col("source").eqNullSafe(F.col("_plan_source"))).withColumn("_bin", key_bin())
    drawn = (F.col("_bin") < F.col("cut_bin")) | ((F.col("_bin") == F.col("cut_bin")) & (F.col("key") <= F.col("cut_key")))
    copies = F.col("epochs") + F.coalesce(drawn, F.lit(False)).cast("bigint")
    return joined.withColumn("copies", copies).drop("_plan_source", "_bin")


def mix(docs: DataFrame, pattern: tuple[float, ...], share: float = 1.0, most_epochs: float = 3.0, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The mixed table: each row of `docs` as often as the mix takes it, columns unchanged.

    `docs` has doc_id, text and source, and any other columns. A null text has
    no words; a source without words is left out of the mix; a null source is a
    source of its own. Texts are not shuffled for it unless sources are too
    many to be sent to all tasks.
    """
    keyed = with_keys(docs, seed, weight)
    plan = plan_mix(stored(keyed.drop("row"), "mix-keys"), pattern, share, most_epochs)
    taken = with_copies(keyed, plan).filter("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select("row.*")
