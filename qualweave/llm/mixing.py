"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Each source has a budget of words. A document's hash, taken from its id alone, is
a point on a line of 2**60; a source takes the documents up to a threshold on that
line. Words are summed by source and hash bucket, the bucket in which the running
sum crosses the budget is found, and only that bucket is refined by further bits.
Thresholds nest: a larger budget takes a superset. Budgets over a source's size
take every document once and the rest of the budget by threshold a second time.

Defined cases: null text has size 0; null source is a source of its own, the last;
rows that repeat an id are taken together; a source without words takes none, and
a text without words isn't in the mix unless its hash lies under the threshold; a text
is counted whole, however long; an empty table gives an empty result; other columns
are ignored by mix and carried along by mixed, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualweave.llm.graphs import free
from qualweave.llm.graphs import sized as few
from qualweave.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: Bits of the hash used up by each level of refinement; 60 in all.
LEVELS = (12, 24, 24)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; any engine can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. sources: source, source_size, one row each; a small table, as wide as the list of sources.

    The water level L solves sum(min(most * size, L * weight)) = share * total. Sources
    fill up in the order of cap / weight. Taking the first k of them as full leaves a
    level for the rest; while k grows, the first level under which no other source
    is over its cap is the right one, and later ones are lower, so it's the largest
    of the levels that fit. Targets are a budget times a weight over a weight, each
    exact, so that any engine rounds them alike.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("budget", F.least(share * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    w = w.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("open")
    water = F.max(F.when(fits, F.struct((F.col("left") / F.col("open")).alias("level"), "left", "open"))).over(everything)
    poured = F.col("water.left") * F.col("weight") / F.col("water.open")
    return w.withColumn("water", water).select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", poured)).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: of the two hashes around the point where the running sum of words crosses the budget, that which comes nearer; the lower of equals.

    sized: source, size, h. budgets: source, budget.
    """
    shift = sum(LEVELS)
    found = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("open"))
    for level, bits in enumerate(LEVELS):
        above, shift = shift, shift - bits
        state = found.withColumnsRenamed({"source": "s_source"})
        inside = sized if level == 0 else sized.join(state, _same(F.col("source"), F.col("s_source")) & F.col("open") & (F.shiftright("h", above) == F.col("prefix")), "left_semi")
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = histogram.withColumn("upto", F.sum("words").over(upto))
        crossed = (
            sums.join(state, _same(F.col("source"), F.col("s_source")) & F.col("open"))
            .groupBy("source")
            .agg(
                F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("crossing"),
                F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("below"),
                F.min(F.when(F.col("upto") > F.col("left"), F.col("upto") - F.col("left"))).alias("excess"),
            )
            .withColumnsRenamed({"source": "c_source"})
        )
        # Without a crossing the whole range fits, and the prefix moves past its end.
        after = (F.col("prefix") + 1) * (1 << bits)
        below = F.coalesce("below", F.lit(0))
        nearer = (F.lit(level == len(LEVELS) - 1) & (F.col("excess") < F.col("left") - below)).cast("long")
        found = cut(
            found.join(crossed, _same(F.col("source"), F.col("c_source")), "left").select(
                "source",
                F.when(F.col("open"), F.col("left") - below).otherwise(F.col("left")).alias("left"),
                F.when(~F.col("open"), F.col("prefix") * (1 << bits)).otherwise(F.coalesce(F.col("crossing") + nearer, after)).alias("prefix"),
                (F.col("open") & F.col("crossing").isNotNull()).alias("open"),
            )
        )
    return found.select("source", (F.col("prefix") - 1).alias("threshold"))


def _plan(sized: DataFrame, weights, share: float, most: int) -> DataFrame:
    """One row for each source: b_source, source_size, target, whole (times all are taken), threshold (of those taken once more)."""
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("whole", whole).withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    per_source = budgets.join(thresholds(sized.select("source", "size", "h"), budgets).withColumnRenamed("source", "t_source"), _same(F.col("source"), F.col("t_source")), "left")
    return cut(per_source.select(F.col("source").alias("b_source"), "source_size", "target", "whole", "threshold"))


def _times(h: Column, most: int) -> Column:
    return F.least(F.col("whole") + (h <= F.col("threshold")).cast("long"), F.lit(most))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """id, size, source_size, target, taken for each row of docs."""
    sized = cut(docs.select(F.col(id_col), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h")))
    plan = _plan(sized, weights, share, most)
    return sized.join(plan, _same(F.col("source"), F.col("b_source")), "left").select(id_col, "size", "source_size", "target", (_times(F.col("h"), most) * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs, all columns, each as many times as it is taken. Texts aren't shuffled while the sources are few."""
    light = cut(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h")))
    source, whole, threshold, time = free(docs, "mix_source", "mix_whole", "mix_threshold", "mix_time")
    plan = few(_plan(light, weights, share, most).select(F.col("b_source").alias(source), F.col("whole").alias(whole), F.col("threshold").alias(threshold)))
    times = F.least(F.col(whole) + (hash_of(F.col(id_col)) <= F.col(threshold)).cast("long"), F.lit(most))
    placed = docs.join(plan, _same(F.col(source_col), F.col(source))).where(times > 0)
    return placed.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
