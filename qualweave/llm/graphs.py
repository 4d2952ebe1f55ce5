"""Shared Spark pieces: connected components, joins on checked sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.session import cut, saved

#: At most this many ids (8 bytes each) are broadcast; beyond it, joins shuffle.
BROADCAST_IDS = 500_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if it has few rows; ids must be cheap to count (checkpointed)."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_text_each(base: DataFrame, key: str) -> DataFrame:
    """base (key, text) with one text for each key, the longest; ties by content. Texts of keys that don't repeat aren't shuffled."""
    twice = cut(base.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if twice.isEmpty():
        return base
    texts = base.join(sized(twice), key, "left_semi").groupBy(key).agg(F.max(F.struct(F.char_length("text").alias("n"), "text")).alias("t")).select(key, F.col("t.text").alias("text"))
    return base.join(sized(twice), key, "left_anti").unionByName(cut(texts))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each vertex's component. edges: a, b, without order.

    Each round a vertex takes the smallest label next to it, and then the label of that
    label, so a chain of n vertices takes about log2(n) rounds; each writes one
    row a vertex.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both)
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("moved")))
    while True:
        # Only vertices that moved can move others.
        moved = labels.where("moved").select(F.col("id").alias("b"), "label")
        near = both.join(moved, "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        taken = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        of = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = taken.join(of, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        labels = saved(jumped.select("id", "label", (F.col("label") < F.col("was")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("id", "label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) as components gives them, after further edges links (a, b).

    Only the components that links join are walked again, not the edges within them. Vertices
    without a label are components of their own so far.
    """
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    roots = components(cut(ends.distinct()))
    moved = labels.withColumnRenamed("label", "root").join(sized(roots.withColumnRenamed("id", "root")), "root", "left").select("id", F.coalesce("label", "root").alias("label"))
    return saved(moved.unionByName(roots.join(labels, "id", "left_anti")))
