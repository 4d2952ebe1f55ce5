"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A fingerprint is the sorted set of a text's five-word shingle hashes that lie in
the lowest 1/SCALE of the hash range. Unlike a sketch of fixed size it grows with
the text, so the sketch of a union is the union of the sketches, and the share of
a short text that a long one contains can be estimated from sketches alone.

Defined cases: null text is empty; a text of one to four words has one shingle of
all its words; a text without words has an empty fingerprint; two empty
fingerprints have likeness 1.0 if the texts are equal and 0.0 if not; a null id
comes first; rows that repeat an id follow each other in order of their text; a text
is sketched whole, however long; an empty table gives an empty result; other columns
are ignored, whatever their names. Beyond MOST_BUCKETS * BUCKET_CHARS characters
ranges of ids grow with the corpus; they are sorted and spilled by Spark.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 8
SHINGLE = 5
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_CHARS = 8 << 20
MOST_BUCKETS = 1 << 16


def add_fingerprint(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds an array of the retained hashes; each step is a column of its own so that no lambda repeats one."""
    words, hashes = f"__words_{name}", f"__hashes_{name}"
    df = df.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(SHINGLE)]))
    all_hashes = F.when(n >= SHINGLE, windows).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    last = -(1 << 63) + (1 << 64) // scale - 1
    return df.withColumn(name, F.array_sort(F.array_distinct(F.filter(all_hashes, lambda h: h <= last)))).drop(hashes)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ",")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(equal.cast("double"))


def _position(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by two levels of comparison."""
    if not bounds:
        return F.lit(0)
    step = ceil(sqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_most(F.lit([g[0] for g in groups]).cast("array<bigint>"))
    inner = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_most(inner)).cast("int")


def with_next(docs: DataFrame, id_col: str, carried: list[str], chars: str) -> DataFrame:
    """Each row with the carried columns of the next by id (after the last: the first), named next_*.

    Rows are dealt to ranges of ids of about BUCKET_CHARS characters; the first row
    of a range is also sent to the range before, so that every range is complete.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63))).cast("long")
    spark = docs.sparkSession
    total = docs.agg(F.sum(chars).alias("n"), F.count("*").alias("k")).first()
    fewest = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, total.k or 1, max(fewest, (total.n or 0) // BUCKET_CHARS))
    cuts = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx(key, cuts, max(10_000, 20 * buckets)).alias("b")).first().b if cuts else []
    bounds = sorted(set(found or []))
    bucket = _position(key, bounds)
    # One row a bucket, at most MOST_BUCKETS.
    firsts = sorted((r.bucket, r.first) for r in docs.select(key.alias("key"), bucket.alias("bucket")).groupBy("bucket").agg(F.min("key").alias("first")).collect())
    if not firsts:
        firsts = [(0, 0)]
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    previous = F.get(F.lit([before.get(b, 0) for b in range(len(bounds) + 1)]).cast("array<int>"), F.col("__bucket"))
    place = lambda b, wrap, guest: F.struct(b.alias("b"), F.lit(wrap).alias("wrap"), F.lit(guest).alias("guest"))
    first_id, own = firsts[0][1], place(F.col("__bucket"), 0, False)
    guests = F.when(F.col("__key") == first_id, F.array(own, place(F.lit(firsts[-1][0]), 1, True))).when(F.col("__key").isin([f for _, f in firsts]), F.array(own, place(previous, 0, True))).otherwise(F.array(own))
    placed = docs.withColumns({"__key": key, "__bucket": bucket}).withColumn("__place", F.explode(guests)).withColumns({"__b": F.col("__place.b"), "__wrap": F.col("__place.wrap"), "__guest": F.col("__place.guest")}).drop("__place", "__bucket")
    order = Window.partitionBy("__b").orderBy("__wrap", "__key", carried[0])
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("__guest")).drop("__b", "__wrap", "__key", "__guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_next for each row."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("n_chars", F.char_length("__text").cast("long"))
    sketched = add_fingerprint(base, "__text", "__fp", scale)
    # Sizes and bounds come from the plain columns; the sketches run once, in the last job.
    both = with_next(sketched, id_col, ["__text", "__fp"], "n_chars")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("__edited", F.concat(F.substr("__text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next___text", F.lit(1), half)))
    both = add_fingerprint(both, "__edited", "__edited_fp", scale)
    return both.select(
        id_col,
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__edited_fp"), F.col("__text") == F.col("__edited")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("next___fp"), F.col("__text") == F.col("next___text")).alias("near_next"),
        containment(F.col("__fp"), F.col("next___fp")).alias("contained_next"),
    )
