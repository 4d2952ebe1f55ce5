"""Queries over the sequence views, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualweave.constants import CONTEXT, SEED, SHIFT
from qualweave.functions import predictor, symbols
from qualweave.operators import collate, history, metrics, sampler, scores, sinks, split
from qualweave.plans.oracle import TEST, sql
from qualweave.sources import manifest as manifests
from qualweave.sources.views import VIEWS, Sequences, flat, predictors
from qualweave.session import ensure_workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return keep


def on(views: tuple[str, ...], name: str, body: str | None):
    """Registers f(view) as name_view for each view."""

    def keep(f: Callable[[Sequences], DataFrame]):
        for v in views:
            query(f"{name}_{v}", sql(body, v) if body else None)(lambda spark, sf, v=v: f(VIEWS[v](spark, sf)))
        return f

    return keep


def r(column, places: int = 6):
    return F.round(column, places)


def described(view: Sequences) -> DataFrame:
    return predictor.described(predictors(view))


def test_part(df: DataFrame, view: Sequences) -> DataFrame:
    return split.within(df, split.bounds(view.reads, "test"))


@on(
    ("orders", "events", "documents"),
    "manifest",
    """select file, cast(sum(length) as bigint) as row_count, count(*) as read_count, cast(sum(case when length = 0 then 1 else 0 end) as bigint) as empty_reads,
  min(case when length > 0 then length end) as min_length, max(case when length > 0 then length end) as max_length,
  round(avg(case when length > 0 then length end), 6) as mean_length from reads group by file""",
)
def manifest(view):
    return manifests.manifest(view.reads).withColumn("mean_length", r("mean_length"))


@on(("orders",), "offsets_from_reads", "select file, read_id, cast(sum(length) over (order by read_id) - length as bigint) as row_start, cast(sum(length) over (order by read_id) as bigint) as row_stop from reads")
def offsets_from_reads(view):
    return manifests.offsets(view.reads)


@on(("orders",), "reads_from_offsets", "select file, read_id, length from reads")
def reads_from_offsets(view):
    o = manifests.offsets(view.reads)
    ends = o.groupBy("file").agg(F.max("row_stop").alias("row"), (F.max("read_id") + 1).alias("idx"))
    return manifests.lengths(o.select("file", F.col("read_id").alias("idx"), F.col("row_start").alias("row")).unionByName(ends))


def boundaries(view: Sequences) -> DataFrame:
    """file, idx, row: the start of each read, counted from 0, and the end of the last."""
    o = manifests.offsets(view.reads)
    first = view.reads.groupBy("file").agg(F.min("read_id").alias("first"), F.count("*").alias("n"), F.sum("length").cast("long").alias("row"))
    starts = o.join(F.broadcast(first.select("file", "first")), "file").select("file", (F.col("read_id") - F.col("first")).alias("idx"), F.col("row_start").alias("row"))
    return starts.unionByName(first.select("file", F.col("n").alias("idx"), "row"))


#: The boundaries with every 700th moved, for another engine.
GIVEN = """, starts as (select file, read_id - min(read_id) over (partition by file) as idx, sum(length) over (partition by file order by read_id) - length as "row" from reads
union all select file, count(*), sum(length) from reads group by file), given as (select file, idx, "row" + case when idx % 700 = 5 then 50 else 0 end as "row" from starts)"""


@on(
    ("orders",),
    "validation_report",
    f"""{GIVEN}, bad as (select read_id, pos, case when read_id % 1000 = 1 and pos = 0 then -1 when read_id % 1000 = 2 and pos = 0 then 95 else observed end as observed
  from pos where not (read_id % 500 = 3 and pos = 0)), g as (select read_id, count(*) as n, max(pos) as top from bad group by read_id)
select 'observed_range' as "check", count(*) as violations from bad where observed not between 0 and 94
union all select 'negative_length', count(*) from reads where length < 0
union all select 'row_alignment', count(*) from reads full join g using (read_id) where coalesce(length, -1) <> coalesce(n, 0)
union all select 'dense_positions', count(*) from g where top <> n - 1
union all select 'all_reads_empty', count(*) from (select max(length) as m from reads) where m <= 0
union all select 'alphabet_width', count(*) from (select 1 where false)
union all select 'boundary_places', 0
union all select 'too_few_boundaries', count(*) from (select count(*) as n from given) where n < 2
union all select 'first_boundary', count(*) from (select min_by("row", idx) as f from given) where f <> 0
union all select 'falling_boundaries', count(*) from (select "row", lag("row") over (order by idx) as before from given) where before > "row"
union all select 'last_boundary', count(*) from (select max_by("row", idx) as l from given) where l <> (select count(*) from bad)""",
)
def validation_report(view):
    """Faults are put in: ids beyond the alphabet, rows left out, and boundaries moved, which then fall and miss the number of rows."""
    first, k = F.col("pos") == 0, F.col("read_id") % 1000
    bad = view.positions.withColumn("observed", F.when((k == 1) & first, -1).when((k == 2) & first, 95).otherwise(F.col("observed"))).where(~((F.col("read_id") % 500 == 3) & first))
    given = boundaries(view).withColumn("row", F.col("row") + F.when(F.col("idx") % 700 == 5, 50).otherwise(0))
    return manifests.violations(view.reads, bad, predictors(view), given)


@on(
    ("orders",),
    "boundary_report",
    f"""{GIVEN}, f as (select file, "row", idx, lag("row") over (partition by file order by idx) as before from given)
select file, cast(0 as bigint) as boundary_places, cast(count(*) < 2 as bigint) as too_few_boundaries, cast(min_by("row", idx) <> 0 as bigint) as first_boundary,
  cast(sum(case when before > "row" then 1 else 0 end) as bigint) as falling_boundaries,
  cast(max_by("row", idx) <> (select sum(length) from reads) as bigint) as last_boundary from f group by file""",
)
def boundary_report(view):
    given = boundaries(view).withColumn("row", F.col("row") + F.when(F.col("idx") % 700 == 5, 50).otherwise(0))
    return manifests.boundary_faults(given, view.reads.groupBy("file").agg(F.sum("length").alias("rows")))


@on(
    ("orders",),
    "flat_rows",
    """select file, read_id, cast(count(*) as bigint) as symbols, cast(sum((pos + 1) * (observed + 1)) as bigint) as digest, min(pred_key) as first_key
from pos group by file, read_id""",
)
def flat_rows(view):
    """The reads again from flat rows and boundaries."""
    starts = manifests.offsets(view.reads)
    rows = view.positions.join(starts.select("file", "read_id", "row_start"), ["file", "read_id"]).select("file", (F.col("row_start") + F.col("pos")).alias("row"), "observed", "pred_key")
    again = flat(rows, boundaries(view)).positions
    # Boundaries count reads from 0; ids of the view come back by rank, a join by place.
    ids = starts.select("file", "read_id", "row_start").where("row_stop > row_start")
    found = again.groupBy("file", F.col("read_id").alias("idx")).agg(F.count("*").alias("symbols"), F.sum((F.col("pos") + 1) * (F.col("observed") + 1)).cast("long").alias("digest"), F.min("pred_key").alias("first_key"))
    named = boundaries(view).join(ids.withColumnRenamed("row_start", "row"), ["file", "row"]).groupBy("file", "read_id").agg(F.max("idx").alias("idx"))
    return found.join(named, ["file", "idx"]).select("file", "read_id", "symbols", "digest", "first_key")


@on(
    ("orders", "events"),
    "split_summary",
    """select file, case when read_id < first_id + train_n then 'train' else 'test' end as split, count(*) as reads,
  cast(sum(case when length = 0 then 1 else 0 end) as bigint) as empty_reads, cast(sum(length) as bigint) as symbols
from reads join split using (file) group by 1, 2""",
)
def split_summary(view):
    parts = [split.within(view.reads, split.bounds(view.reads, s)).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("file", "split").agg(F.count("*").alias("reads"), F.sum((F.col("length") == 0).cast("long")).alias("empty_reads"), F.sum("length").cast("long").alias("symbols"))


@on(
    ("orders",),
    "read_range_scan",
    """, o as (select read_id, sum(length) over (order by read_id) - length as s from reads)
select pos.read_id, pos, cast(o.s - (select min(s) from o where read_id >= 100) + pos as bigint) as row_idx, observed
from pos join o using (read_id) where read_id >= 100 and read_id < 200""",
)
def read_range_scan(view):
    return split.read_range(view.positions, manifests.offsets(view.reads), 100, 200).select("read_id", "pos", "row_idx", "observed")


@on(("orders",), "read_limit", "select read_id, length from reads join split using (file) where read_id >= first_id + train_n and read_id < first_id + train_n + 50")
def read_limit(view):
    return split.within(view.reads, split.bounds(view.reads, "test", max_reads=50)).select("read_id", "length")


@on(
    ("orders",),
    "nonempty_reads",
    "select read_id, length, cast(sum(length) over (order by read_id) - length as bigint) as row_start from reads where length > 0",
)
def nonempty_reads(view):
    kept = split.nonempty(view.reads)
    return kept.join(manifests.offsets(kept), ["file", "read_id"]).select("read_id", "length", "row_start")


BATCHES = """select file, cast(floor((read_id - first_id - train_n) / 64) as bigint) as batch_id, min(read_id) as first_read, count(*) as reads,
  cast(sum(case when length > 0 then 1 else 0 end) as bigint) as kept_reads, cast(sum(length) as bigint) as symbols, max(length) as width,
  cast(sum(case when length > 0 then 1 else 0 end) * max(length) - sum(length) as bigint) as padded
from reads join split using (file) where read_id >= first_id + train_n group by 1, 2 having max(length) > 0"""


@on(("orders",), "sequential_batches", BATCHES)
def sequential_batches(view):
    return split.batches(view.reads, split.bounds(view.reads, "test"), 64)


@on(("orders", "events"), "padding_stats", f"select file, count(*) as batches, cast(sum(symbols) as bigint) as symbols, cast(sum(padded) as bigint) as padded from ({BATCHES}) group by file")
def padding_stats(view):
    return split.batches(view.reads, split.bounds(view.reads, "test"), 64).groupBy("file").agg(F.count("*").alias("batches"), F.sum("symbols").alias("symbols"), F.sum("padded").alias("padded"))


@query("sampling_weights", sql("select file, train_n, round(train_n / sum(train_n) over (), 9) as weight from split", "orders", "events"))
def sampling_weights(spark, sf):
    reads = VIEWS["orders"](spark, sf).reads.unionByName(VIEWS["events"](spark, sf).reads)
    return split.sampling_weights(reads).withColumn("weight", r("weight", 9))


def drawn_sql(steps: int, batch_reads: int, length: str) -> str:
    """Blocks of all steps and tries, and of each step the first with a symbol; length: an expression of reads."""
    number = lambda purpose: f"cast('0x' || substr(md5('{SEED}:' || step || ':' || try || ':{purpose}'), 1, 15) as bigint)"
    return f"""
, files as (select file, first_id, train_n, sum(train_n) over (order by file) - train_n as before, sum(train_n) over () as total from split),
draws as (select step, try, {number("file")} as u, {number("start")} as v from (select unnest(range(0, {steps})) as step) cross join (select unnest(range(0, {sampler.TRIES})) as try)),
blocks as (
  select step, try, file, first_id + v % (train_n - least({batch_reads}, train_n) + 1) as start, least({batch_reads}, train_n) as size
  from draws join files on u % total >= before and u % total < before + train_n),
o as (select file, read_id, sum({length}) over (partition by file order by read_id) as upto, {length} as length from reads),
full_ as (
  select blocks.*, row_number() over (partition by step order by try) as k from blocks
  join o a on a.file = blocks.file and a.read_id = start join o b on b.file = blocks.file and b.read_id = start + size - 1
  where b.upto > a.upto - a.length)
select step, file, cast(start as bigint) as start, cast(start + size as bigint) as stop from full_ where k = 1"""


@query("sampler_plan", sql(drawn_sql(20, 64, "length"), "orders", "events"))
def sampler_plan(spark, sf):
    reads = VIEWS["orders"](spark, sf).reads.unionByName(VIEWS["events"](spark, sf).reads)
    return sampler.plan(spark, reads, 20, 64)


@query("sampler_retries", sql(drawn_sql(200, 2, "(case when read_id % 8 = 3 then length else 0 end)"), "orders", "events"))
def sampler_retries(spark, sf):
    """Most blocks are empty here, so steps draw again."""
    reads = VIEWS["orders"](spark, sf).reads.unionByName(VIEWS["events"](spark, sf).reads)
    return sampler.plan(spark, reads.withColumn("length", F.when(F.col("read_id") % 8 == 3, F.col("length")).otherwise(0)), 200, 2)


BOUNDS = f"[{', '.join(map(str, collate.bucket_bounds()))}]"


@on(
    ("events",),
    "padded_batches",
    f""", kept as (select file, read_id, length, read_id // {collate.BLOCK_READS} as block, len(list_filter({BOUNDS}, lambda b: b < length)) as bucket
  from reads join split using (file) where read_id >= first_id + train_n and length > 0),
placed as (select *, (row_number() over (partition by file, block, bucket order by read_id) - 1) // 8 as part from kept),
shape as (select file, block, bucket, part, max(length) as width from placed group by all),
cells as (select *, unnest(range(0, width)) as pos from placed join shape using (file, block, bucket, part)),
hist as (select *, lag(observed, 1, 95) over w as prev_q, lag(target, 1, 189) over w as prev_r from feat window w as (partition by file, read_id order by pos)),
filled as (select c.*, coalesce(q_hat, 0) as q, coalesce(prev_q, 95) as pq, coalesce(prev_r, 189) as pr, coalesce(target, -100) as t, h.pos is not null as v
  from cells c left join hist h on h.file = c.file and h.read_id = c.read_id and h.pos = c.pos)
select file, cast(block as bigint) as block, cast(bucket as int) as bucket, cast(part as int) as part, cast(max(width) as int) as width,
  string_agg(case when pos = 0 then cast(read_id as varchar) end, ',' order by read_id, pos) as read_ids, string_agg(case when pos = 0 then cast(length as varchar) end, ',' order by read_id, pos) as lengths,
  string_agg(cast(v as varchar), ',' order by read_id, pos) as valid, string_agg(cast(q as varchar), ',' order by read_id, pos) as q_hat, string_agg(cast(pq as varchar), ',' order by read_id, pos) as prev_q,
  string_agg(cast(pr as varchar), ',' order by read_id, pos) as prev_r, string_agg(cast(t as varchar), ',' order by read_id, pos) as target
from filled group by file, block, bucket, part""",
)
def padded_batches(view):
    """Dense batches of the test reads; arrays are written as text, so that other engines compare alike."""
    feat = history.previous(test_part(scores.features(view), view))
    out = collate.padded(feat, test_part(view.reads, view), batch_reads=8)
    return out.select("file", "block", "bucket", "part", "width", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("read_ids", "lengths", "valid", *collate.FILLS)])


@on(("events",), "six_decimals", "select read_id, pos, printf('%.6f', (observed * 2 + 1) / 128.0::double) as half, printf('%.6f', -(target + 0.1::double) / 3) as third, printf('%.6f', (observed + 1) * 1e17::double / 7) as large from feat")
def six_decimals(view):
    o, t = F.col("observed"), F.col("target")
    values = {"half": (o * 2 + 1) / F.lit(128.0), "third": -(t + F.lit(0.1)) / 3, "large": (o + 1) * F.lit(1e17) / 7}
    return scores.features(view).select("read_id", "pos", *[sinks.decimals(v).alias(c) for c, v in values.items()])


@on(("events",), "normalized_probs", "select file, pred_key, q, round(p, 9) as prob, round(ln(greatest(p, 1e-12::double)), 6) as log_prob from prob")
def normalized_probs(view):
    return described(view).select("file", "pred_key", F.posexplode("probs").alias("q", "p")).select("file", "pred_key", "q", r("p", 9).alias("prob"), r(F.ln(predictor.floored(F.col("p")))).alias("log_prob"))


@on(("orders", "events"), "argmax_quality", "select file, pred_key, q_hat, round(max_prob, 9) as max_prob from vec")
def argmax_quality(view):
    return described(view).select("file", "pred_key", "q_hat", r("max_prob", 9).alias("max_prob"))


@on(("events",), "entropy_expectation", "select file, pred_key, round(entropy, 6) as entropy, round(expected_q, 6) as expected_q from vec")
def entropy_expectation(view):
    return described(view).select("file", "pred_key", r("entropy").alias("entropy"), r("expected_q").alias("expected_q"))


@on(("orders", "events"), "residual_targets", "select file, read_id, pos, residual, target from feat")
def residual_targets(view):
    return scores.features(view).select("file", "read_id", "pos", "residual", "target")


@on(
    ("events",),
    "residual_log_probs",
    """select v.file, v.pred_key, cast(r.r as int) as residual, round(ln(greatest(coalesce(p, 0), 1e-12::double)), 6) as log_prob
from vec v cross join (select unnest(range(-94, 95)) as r) r left join prob on prob.file = v.file and prob.pred_key = v.pred_key and prob.q = v.q_hat + r.r""",
)
def residual_log_probs(view):
    logs = described(view).select("file", "pred_key", F.posexplode(predictor.residual_log_probs(F.col("probs"), F.col("q_hat"))).alias("c", "v"))
    return logs.select("file", "pred_key", (F.col("c") - SHIFT).alias("residual"), r("v").alias("log_prob"))


@on(
    ("orders",),
    "position_features",
    "select read_id, pos, round(pos / greatest(length - 1, 1), 9) as rel_pos, round(least(length, 10000) / 10000, 9) as len_norm from pos join reads using (file, read_id)",
)
def position_features(view):
    df = split.with_length(view.positions, view.reads)
    return df.select("read_id", "pos", r(symbols.relative_position(F.col("pos"), F.col("length")), 9).alias("rel_pos"), r(symbols.length_norm(F.col("length")), 9).alias("len_norm"))


@on(
    ("documents",),
    "position_features_by_read",
    "select read_id, round(sum(pos / greatest(length - 1, 1)), 4) as rel_pos, round(max(least(length, 10000) / 10000), 9) as len_norm from pos join reads using (file, read_id) group by read_id",
)
def position_features_by_read(view):
    df = split.with_length(view.positions, view.reads)
    return df.groupBy("read_id").agg(r(F.sum(symbols.relative_position(F.col("pos"), F.col("length"))), 4).alias("rel_pos"), r(F.max(symbols.length_norm(F.col("length"))), 9).alias("len_norm"))


Q_BUCKET = "cast(case when observed <= 9 then 0 when observed <= 19 then 1 when observed <= 24 then 2 when observed <= 29 then 3 when observed <= 34 then 4 when observed <= 39 then 5 else 6 end as int)"
R_BUCKET = "cast(least(10, greatest(0, residual + 5)) as int)"


@on(("events",), "quality_buckets", f"select read_id, pos, observed, {Q_BUCKET} as bucket from pos")
def quality_buckets(view):
    return view.positions.select("read_id", "pos", "observed", symbols.quality_bucket(F.col("observed")).alias("bucket"))


@on(("events",), "residual_buckets", f"select read_id, pos, residual, {R_BUCKET} as bucket from feat")
def residual_buckets(view):
    return scores.features(view).select("read_id", "pos", "residual", symbols.residual_bucket(F.col("residual")).alias("bucket"))


@on(("events",), "previous_symbols", "select read_id, pos, lag(observed, 1, 95) over w as prev_q, lag(target, 1, 189) over w as prev_r from feat window w as (partition by file, read_id order by pos)")
def previous_symbols(view):
    return history.previous(scores.features(view)).select("read_id", "pos", "prev_q", "prev_r")


def token_sql(bucket: str, source: str, ks: tuple[int, ...], stride: int, base: int, bos: int, vocab: int, names: list[str]) -> str:
    def one(k: int) -> str:
        code = "0"
        for step in range(k, 0, -1):
            code = f"(({code}) * {base} + lag(b, {step * stride}, {bos}) over w) % {vocab}"
        return f"cast({code} as int)"

    columns = ", ".join(f"{one(k)} as {n}" for k, n in zip(ks, names, strict=True))
    return f"select read_id, pos, {columns} from (select *, {bucket} as b from {source}) window w as (partition by file, read_id order by pos)"


@on(("events",), "qmer_tokens", token_sql(Q_BUCKET, "pos", (2, 3, 4), 1, 8, 7, 4096, ["q2", "q3", "q4"]))
def qmer_tokens(view):
    return history.tokens(view.positions, "q").select("read_id", "pos", F.col("qmer_0").alias("q2"), F.col("qmer_1").alias("q3"), F.col("qmer_2").alias("q4"))


@on(("events",), "rmer_tokens", token_sql(R_BUCKET, "feat", (2, 3, 4, 6), 1, 12, 11, 4096, ["r2", "r3", "r4", "r6"]))
def rmer_tokens(view):
    return history.tokens(scores.features(view), "r").select("read_id", "pos", *[F.col(f"rmer_{i}").alias(f"r{k}") for i, k in enumerate((2, 3, 4, 6))])


@on(("events",), "mer_stride_vocab", token_sql(Q_BUCKET, "pos", (3, 5), 2, 8, 7, 1000, ["q3", "q5"]))
def mer_stride_vocab(view):
    return history.tokens(view.positions, "q", (3, -1, 5), stride=2, vocab=1000).select("read_id", "pos", F.col("qmer_0").alias("q3"), F.col("qmer_1").alias("q5"))


@on(("events",), "mer_disabled", "select read_id, pos, observed from pos")
def mer_disabled(view):
    return history.tokens(view.positions, "q", ()).select("read_id", "pos", "observed")


@on(
    ("orders", "events"),
    "baseline_bits",
    f"select file, count(*) as symbols, round(sum(-log2(greatest(p_true, 1e-12::double))), 4) as total_bits, round(avg(-log2(greatest(p_true, 1e-12::double))), 6) as avg_bits from feat {TEST} group by file",
)
def baseline_bits(view):
    b = -F.log2(predictor.floored(F.col("p_true")))
    return test_part(scores.features(view), view).groupBy("file").agg(F.count("*").alias("symbols"), r(F.sum(b), 4).alias("total_bits"), r(F.avg(b)).alias("avg_bits"))


@on(("orders", "events"), "zero_true_freq", f"select file, count(*) as symbols, cast(sum(case when true_freq <= 0 then 1 else 0 end) as bigint) as zeros from feat {TEST} group by file")
def zero_true_freq(view):
    return test_part(scores.features(view), view).groupBy("file").agg(F.count("*").alias("symbols"), F.sum((F.col("true_freq") <= 0).cast("long")).alias("zeros"))


@on(("events",), "legal_residual_mask", "select pred_key, q_hat, cast(c.c as int) as class, c.c - 94 + q_hat between 0 and 94 as legal from vec cross join (select unnest(range(0, 189)) as c) c")
def legal_residual_mask(view):
    return described(view).select("pred_key", "q_hat", F.posexplode(symbols.legal(F.col("q_hat"))).alias("class", "legal"))


@on(("events", "documents"), "attention_window", f"select read_id, cast(sum(least(pos + 1, {CONTEXT})) as bigint) as attended from pos group by read_id")
def attention_window(view):
    return split.nonempty(view.reads).select("read_id", history.attention_span(F.col("length"), CONTEXT).alias("attended"))


@query(
    "position_encoding",
    sql(
        """select p.pos as pos, cast(d.d as int) as dim,
  round(case when d.d % 2 = 0 then sin(p.pos * exp(d.d * (-ln(10000.0::double) / 7))) else cos(p.pos * exp((d.d - 1) * (-ln(10000.0::double) / 7))) end, 6) as value
from (select distinct pos from pos) p cross join (select unnest(range(0, 7)) as d) d""",
        "events",
    ),
)
def position_encoding(spark, sf):
    """Of each place that a read has."""
    angle = F.col("pos") * F.exp((F.col("dim") - F.col("dim") % 2) * (-F.ln(F.lit(10_000.0)) / 7))
    cells = VIEWS["events"](spark, sf).positions.select("pos").distinct().select("pos", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dim"))
    return cells.select("pos", "dim", r(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))).alias("value"))


def metrics_sql(model_prob: str, groups: str = "file") -> str:
    g = f"{groups}, " if groups else ""
    return f"""select {g}total_symbols, round(m, 3) as model_total_bits, round(m / total_symbols, 6) as model_avg_bits_per_quality, round(b, 3) as h5_baseline_total_bits,
  round(b / total_symbols, 6) as h5_baseline_avg_bits_per_quality, round(m / total_symbols - b / total_symbols, 6) as delta_bits,
  round((b / total_symbols - m / total_symbols) / (b / total_symbols), 6) as relative_improvement, zero_true_freq
from (select {g}count(*) as total_symbols, sum(-log2({model_prob})) as m, sum(-log2(greatest(p_true, 1e-12::double))) as b,
        cast(sum(case when true_freq <= 0 then 1 else 0 end) as bigint) as zero_true_freq
      from feat {TEST} {f'group by {groups}' if groups else ''})"""


def rounded_metrics(df: DataFrame) -> DataFrame:
    places = {"model_total_bits": 3, "h5_baseline_total_bits": 3, "model_avg_bits_per_quality": 6, "h5_baseline_avg_bits_per_quality": 6, "delta_bits": 6, "relative_improvement": 6}
    return df.withColumns({c: r(c, n) for c, n in places.items()})


@on(("orders", "events"), "uniform_metrics", metrics_sql("1.0::double / 95"))
def uniform_metrics(view):
    return rounded_metrics(metrics.compression(scores.bits(scores.uniform(test_part(scores.features(view), view)))))


PREDICTED = "greatest(p_true, 1e-12::double) / floored_sum"


@on(("orders", "events"), "predictor_metrics", metrics_sql(PREDICTED))
def predictor_metrics(view):
    return rounded_metrics(metrics.compression(scores.bits(scores.by_predictor(test_part(scores.features(view), view)))))


@query("global_metrics", sql(metrics_sql(PREDICTED, ""), "orders", "events"))
def global_metrics(spark, sf):
    parts = [scores.bits(scores.by_predictor(test_part(scores.features(v), v))) for v in (VIEWS[n](spark, sf) for n in ("orders", "events"))]
    return rounded_metrics(metrics.compression(parts[0].unionByName(parts[1]), by_file=False))


#: Each read is a step of one of five epochs, with the predictor's loss.
STEPS = """, steps as (select read_id % 5 + 1 as epoch, avg(-ln(greatest(p_true, 1e-12::double))) as loss, count(*) as symbols, sum(-log2(greatest(p_true, 1e-12::double))) as baseline
  from feat group by file, read_id),
epochs as (select epoch, cast(sum(symbols) as bigint) as symbols, sum(loss * symbols) / sum(symbols) / ln(2.0::double) as train_bits, sum(baseline) / sum(symbols) as train_baseline_bits from steps group by epoch)"""


def steps(view: Sequences) -> DataFrame:
    p = predictor.floored(F.col("p_true"))
    return scores.features(view).groupBy("file", "read_id").agg(F.avg(-F.ln(p)).alias("loss"), F.count("*").alias("symbols"), F.sum(-F.log2(p)).alias("baseline_bits")).withColumn("epoch", F.col("read_id") % 5 + 1)


@query("epoch_average", sql(f"{STEPS} select epoch, symbols, round(train_bits, 6) as train_bits, round(train_baseline_bits, 6) as train_baseline_bits from epochs", "events"))
def epoch_average(spark, sf):
    return metrics.epoch_average(steps(VIEWS["events"](spark, sf))).withColumns({"train_bits": r("train_bits"), "train_baseline_bits": r("train_baseline_bits")})


@query(
    "best_epoch",
    sql(
        f"""{STEPS}, log as (select epoch, case when epoch = 3 then 'nan'::double else round(train_bits, 3) end as val_bits from epochs)
select epoch, val_bits from log where not isnan(val_bits) order by val_bits, epoch limit 1""",
        "events",
    ),
)
def best_epoch(spark, sf):
    """One epoch's value is made NaN, which never wins; values are rounded, so that equal ones go to the earliest."""
    log = metrics.epoch_average(steps(VIEWS["events"](spark, sf))).select("epoch", F.when(F.col("epoch") == 3, float("nan")).otherwise(r("train_bits", 3)).alias("val_bits"))
    return metrics.best_epoch(log)


@on(
    ("events",),
    "decoded_quality",
    """select read_id, pos, cast(least(94, greatest(0, q_hat + (observed % 9) * 12 - 48)) as int) as pred_quality,
  chr(cast(33 + least(94, greatest(0, q_hat + (observed % 9) * 12 - 48)) as int)) as pred_char, observed, chr(33 + observed) as true_char from feat""",
)
def decoded_quality(view):
    q = symbols.decoded(F.col("q_hat"), (F.col("observed") % 9) * 12 - 48)
    return scores.features(view).select("read_id", "pos", q.alias("pred_quality"), symbols.quality_char(q).alias("pred_char"), "observed", symbols.quality_char(F.col("observed")).alias("true_char"))


@on(
    ("events",),
    "sample_predictions",
    f""", s as (select read_id, row_number() over (order by read_id) - 1 as read_in_sample from reads join split using (file)
  where read_id >= first_id + train_n and read_id < first_id + train_n + 5 and length > 0)
select read_in_sample, pos as position_in_read, observed as observed_id, chr(33 + observed) as observed_char, q_hat, residual as true_residual, 0 as pred_residual,
  q_hat as pred_quality, chr(33 + q_hat) as pred_quality_char, round(greatest(max_prob, 1e-12::double) / floored_sum, 6) as pred_probability,
  round({PREDICTED}, 6) as model_true_prob, round(-log2({PREDICTED}), 6) as model_bits, round(greatest(p_true, 1e-12::double), 6) as h5_true_prob,
  round(-ln(greatest(p_true, 1e-12::double)) / ln(2.0::double), 6) as h5_bits from feat join s using (read_id)""",
)
def sample_predictions(view):
    reads = split.within(view.reads, split.bounds(view.reads, "test", max_reads=5))
    scored = scores.bits(scores.by_predictor(scores.features(view)))
    out = sinks.sample_rows(scored, reads)
    return out.withColumns({c: r(c) for c in ("pred_probability", "model_true_prob", "model_bits", "h5_true_prob", "h5_bits")})


@on(
    ("events",),
    "compact_log",
    f"""select read_id, pos, '{{' || q_hat || '}}{{' || chr(33 + q_hat) || '}}{{' || printf('%.6f', greatest(max_prob, 1e-12::double) / floored_sum) || '}}{{' || observed || '}}{{' || chr(33 + observed) || '}}' as line
from feat {TEST} order by read_id, pos limit 1000""",
)
def compact_log(view):
    return logged([view], 1000).select("read_id", "pos", "line")


def logged(views: list[Sequences], n: int) -> DataFrame:
    """The first n lines of the test reads; of the views' positions only the reads that hold them are read."""
    tests = [test_part(v.reads, v) for v in views]
    both = tests[0]
    for t in tests[1:]:
        both = both.unionByName(t)
    ranges = split.head(both, n)
    parts = [scores.by_predictor(scores.features(Sequences(split.within(v.reads, ranges), split.within(v.positions, ranges)), described(v))) for v in views]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return sinks.compact_lines(sinks.first_rows(scored, n, ["file", "read_id", "pos"]))


@query(
    "compact_log_files",
    sql(
        f"""select file, read_id, pos, '{{' || q_hat || '}}{{' || chr(33 + q_hat) || '}}{{' || printf('%.6f', greatest(max_prob, 1e-12::double) / floored_sum) || '}}{{' || observed || '}}{{' || chr(33 + observed) || '}}' as line
from feat {TEST} order by file, read_id, pos limit 3000""",
        "orders",
        "events",
    ),
)
def compact_log_files(spark, sf):
    """At the smaller sizes the log goes on in a second file."""
    return logged([VIEWS[n](spark, sf) for n in ("orders", "events")], 3000)


def small_network(view: Sequences, reads: int | None = None) -> DataFrame:
    """Positions of the test reads, or of the first ones, scored by a small network with seeded parameters."""
    from qualweave.plans import infer, network, packing

    ensure_workers(view.reads.sparkSession)
    config = network.Config(d_model=32, heads=2, layers=2, feedforward=48, context=16)
    ranges = split.bounds(view.reads, "test", max_reads=reads)
    return infer.score(packing.packed(view, described(view), config, ranges), config, network.create(config, 3))


@on(("events",), "network_bits", None)
def network_bits(view):
    """All test reads; tests compare the network with dense attention and finite differences."""
    return rounded_metrics(metrics.compression(small_network(view)))


@on(("events",), "network_samples", None)
def network_samples(view):
    reads = split.within(view.reads, split.bounds(view.reads, "test", max_reads=5))
    return sinks.sample_rows(small_network(view, 5), reads)
