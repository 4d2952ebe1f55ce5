"""Queries op1 to op13 and the pipeline, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualweave.llm import (
    exact_dedup,
    fingerprint,
    hard_negatives,
    html_diff,
    mixing,
    near_dedup,
    secret_forest,
    segment_search,
    sentencepiece_lattice,
    substring_chain,
    token_alignment,
    toxicity,
    url_trust,
)
from qualweave.session import ensure_workers, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), round_trip=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


OP3_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (select *, max(doc_id) over (partition by text_sha256) as keep_id,
             count(*) over (partition by text_sha256) as group_size from d)
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return substring_chain.passages(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# Targets by rounds, as the contract tells it: the budget of the sources that aren't full is shared by
# weight; those that would be over twice their size are full from then on; until none is.
OP8_SQL = r"""
with recursive d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, [3.0::double, 1.0::double, 2.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight
  from s
), r as (
  select 0 as round, source, source_size, weight, false as is_full, 1.5::double * sum(source_size) over () as pool, sum(weight) over () as weights, true as goes_on
  from w
  union all
  select round + 1, source, source_size, weight, now_full,
         pool - coalesce(sum(case when now_full and not is_full then 2.0 * source_size end) over (), 0),
         weights - coalesce(sum(case when now_full and not is_full then weight end) over (), 0),
         bool_or(now_full and not is_full) over ()
  from (select *, is_full or pool * weight > 2.0 * source_size * weights as now_full from r where goes_on)
), g as (
  select source, source_size, case when is_full then 2.0 * source_size else pool * weight / weights end as target
  from r where round = (select max(round) from r)
), b as (
  select *, cast(floor(target - whole * source_size) as bigint) as budget
  from (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from g)
), c as (
  select d.*, b.source_size, b.target, b.whole, b.budget,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto
  from d join b on d.source is not distinct from b.source
), x as (
  select *, min(case when upto > budget then upto end) over (partition by source) as above,
         coalesce(max(case when upto <= budget then upto end) over (partition by source), 0) as below,
         min(case when upto > budget then h end) over (partition by source) as crossing
  from c
)
select doc_id, size, source_size, target,
       cast(least(whole + case when upto <= budget or (h = crossing and above - budget < budget - below) then 1 else 0 end, 2) * size as bigint) as taken
from x
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return segment_search.top_k(table(spark, sf_dir, "embeddings"))


_FINITE = "embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))"

OP11_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as x
  from embeddings where vec_id is not null and {_FINITE}
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return token_alignment.link_counts(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


OP13_SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
  from embeddings where vec_id is not null and label is not null and {_FINITE}
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.x, c.x) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5
), n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
   and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_fingerprints": op10_fingerprints,
    "op11_segment_search": op11_segment_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op3_exact_dedup": OP3_SQL, "op8_mix_sources": OP8_SQL, "op11_segment_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}
