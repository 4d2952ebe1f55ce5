"""Common SQL of the checks: the same views, splits, predictors and features for another engine."""

POSITIONS = {
    "orders": """select 'orders' as file, o_orderkey as read_id,
  cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as int) as pos,
  cast(floor(l_quantity) as int) as observed, cast(l_linenumber as varchar) as pred_key
from orders join lineitem on l_orderkey = o_orderkey""",
    "events": """select 'events' as file, user_id as read_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as pos,
  cast(floor(least(value, 94)) as int) as observed, event_type as pred_key
from events""",
    "documents": r"""select 'documents' as file, doc_id as read_id, cast(i - 1 as int) as pos, ascii(cs[i]) - 33 as observed, lang as pred_key
from (select doc_id, lang, cs, unnest(range(1, len(cs) + 1)) as i
      from (select doc_id, lang, string_split(regexp_replace(text, '[^\x21-\x7E]', '', 'g'), '') as cs from documents))
where cs[i] <> ''""",
}
READS = {
    "orders": "select 'orders' as file, o_orderkey as read_id, cast(count(l_orderkey) as int) as length from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey",
    "events": "select 'events' as file, user_id as read_id, cast(count(*) as int) as length from events group by user_id",
    "documents": r"select 'documents' as file, doc_id as read_id, cast(length(regexp_replace(text, '[^\x21-\x7E]', '', 'g')) as int) as length from documents",
}


def sql(body: str, *views: str, fraction: float = 0.8) -> str:
    """body after common table expressions: pos, reads, split, pred, vec, feat."""
    pos = "\nunion all\n".join(POSITIONS[v] for v in views)
    reads = "\nunion all\n".join(READS[v] for v in views)
    return f"""
with pos as ({pos}),
reads as ({reads}),
split as (
  select file, min(read_id) as first_id, count(*) as n,
         greatest(1, least(count(*) - 1, cast(floor(count(*) * cast({fraction} as double)) as bigint))) as train_n
  from reads group by file),
cnt as (
  select file, pred_key, observed, sum(case when read_id < first_id + train_n then 1 else 0 end) as c
  from pos join split using (file) group by file, pred_key, observed),
pred as (
  select k.file, k.pred_key, cast(i.q as int) as q, cast(coalesce(c, 0) as double) as freq
  from (select distinct file, pred_key from pos) k cross join (select unnest(range(0, 95)) as q) i
  left join cnt on cnt.file = k.file and cnt.pred_key = k.pred_key and cnt.observed = i.q),
prob as (
  select *, freq / greatest(sum(freq) over (partition by file, pred_key), 1e-12::double) as p,
         max(freq) over (partition by file, pred_key) as top from pred),
vec as (
  select file, pred_key, min(case when freq = top then q end) as q_hat, max(p) as max_prob,
         -sum(p * ln(greatest(p, 1e-12::double))) / ln(95.0::double) + 0.0 as entropy, sum(p * q) / 94.0 as expected_q,
         sum(greatest(p, 1e-12::double)) as floored_sum
  from prob group by file, pred_key),
feat as (
  select pos.*, q_hat, max_prob, entropy, expected_q, floored_sum, p as p_true, freq as true_freq,
         observed - q_hat as residual, observed - q_hat + 94 as target
  from pos join vec using (file, pred_key) join prob on prob.file = pos.file and prob.pred_key = pos.pred_key and prob.q = pos.observed)
{body}
"""


TEST = "join split using (file) where read_id >= first_id + train_n"
