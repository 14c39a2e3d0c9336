"""What each query must return, in DuckDB SQL."""

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
with rows as (
  select doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') as t from documents
), groups as (
  select t, min(doc_id) as keep_id, count(*) as group_size from rows group by t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from rows join groups using (t)
"""


def _level(name: str, path: list[str], weight: str, budget: str) -> str:
    """Shares of the children at one level of the tree: {name}(path, budget)."""
    keys = ", ".join(path)
    parent = ", ".join(path[:-1])
    part = f"partition by {parent}" if parent else ""
    order = f"{part} order by room / weight, {path[-1]}"
    earlier = f"({order} rows between unbounded preceding and 1 preceding)"
    return f"""
{name}_nodes as (
  select {keys}, 4 * sum(supply) as room, {weight} as weight from leaves group by {keys}
), {name}_marked as (
  select n.*, budget, room * (sum(weight) over ({part}) - coalesce(sum(weight) over {earlier}, 0))
    <= weight * (budget - coalesce(sum(room) over {earlier}, 0)) as is_full
  from {budget}
), {name}_rest as (
  select *, budget - sum(case when is_full then room else 0 end) over ({part}) as rest,
    sum(case when is_full then 0 else weight end) over ({part}) as open_weight,
    sum(case when is_full then 0 else weight end) over ({order}
      rows between unbounded preceding and current row) as upto
  from {name}_marked
), {name} as (
  select {keys}, case when is_full then room
    else upto * rest // open_weight - (upto - weight) * rest // open_weight end as budget
  from {name}_rest
)"""


MIXING = rf"""
with counted as (
  select doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) // 5),
      '(none)') as domain,
    coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as n_tokens
  from documents
), leaves as (
  select domain, lang, source, sum(n_tokens) as supply from counted group by all
), {_level("by_domain", ["domain"],
           "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end",
           "by_domain_nodes n, (select sum(supply) * 6 // 10 as budget from leaves)")}
, {_level("by_lang", ["domain", "lang"],
          "case when domain not in ('d0', 'd1', 'd2', 'd3') then 1 "
          "when lang = 'en' then 4 when lang = 'de' then 2 else 1 end",
          "by_lang_nodes n join by_domain using (domain)")}
, {_level("by_source", ["domain", "lang", "source"],
          "case when domain = 'd0' and lang = 'en' and source = 'src0' then 3 else 1 end",
          "by_source_nodes n join by_lang using (domain, lang)")}
, planned as (
  select c.*, budget as leaf_budget, budget // supply as epochs, budget % supply as rest,
    md5(concat_ws('-', '17', budget // supply, doc_id)) as digest
  from counted c join by_source using (domain, lang, source)
    join leaves using (domain, lang, source)
), running as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by digest, doc_id
    rows between unbounded preceding and current row) - n_tokens as before
  from planned
), taken as (
  select *, greatest(least(n_tokens, rest - before), 0) as last from running
)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens,
  leaf_budget::bigint as leaf_budget, epochs::bigint as epochs,
  last::bigint as last_epoch_tokens, (epochs * n_tokens + last)::bigint as tokens_taken
from taken
"""

HARD_NEGATIVES = """
with numbered as (
  select row_number() over () as r, vec_id, embedding,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings where label is not null and embedding is not null
), components as (
  select r, vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding) as x
  from numbered
), taking_part as (
  select r from components group by r having bool_and(x is not null and isfinite(x))
), cells as (
  select r, vec_id, label, i, floor(256 * x::double)::bigint as x
  from components join taking_part using (r)
), scores as (
  select a.r as anchor, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    sum(a.x * c.x)::bigint as score
  from cells a join cells c on a.i = c.i and a.r <> c.r
  where a.vec_id % 50 = 0
  group by a.r, a.vec_id, a.label, c.r, c.vec_id, c.label
), positives as (
  select anchor, anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id,
  positive_score, score as negative_score
from positives join scores using (anchor, anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor, positive_id order by score desc, vec_id)
qualify row_number() over w <= 3
"""

FILTER_AUDIT = rf"""
with rows as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents
), firsts as (
  select t, min(doc_id) as first_id from rows group by t
), words as (
  select r.*, first_id, regexp_extract_all(t, '{WORD}') as words from rows r join firsts using (t)
), marked as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(words) < 100)::int
    + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(first_id < doc_id, false)::int as bits
  from words left join marked using (doc_id)
), counts as (
  select part, bits, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from failed group by part, bits
), letters(c, b) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select concat(a.c, b.c, c.c, d.c, e.c) as filter_order
  from letters a join letters b on b.c <> a.c join letters c on c.c not in (a.c, b.c)
    join letters d on d.c not in (a.c, b.c, c.c) join letters e on e.c not in (a.c, b.c, c.c, d.c)
), steps as (
  select filter_order, step, own.b as own, own.c as letter,
    coalesce((select sum(b) from letters where instr(filter_order[:step - 1], c) > 0), 0)::int
      as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as step) s
    join letters own on own.c = filter_order[step]
), worked as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (bits & (own | earlier) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (bits & own <> 0 and bits & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (bits & own <> 0 and bits & earlier <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (bits = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (bits & own <> 0 and bits & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (bits & own <> 0 and bits & earlier = 0), 0)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, letter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from worked
"""

ORACLE = {
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_filter_audit": FILTER_AUDIT,
    "op2_mixing": MIXING,
    "op5_exact_dedup": EXACT_DEDUP,
}
