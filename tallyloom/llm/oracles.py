"""DuckDB SQL for the queries that SQL can express."""

#: The words of a text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_quality_rules": rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
win as (
  select rid, i, array_to_string(ws[i:i + 7], ' ') as w
  from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) >= 8)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from win) where c > 1),
rep as (
  select rid, sum(least(8, coalesce(nxt - i, 8)))::bigint as n
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from hit) group by rid),
m as (
  select doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join rep using (rid)),
f as (
  select *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint
         + 4 * (10 * n_symbols > 3 * n_words)::bigint + 8 * (2 * n_dup_lines > n_lines)::bigint
         + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 20 * n_words)::bigint)::bigint as failures
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, failures = 0 as kept, failures,
       2::bigint as policy_version
from f""",
    "op8_exact_dedup": f"""
with d as (select doc_id, sha256({_LOWER}) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*)::bigint as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, h as text_sha256 from d join g using (h)""",
    "op13_lexical_search": r"""
with t as (
  select row_number() over () as rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select rid, doc_id, term, count(*)::bigint as tf from t group by all),
len as (select rid, sum(tf)::bigint as n from p group by rid),
g as (select count(*)::bigint as nn, sum(n)::bigint as ll from len),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, g group by term, nn),
q as (
  select distinct qid, item_id, term from (
    select row_number() over () as qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
s as (
  select qid, item_id, rid, p.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from q join p using (term) join len using (rid) join w using (term) cross join g group by all),
r as (select item_id, doc_id, score, row_number() over (partition by qid order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50""",
    "op12_hard_negatives": """
with e as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
a as (select * from e where vec_id % 100 = 0),
s as (
  select a.rid as anchor, a.vec_id as anchor_id, a.label as anchor_label, e.rid, e.vec_id, e.label, list_dot_product(a.v, e.v)::bigint as score
  from a join e on a.rid <> e.rid),
p as (
  select * from (select *, row_number() over (partition by anchor order by score desc, vec_id, rid) as n from s where label = anchor_label) where n <= 5),
c as (
  select p.anchor, p.anchor_id, p.rid as positive, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor, p.rid order by s.score desc, s.vec_id, s.rid) as rank
  from p join s on p.anchor = s.anchor and s.label <> s.anchor_label and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from c where rank <= 5""",
}
