"""Oracle SQL: TF-IDF char 2-4-gram cosine kNN and indel ratio, in DuckDB."""

IGN = "('', 'none', 'null', 'nan', '-', 'na', 'n/a', 'undefined')"


def lcs(a: str, b: str) -> str:
    full = f"((1::bigint << len({a})) - 1)"
    return (f"(len({a}) - bit_count(list_reduce(list_transform(string_split({b}, ''), lambda ch: "
            f"list_sum(list_transform(range(len({a})), lambda i: case when {a}[i + 1] = ch then (1::bigint << i) "
            f"else 0::bigint end))), lambda v, mk: ((v + (v & mk)) | (v - (v & mk))) & {full}, {full})))")


def ratio(a: str, b: str) -> str:
    """round_even(2*LCS/(|a|+|b|), 4); 0 when either side is empty."""
    sa = f"(case when len({a}) <= len({b}) then {a} else {b} end)"
    sb = f"(case when len({a}) <= len({b}) then {b} else {a} end)"
    return (f"(case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0 "
            f"else round_even(2.0 * {lcs(sa, sb)} / (len({a}) + len({b})), 4) end)")


def tfidf_knn(prefix: str, queries: str, docs: str, n: int = 3) -> str:
    """CTEs computing top-n per (grp, q).

    queries: relation (grp, q); docs: relation (grp, doc_id, txt, ord).
    Produces ``{prefix}_top(grp, q, rank, doc_id, score)``.
    """
    return f"""
{prefix}_qt as (select distinct grp, q, regexp_replace(lower(q), '\\s\\s+', ' ', 'g') as t from {queries}),
{prefix}_dt as (select grp, doc_id, ord, regexp_replace(lower(txt), '\\s\\s+', ' ', 'g') as t from {docs}),
{prefix}_dg as (
  select grp, doc_id, substring(t, i, n) as g, count(*)::double as tf
  from {prefix}_dt, range(2, 5) r(n), generate_series(1, len(t) - n + 1) s(i)
  where len(t) >= n group by all),
{prefix}_n as (select grp, count(*) as nd from {prefix}_dt group by grp),
{prefix}_idf as (
  select g.grp, g.g, ln((1 + n.nd) / (1 + count(*))) + 1 as idf
  from {prefix}_dg g join {prefix}_n n using (grp) group by g.grp, g.g, n.nd),
{prefix}_dw as (
  select d.grp, d.doc_id, d.g, d.tf * i.idf as w from {prefix}_dg d join {prefix}_idf i using (grp, g)),
{prefix}_dwn as (
  select grp, doc_id, g, w / sqrt(sum(w * w) over (partition by grp, doc_id)) as w from {prefix}_dw),
{prefix}_qg as (
  select grp, q, substring(t, i, n) as g, count(*)::double as tf
  from {prefix}_qt, range(2, 5) r(n), generate_series(1, len(t) - n + 1) s(i)
  where len(t) >= n group by all),
{prefix}_qw as (
  select q.grp, q.q, q.g, q.tf * i.idf as w from {prefix}_qg q join {prefix}_idf i using (grp, g)),
{prefix}_qwn as (
  select grp, q, g, w / sqrt(sum(w * w) over (partition by grp, q)) as w from {prefix}_qw),
{prefix}_dot as (
  select q.grp, q.q, d.doc_id, sum(q.w * d.w) as s
  from {prefix}_qwn q join {prefix}_dwn d using (grp, g) group by q.grp, q.q, d.doc_id),
{prefix}_top as (
  select * from (
    select x.grp, x.q, x.doc_id, round_even(x.s, 4) as score,
           row_number() over (partition by x.grp, x.q order by round_even(x.s, 10) desc, dd.ord) as rank
    from {prefix}_dot x join {prefix}_dt dd using (grp, doc_id)) where rank <= {n})
"""


RECORD = f"""
qparts as (
  select exec_id, field, 0 as grp_o, '' as nm, value as x from pstatus where overall_invalid
  union all
  select exec_id, field, 1, meta_name, trim(meta_value) from payload
  where meta_name is not null and trim(meta_value) <> ''),
qsig as (
  select e.exec_id, e.field,
         lower(coalesce((select string_agg(x, ' ' order by grp_o, nm) from qparts p
                         where p.exec_id = e.exec_id and p.field = e.field and lower(x) not in {IGN}), '')) as q
  from pstatus e where e.overall_invalid),
sig_parts as (
  select r.ordinal, 0 as pos, r.value as x from recs r where r.value <> ''
  union all
  select c.ordinal, c.req_pos + 1, c.required from configs c),
sigs as (
  select r.field, r.ordinal, r.ml_id, r.value as primary_value,
         lower(coalesce((select string_agg(x, ' ' order by pos) from sig_parts p
                         where p.ordinal = r.ordinal and lower(x) not in {IGN}), '')) as signature
  from recs r where r.value <> ''),
rq as (select field as grp, q from qsig),
rd as (select field as grp, ordinal as doc_id, signature as txt, ordinal as ord from sigs),
{tfidf_knn('rk', 'rq', 'rd')},
rec_sug as (
  select s.exec_id, s.field, t.rank, g.ml_id, g.primary_value, t.score as overall_score, g.ordinal
  from qsig s join rk_top t on t.grp = s.field and t.q = s.q
  join sigs g on g.field = s.field and g.ordinal = t.doc_id)
"""
