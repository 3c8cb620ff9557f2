"""Oracle SQL per registered query (DuckDB dialect; driver tables are views)."""

from __future__ import annotations

from oracles.scores import partial, ratio as ratio100, token_set, words
from oracles.fixture import CORES, CPU, FIXTURE, INST, RULES, VALIDATE, norm, with_ctes

BASE = with_ctes(FIXTURE, RULES)
FULL = with_ctes(FIXTURE, RULES, VALIDATE)

SQL: dict[str, str] = {}

SQL["rule_mappings"] = BASE + """
select m.field, m.path, m.resolved as resolved_path, m.is_primary, t.field_type
from mappings m join ftypes t using (field)"""

SQL["rule_configs"] = BASE + """
select field, value, ordinal, ml_id, cast(req_pos as integer) as req_pos, name, path, required from configs"""

SQL["rule_signatures"] = BASE + """,
parts as (
  select r.ordinal, 0 as pos, r.value as x from recs r where r.value <> ''
  union all
  select c.ordinal, c.req_pos + 1, c.required from configs c)
select r.field, r.ordinal, r.ml_id, r.value as primary_value,
       lower(coalesce((select string_agg(x, ' ' order by pos) from parts p
                       where p.ordinal = r.ordinal
                         and lower(x) not in ('', 'none', 'null', 'nan', '-', 'na', 'n/a', 'undefined')), '')) as signature
from recs r where r.value <> ''"""

SQL["valid_values"] = BASE + """
select field, value, ml_id from valid_set"""

SQL["field_values"] = BASE + """
select x.exec_id, m.field, m.path,
       coalesce(""" + norm("r.v", "(t.field_type = 'INTEGER')") + """, '') as value
from ex x cross join mappings m join ftypes t on t.field = m.field
left join ex_raw r on r.exec_id = x.exec_id and r.path = m.path"""

SQL["primary_status"] = FULL + """
select exec_id, field, value, status, applicable, empty, best_ml_id, best_ordinal, cast(best_errors as integer) as best_errors
from pstatus"""

SQL["best_config"] = FULL + """
select exec_id, field, best_ml_id, best_ordinal, cast(best_errors as integer) as best_errors
from pstatus where best_ml_id is not null"""

SQL["invalid_values_anti"] = FULL + """
select exec_id, field, value from pstatus p
where applicable and not empty
  and not exists (select 1 from valid_set v where v.field = p.field and v.value = p.value)"""

SQL["invalid_payload_flat"] = FULL + """
select exec_id, field, value, validation_status, mapping, cast(meta_pos as integer) as meta_pos,
       meta_name, meta_value, meta_status, meta_mapping
from payload"""

SQL["document_verdict"] = FULL + """
select exec_id, is_valid, n_invalid_fields, invalid_names from verdict"""

SQL["invalid_names"] = FULL + """
select exec_id, name from inv_names"""

SQL["validation_counts"] = FULL + """,
tot as (select count(distinct exec_id) as total from ex)
select m.field, tot.total - coalesce(c.n, 0) as valid, coalesce(c.n, 0) as invalid, tot.total
from mappings m cross join tot
left join (select name, count(distinct exec_id) as n from inv_names group by name) c on c.name = m.field"""

SQL["validity_totals"] = FULL + """
select count(*) filter (where is_valid) as valid, count(*) filter (where not is_valid) as invalid,
       count(*) as processed from verdict"""

from oracles.suggest import RECORD, ratio, tfidf_knn  # noqa: E402

SUG = with_ctes(FIXTURE, RULES, VALIDATE, RECORD)

SQL["suggest_record_knn"] = SUG + """
select exec_id, field, cast(rank as integer) as rank, ml_id, primary_value, overall_score from rec_sug"""

SQL["snapshot_suggestions"] = SUG + """,
items as (
  select r.exec_id, r.field, 'primary' as item, r.field as name, r.rank, r.primary_value as suggestion,
         lower(s.value) as a, lower(r.primary_value) as b, r.overall_score, r.ml_id
  from rec_sug r join pstatus s on s.exec_id = r.exec_id and s.field = r.field
  union all
  select r.exec_id, r.field, 'metadata', p.meta_name, r.rank, coalesce(c.required, ''),
         lower(coalesce(p.meta_value, '')), lower(coalesce(c.required, '')), r.overall_score, r.ml_id
  from rec_sug r join payload p on p.exec_id = r.exec_id and p.field = r.field and p.meta_name is not null
  left join configs c on c.ordinal = r.ordinal and c.name = p.meta_name)
select exec_id, field, item, name, cast(rank as integer) as rank, suggestion,
       """ + ratio("a", "b") + """ as score, overall_score, 'PENDING' as status, ml_id
from items"""

SQL["suggest_field_knn"] = with_ctes(FIXTURE, RULES, VALIDATE) + """,
fq as (select distinct field as grp, value as q from pstatus where status = 'invalid' and not empty),
fd as (select field as grp, hash(field, value) as doc_id, value as txt, value as ord, ml_id from valid_set),
""" + tfidf_knn("fk", "fq", "fd") + """
select t.grp as field, t.q as value, cast(t.rank as integer) as rank, d.txt as suggestion, d.ml_id, t.score
from fk_top t join fd d on d.grp = t.grp and d.doc_id = t.doc_id"""

SNAP = """,
seed as (
  select cast(2 * o_orderkey as varchar) as execution_id, 'S' || cast(o_orderkey as varchar) as snapshot_id,
    case o_orderkey % 5 when 0 then 'PENDING' when 1 then 'pending' when 2 then 'REJECTED' when 3 then 'ON HOLD'
         else 'ACCEPTED' end as status,
    case when o_orderkey % 17 = 0 then 'not-a-date' when o_orderkey % 19 = 0 then null
         else strftime(timestamp '2001-08-10 00:00:00' - (o_orderkey % 10) * interval '1' day
                       - (o_orderkey % 24) * interval '1' hour, '%Y-%m-%dT%H:%M:%S.%fZ') end as updated_on
  from orders),
cnt as (
  select exec_id, count(*) as n from (
    select r.exec_id from rec_sug r
    union all
    select r.exec_id from rec_sug r join payload p on p.exec_id = r.exec_id and p.field = r.field
    where p.meta_name is not null) group by exec_id),
vd as (select cast(exec_id as varchar) as execution_id, * from verdict),
snaps as (
  select coalesce(s.snapshot_id, sha256('snap:' || v.execution_id)) as snapshot_id, v.execution_id,
         case when coalesce(s.status, '') <> '' then upper(s.status) else 'PENDING' end as status,
         v.invalid_names as invalid_fields, v.n_invalid_fields as n_invalid_values,
         coalesce(c.n, 0) as n_comparing,
         case when s.snapshot_id is not null then s.updated_on else '2001-08-10T00:00:00.000000Z' end as history_updated_on,
         null::varchar as last_modified_on
  from vd v left join seed s using (execution_id) left join cnt c on c.exec_id = v.exec_id
  where not v.is_valid
  union all
  select s.snapshot_id, s.execution_id,
         case when upper(s.status) in ('ACCEPTED', 'REJECTED', 'ON HOLD') then s.status else 'ACCEPTED' end,
         '', 0, 0, s.updated_on,
         case when upper(s.status) in ('ACCEPTED', 'REJECTED', 'ON HOLD') then null else '2001-08-10T00:00:00.000000Z' end
  from vd v join seed s using (execution_id) where v.is_valid)
"""

SQL["snapshot_upsert"] = SUG + SNAP + """
select execution_id, snapshot_id, status, invalid_fields, n_invalid_values, n_comparing,
       history_updated_on, last_modified_on from snaps
union all
select s.execution_id, s.snapshot_id, s.status, '', 0, 0, s.updated_on, null
from seed s anti join snaps n on n.snapshot_id = s.snapshot_id"""

SQL["auto_accept"] = SUG + SNAP + """
select v.execution_id, s.status as old_status, n.snapshot_id, n.status as new_status, n.last_modified_on
from vd v join seed s using (execution_id) join snaps n using (execution_id) where v.is_valid"""

SEED = """,
seed0 as (
  select cast(2 * o_orderkey as varchar) as execution_id, 'S' || cast(o_orderkey as varchar) as snapshot_id,
    case o_orderkey % 5 when 0 then 'PENDING' when 1 then 'pending' when 2 then 'REJECTED' when 3 then 'ON HOLD'
         else 'ACCEPTED' end as status,
    case when o_orderkey % 17 = 0 then 'not-a-date' when o_orderkey % 19 = 0 then null
         else strftime(timestamp '2001-08-10 00:00:00' - (o_orderkey % 10) * interval '1' day
                       - (o_orderkey % 24) * interval '1' hour, '%Y-%m-%dT%H:%M:%S.%fZ') end as updated_on
  from orders),
buckets as (select * from (values ('green'), ('yellow'), ('red')) b(bucket))
"""


def _bucket(ts: str) -> str:
    d = f"((epoch_us(timestamp '2001-08-10 00:00:00') - epoch_us({ts})) / 86400e6)"
    return f"(case when {d} < 3 then 'green' when {d} <= 6 then 'yellow' else 'red' end)"


SQL["ageing_pending"] = with_ctes(FIXTURE) + SEED + """,
aged as (
  select case when try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ') is null then 'yellow'
              else """ + _bucket("try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ')") + """ end as bucket
  from seed0 where upper(status) = 'PENDING' and coalesce(updated_on, '') <> '')
select b.bucket, coalesce((select count(*) from aged a where a.bucket = b.bucket), 0) as n from buckets b"""

SQL["ageing_filtered"] = with_ctes(FIXTURE) + SEED + """,
aged as (
  select """ + _bucket("try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ')") + """ as bucket
  from seed0 where upper(status) in ('PENDING', 'REJECTED', 'ON HOLD', 'ACCEPTED')
    and try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ') is not null)
select b.bucket, coalesce((select count(*) from aged a where a.bucket = b.bucket), 0) as n from buckets b"""

_REC_PAGE = """,
inv as (select v.exec_id, v.invalid_names, x.btype_raw, x.bcat_raw from verdict v join ex x using (exec_id)
        where not v.is_valid {cond})
select cast(exec_id as varchar) as execution_id, 'PENDING' as status, btype_raw as benchmark_type,
       bcat_raw as benchmark_category, invalid_names as invalid_fields, (select count(*) from inv) as total
from inv order by exec_id desc limit {size} offset {skip}"""

SQL["invalid_records_page"] = FULL + _REC_PAGE.format(cond="", size=50, skip=0)
SQL["invalid_records_late_page"] = FULL + _REC_PAGE.format(cond="", size=50, skip=2000)
SQL["invalid_records_search"] = FULL + _REC_PAGE.format(
    cond="and (regexp_matches(cast(v.exec_id as varchar), 'urgent', 'i') or regexp_matches(x.btype_raw, 'urgent', 'i') "
         "or regexp_matches(x.bcat_raw, 'urgent', 'i'))", size=20, skip=20)

SQL["invalid_summary"] = SUG + SNAP + """,
allsnaps as (
  select n.snapshot_id, n.execution_id, n.status, n.invalid_fields, n.history_updated_on as updated_on
  from snaps n
  union all
  select s.snapshot_id, s.execution_id, s.status, '', s.updated_on
  from seed s anti join snaps n on n.snapshot_id = s.snapshot_id),
pg as (
  select * from allsnaps where upper(status) in ('PENDING', 'REJECTED', 'ON HOLD', 'ACCEPTED')
  order by snapshot_id desc limit 50)
select p.execution_id, p.status, coalesce(x.btype_raw, 'N/A') as benchmark_type,
       coalesce(x.bcat_raw, 'N/A') as benchmark_category, p.invalid_fields, p.updated_on,
       (select count(*) from allsnaps where upper(status) in ('PENDING', 'REJECTED', 'ON HOLD', 'ACCEPTED')) as total
from pg p left join ex x on cast(x.exec_id as varchar) = p.execution_id"""

SQL["unique_values"] = BASE + """,
params as (
  select field as param from mappings
  union select 'BenchmarkCategory' where exists (select 1 from mappings where field = 'Benchmark')),
ptypes as (select distinct type from pub)
select distinct p.param, trim(u.value) as value from params p
join pub u on u.type = case when p.param = 'BenchmarkCategory' then 'Benchmark' else p.param end
where u.value is not null
union
select distinct p.param, trim(m.mv) from params p join pub_meta m on m.mk = p.param
where p.param not in (select type from ptypes) and p.param <> 'BenchmarkCategory' and m.mv is not null"""

SQL["parameter_values"] = with_ctes(FIXTURE) + """,
pub as (select * from ml where status = 'Published'),
named as (
  select 'cpumodel' as param, value as v from pub where type = 'CPUModel'
  union all select 'instancetype', value from pub where type = 'instanceType'
  union all select 'benchmarkcategory', value from pub where type = 'Benchmark'
  union all select lower(m.mk), m.mv from pub p join ml_meta m using (ordinal)
  where m.mk in ('Family', 'coreCount', 'cloudProvider') or (m.mk = 'BenchmarkType' and p.type = 'Benchmark'))
select distinct param, trim(v) as value from named where v <> ''"""

SQL["metadata_values"] = BASE + """
select p.type, p.value, p.ml_id, m.mk as name, trim(m.mv) as meta_value,
       coalesce(nullif((select arg_min(x.mv, x.pos) from pub_meta x where x.ordinal = p.ordinal
                        and lower(x.mk) = lower('mapping_' || m.mk)), ''), '') as meta_path
from pub p join pub_meta m using (ordinal)
where not starts_with(m.mk, 'mapping_') and m.mk <> 'mapping'"""

SQL["stream_validate"] = SQL["document_verdict"]

SQL["stream_changes"] = FULL + """,
changes as (
  select exec_id, 1 as change_no, is_valid, n_invalid_fields from verdict where exec_id % 11 <> 5
  union all
  select exec_id - 1, 2, is_valid, n_invalid_fields from verdict where exec_id % 7 = 1)
select exec_id, max(change_no) as change_no, arg_max(is_valid, change_no) as is_valid,
       arg_max(n_invalid_fields, change_no) as n_invalid_fields, true as validated,
       '2001-08-10T00:00:00.000000Z' as validated_at
from changes group by exec_id"""

SQL["draft_ids"] = with_ctes(FIXTURE) + """
select ml_id as id from ml where status = 'Draft'"""

SQL["draft_new"] = with_ctes(FIXTURE) + """,
dreq as (
  select e.event_id as ordinal,
         case when e.event_id % 3 = 0 then p.p_name || ' v2' else p.p_name || ' gen' || cast(e.event_id % 3 as varchar) end as value,
         p.p_type as family
  from events e join part p on p.p_partkey = (e.event_id % (select count(*) from orders)) % (select count(*) from part)
  where e.event_type = 'signup'),
fresh as (
  select * from dreq d where not exists (
    select 1 from ml m join ml_meta mm on mm.ordinal = m.ordinal
    where m.type = 'CPUModel' and m.value = d.value and mm.mk = 'Family' and mm.mv = d.family))
select min(ordinal) as ordinal, 'CPUModel' as type, 'Draft' as status, value, family
from fresh group by value, family"""

SQL["snapshot_search"] = SUG + SNAP + """,
allsnaps as (
  select n.snapshot_id, n.execution_id, n.status, n.history_updated_on from snaps n
  union all
  select s.snapshot_id, s.execution_id, s.status, s.updated_on from seed s anti join snaps n on n.snapshot_id = s.snapshot_id),
hits as (select cast(exec_id as varchar) as execution_id, btype_raw, bcat_raw, created_on from ex
         where regexp_matches(cast(exec_id as varchar), 'urgent', 'i') or regexp_matches(btype_raw, 'urgent', 'i')
            or regexp_matches(bcat_raw, 'urgent', 'i')),
found as (select * from allsnaps where execution_id in (select execution_id from hits)),
pg as (select * from found order by snapshot_id desc limit 50)
select p.execution_id, p.snapshot_id, p.status, h.btype_raw as benchmark_type, h.bcat_raw as benchmark_category,
       null::varchar as run_category, strftime(h.created_on, '%Y-%m-%d %H:%M:%S') as created_on, null::varchar as tester,
       p.history_updated_on, (select count(*) from found) as total
from pg p left join hits h using (execution_id)"""

SQL["metadata_schema"] = with_ctes(FIXTURE) + """
select distinct mk as name from ml_meta
where ordinal = (select min(ordinal) from ml where status = 'Published' and lower(type) = 'cpumodel')
  and not starts_with(mk, 'mapping')"""

SQL["valid_values_and_paths"] = BASE + """
select field, 'value' as kind, null::varchar as name, value from valid_set
union all
select field, 'meta_path', name, path from meta_paths"""

SQL["apply_rejections"] = SUG + SNAP + """,
universe as (
  select execution_id, snapshot_id from snaps
  union all
  select s.execution_id, s.snapshot_id from seed s anti join snaps n on n.snapshot_id = s.snapshot_id),
rej as (
  select distinct cast(event_id % (select count(*) from orders) as varchar) as execution_id
  from events where event_type = 'error'),
hist as (
  select cast(s.exec_id as varchar) as execution_id, s.f_ord, -1 as sub, s.field as f, s.value as v
  from pstatus s where s.overall_invalid
  union all
  select cast(p.exec_id as varchar), s.f_ord, p.meta_pos, p.meta_name, p.meta_value
  from payload p join pstatus s on s.exec_id = p.exec_id and s.field = p.field
  where p.meta_name is not null)
select u.execution_id, 'REJECTED' as status, 'L0 Junk Data.' as reason,
       coalesce((select string_agg(f, ',' order by f_ord, sub) from hist h where h.execution_id = u.execution_id
                 and exists (select 1 from vd where vd.execution_id = u.execution_id and not vd.is_valid)), '') as history_fields,
       coalesce((select string_agg(coalesce(v, ''), '|' order by f_ord, sub) from hist h where h.execution_id = u.execution_id
                 and exists (select 1 from vd where vd.execution_id = u.execution_id and not vd.is_valid)), '') as history_from,
       coalesce((select n_invalid_fields from vd where vd.execution_id = u.execution_id and not vd.is_valid), 0) as n_items
from universe u join rej using (execution_id)"""

SQL["draft_hold"] = SUG + SNAP + """,
dreq as (
  select e.event_id as ordinal,
         case when e.event_id % 3 = 0 then p.p_name || ' v2' else p.p_name || ' gen' || cast(e.event_id % 3 as varchar) end as value,
         p.p_type as family
  from events e join part p on p.p_partkey = (e.event_id % (select count(*) from orders)) % (select count(*) from part)
  where e.event_type = 'signup'),
fresh as (
  select distinct value from dreq d where not exists (
    select 1 from ml m join ml_meta mm on mm.ordinal = m.ordinal
    where m.type = 'CPUModel' and m.value = d.value and mm.mk = 'Family' and mm.mv = d.family)),
items as (select cast(exec_id as varchar) as execution_id, field, value from pstatus where overall_invalid)
select n.execution_id, n.snapshot_id, 'ON HOLD' as status
from snaps n
where n.execution_id in (select i.execution_id from items i join fresh f on f.value = i.value)
  and n.execution_id in (select execution_id from items where lower(field) = 'cpumodel')"""

# --- fuzzy joins: every pair of distinct texts of a field is scored -------------------------------------------
_TOKENSET = SUG + """,
ts_p as (
  select q.field, q.q, c.signature from (select distinct field, q from qsig where q <> '') q
  join (select distinct field, signature from sigs) c using (field)),
""" + token_set("ts", "ts_p", "q", "signature") + """,
ts_r as (
  select t.field, t.q, g.ml_id, g.primary_value, t.token_set,
         row_number() over (partition by t.field, t.q order by t.token_set desc, g.ordinal) as rank
  from ts t join sigs g using (field, signature) where t.token_set >= 75)
"""

SQL["suggest_record_tokenset"] = _TOKENSET + """
select e.exec_id, e.field, cast(r.rank as integer) as rank, r.ml_id, r.primary_value, round_even(r.token_set / 100, 4) as overall_score
from qsig e join ts_r r on r.field = e.field and r.q = e.q where r.rank <= 3"""

SQL["fuzzy_exists"] = _TOKENSET + """
select e.exec_id, e.field, exists (select 1 from ts_r r where r.field = e.field and r.q = e.q) as has_match from qsig e"""

_PROCESSED = "trim(regexp_replace(lower({0}), '[^\\w]', ' ', 'g'), ' ')"

SQL["suggest_field_partial"] = with_ctes(FIXTURE, RULES, VALIDATE) + """,
fq as (select distinct field, value from pstatus where status = 'invalid' and not empty),
fp as (
  select q.field, q.value, c.value as cand, c.ml_id, """ + _PROCESSED.format("q.value") + """ as a, """ + _PROCESSED.format("c.value") + """ as b
  from fq q join valid_set c using (field)),
""" + partial("fs", "fp", "a", "b") + """,
fr as (
  select fp.*, fs.partial, row_number() over (partition by field, value order by fs.partial desc, cand) as rank
  from fp join fs using (a, b) where fs.partial >= 10)
select field, value, cast(rank as integer) as rank, cand as suggestion, ml_id, round_even(partial / 100, 4) as score from fr where rank <= 3"""

_SORTED = "coalesce(array_to_string(list_sort({0}), ' '), '')"

def wratio_best(p: str, terms: str, choices: str) -> str:
    """CTEs ending in ``{p}best`` (a, stored, raw): the best choice (b, stored) of at least 60 for each text a of ``terms``."""
    return f"""
{p}p as (select a, b, stored, {_SORTED.format(words("a"))} as wa, {_SORTED.format(words("b"))} as wb
       from (select distinct a from {terms}), {choices}),
{partial(p + "w", p + "p", "a", "b")}, {partial(p + "x", p + "p", "wa", "wb")}, {token_set(p + "t", p + "p", "a", "b")},
{p}u as (
  select t.*, w.partial as whole, x.partial as part, greatest(len(t.a), len(t.b)) / least(len(t.a), len(t.b)) as times,
         len(list_filter(ta, lambda e: list_contains(tb, e))) > 0 as meet,
         {ratio100("t.a", "t.b")} as plain, {ratio100("t.wa", "t.wb")} as sorted
  from {p}t t join {p}w w on w.a = t.a and w.b = t.b join {p}x x on x.a = t.wa and x.b = t.wb),
{p}v as (
  select *, case when times < 1.5 then greatest(plain, greatest(sorted, token_set) * 0.95::double)
                 else greatest(plain, whole * s, (case when wa = '' or wb = '' then 0.0 when meet then 100.0 else part end) * 0.95::double * s) end as raw
  from (select *, case when times <= 8 then 0.9::double else 0.6::double end as s from {p}u)),
{p}best as (select a, stored, raw from (
  select a, stored, raw, row_number() over (partition by a order by raw desc, b) as rank from {p}v where raw >= 60) where rank = 1)"""


SQL["resolve_terms"] = BASE + """,
fv as (
  select distinct coalesce(""" + norm("r.v", "(t.field_type = 'INTEGER')") + """, '') as term
  from ex_raw r join mappings m on m.path = r.path join ftypes t on t.field = m.field where m.field = 'instanceType'),
terms as (select term, lower(term) as a from fv where term <> ''),
choices as (select lower(value) as b, max(value) as stored from recs where field = 'instanceType' and value <> '' group by 1),
""" + wratio_best("r", "terms", "choices") + """
select t.term, coalesce(b.stored, t.term) as resolved, b.stored is not null as is_fuzzy, round_even(b.raw / 100, 4) as score
from terms t left join rbest b using (a)"""


# --- a snapshot as a reviewer opens it ---------------------------------------------------------------------------
# the items of the snapshots with their metadata, a row each
_FOUND = """found as (
  select cast(s.exec_id as varchar) as execution_id, s.f_ord, dense_rank() over (partition by s.exec_id order by s.f_ord) - 1 as field_pos,
         s.field as invalid_field, e.data_pos, e.name, e.value, e.validation_status, e.mapping
  from pstatus s join (
    select exec_id, field, 0 as data_pos, field as name, value, status as validation_status, path as mapping from pstatus where overall_invalid
    union all
    select exec_id, field, meta_pos + 1, meta_name, meta_value, meta_status, meta_mapping from payload where meta_name is not null) e
    on e.exec_id = s.exec_id and e.field = s.field
  where s.overall_invalid),
"""

_REJECTED = SUG + SNAP + """,
rej as (
  select distinct cast(event_id % (select count(*) from orders) as varchar) as execution_id
  from events where event_type = 'error'),
alls as (
  select n.snapshot_id, n.execution_id, n.status, n.history_updated_on as updated_on,
         case when n.snapshot_id in (select snapshot_id from seed) then 'seed' else 'hygiene-batch' end as updated_by
  from snaps n
  union all
  select s.snapshot_id, s.execution_id, s.status, s.updated_on, 'seed' from seed s anti join snaps n on n.snapshot_id = s.snapshot_id),
universe as (
  select a.snapshot_id, a.execution_id, r.execution_id is not null as rejected,
         case when r.execution_id is not null then 'REJECTED' else a.status end as status,
         case when r.execution_id is not null then 'L0 Junk Data.' end as reason,
         case when r.execution_id is not null then '2001-08-10T00:00:00.000000Z' else a.updated_on end as updated_on,
         case when r.execution_id is not null then 'reviewer' else a.updated_by end as updated_by
  from alls a left join rej r using (execution_id)),
""" + _FOUND + """history as (
  select f.execution_id, f.name as field, f.value, row_number() over (partition by f.execution_id order by f.field_pos, f.data_pos) as place
  from found f join rej using (execution_id))
"""

SQL["snapshot_headers"] = _REJECTED + """
select u.snapshot_id, u.execution_id, x.btype_raw as benchmark_type, x.bcat_raw as benchmark_category, x.sut_raw as sut_type,
       null::varchar as run_category, strftime(x.created_on, '%Y-%m-%d %H:%M:%S') as created_on, null::varchar as tester,
       null::varchar as result_type, u.status, u.reason, u.updated_on, u.updated_by,
       coalesce((select count(distinct field) from history h where h.execution_id = u.execution_id), 0) as n_changed_fields
from universe u left join ex x on cast(x.exec_id as varchar) = u.execution_id"""

SQL["snapshot_existing_data"] = _REJECTED + """
select f.execution_id, cast(f.field_pos as integer) as field_pos, f.invalid_field,
       case when u.rejected then 'Rejected' else 'invalid' end as current_status, cast(f.data_pos as integer) as data_pos,
       f.name, f.value, f.validation_status
from found f join universe u using (execution_id)"""

SQL["snapshot_changes"] = _REJECTED + """
select execution_id, cast(row_number() over (partition by execution_id order by min(place)) - 1 as integer) as field_pos, field,
       string_agg(coalesce(value, ''), '|' order by place) as from_values, string_agg(coalesce(value, ''), '|' order by place) as to_values
from history group by execution_id, field"""

SQL["accept_on_read"] = SUG + SNAP + """
select v.execution_id, true as is_valid, 0::bigint as n_invalid_fields, true as field_status_unset,
       case when upper(s.status) in ('ACCEPTED', 'REJECTED', 'ON HOLD') then null else s.snapshot_id end as snapshot_id,
       case when upper(s.status) in ('ACCEPTED', 'REJECTED', 'ON HOLD') then null else 'ACCEPTED' end as new_status
from vd v join seed s using (execution_id) where v.is_valid"""

SQL["draft_hold_by_execution"] = SUG + SNAP + """,
dreq as (
  select e.event_id, cast(e.event_id % (select count(*) from orders) as varchar) as execution_id,
         case when e.event_id % 3 = 0 then p.p_name || ' v2' else p.p_name || ' gen' || cast(e.event_id % 3 as varchar) end as value,
         p.p_type as family
  from events e join part p on p.p_partkey = (e.event_id % (select count(*) from orders)) % (select count(*) from part)
  where e.event_type = 'signup'),
fresh as (
  select arg_min(execution_id, event_id) as execution_id from dreq d where not exists (
    select 1 from ml m join ml_meta mm on mm.ordinal = m.ordinal
    where m.type = 'CPUModel' and m.value = d.value and mm.mk = 'Family' and mm.mv = d.family)
  group by value, family)
select n.execution_id, n.snapshot_id, 'ON HOLD' as status, 'New Masterlist Draft Record.' as reason, count(*) as n_held
from snaps n join pstatus p on cast(p.exec_id as varchar) = n.execution_id and p.overall_invalid and p.field = 'CPUModel'
where n.execution_id in (select execution_id from fresh) group by all"""

# --- searches by a resolved term: a column whose values resemble the term is compared with the resolved value ------
_RESOLVED = """,
asked as (select 'urgnt' as a),
kinds as (select lower(m.mv) as b, max(m.mv) as stored from pub p join ml_meta m using (ordinal)
          where p.type = 'Benchmark' and m.mk = 'BenchmarkType' and m.mv <> '' group by 1),
cats as (select lower(value) as b, max(value) as stored from pub where type = 'Benchmark' and value <> '' group by 1),
""" + wratio_best("k", "asked", "kinds") + "," + wratio_best("c", "asked", "cats")


def _meant(id_col: str, type_col: str, category_col: str) -> str:
    like = "regexp_matches({0}, 'urgnt', 'i')".format
    return (f"(coalesce({like(id_col)}, false) or coalesce({type_col} = (select stored from kbest), {like(type_col)}, false) "
            f"or coalesce({category_col} = (select stored from cbest), {like(category_col)}, false))")


SQL["invalid_records_details"] = FULL + _RESOLVED + """,
inv as (select v.exec_id, x.bcat_raw from verdict v join ex x using (exec_id)
        where not v.is_valid and """ + _meant("cast(v.exec_id as varchar)", "x.btype_raw", "x.bcat_raw") + """),
pg as (select * from inv order by exec_id desc limit 50 offset 50)
select cast(p.exec_id as varchar) as execution_id, p.bcat_raw as benchmark_category, (select count(*) from inv) as total,
       cast(row_number() over (partition by p.exec_id order by s.f_ord) - 1 as integer) as field_pos, s.field, s.value,
       s.status as validation_status, s.path as mapping,
       (select count(*) from payload y where y.exec_id = s.exec_id and y.field = s.field and y.meta_name is not null) as n_metadata
from pg p join pstatus s on s.exec_id = p.exec_id and s.overall_invalid"""

SQL["invalid_summary_found"] = SUG + SNAP + _RESOLVED + """,
found as (
  select n.*, x.btype_raw, x.bcat_raw from (
    select n.snapshot_id, n.execution_id, n.status, n.invalid_fields, n.history_updated_on as updated_on,
           case when not v.is_valid then x.btype_raw end as own_type, case when not v.is_valid then x.bcat_raw end as own_category
    from snaps n join vd v using (execution_id) join ex x on x.exec_id = v.exec_id
    union all
    select s.snapshot_id, s.execution_id, s.status, '', s.updated_on, null, null
    from seed s anti join snaps n on n.snapshot_id = s.snapshot_id) n
  left join ex x on cast(x.exec_id as varchar) = n.execution_id
  where upper(n.status) in ('PENDING', 'ON HOLD') and """ + _meant("n.execution_id", "n.own_type", "n.own_category") + """),
aged as (
  select """ + _bucket("try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ')") + """ as bucket
  from found where try_strptime(updated_on, '%Y-%m-%dT%H:%M:%S.%fZ') is not null)
select execution_id, status, btype_raw as benchmark_type, bcat_raw as benchmark_category, invalid_fields, updated_on,
       (select count(*) from found) as total, (select count(*) from aged where bucket = 'green') as green,
       (select count(*) from aged where bucket = 'yellow') as yellow, (select count(*) from aged where bucket = 'red') as red
from found order by snapshot_id desc limit 50"""

# --- free-form documents ---------------------------------------------------------------------------------------
SQL["masterlist_documents"] = with_ctes(FIXTURE) + """
select ordinal, ml_id, type, status, value, (select count(*) from ml_meta m where m.ordinal = ml.ordinal) as n_metadata from ml"""

SQL["execution_documents"] = FULL + """
select case when exec_id % 5 = 0 then 'x' else '' end || cast(exec_id as varchar) as exec_id, is_valid, n_invalid_fields, invalid_names
from verdict"""


# --- review decisions ------------------------------------------------------------------------------------------
# The events number fewer than the orders, so each execution has one decision at most, and names of metadata belong to one
# field each: an approval settles the item that it was made from.  Accepted values are suggestions, 'manual' or custom
# ones that no published record has, so no metadata come from a record.
_REVIEW = SUG + SNAP + """,
""" + _FOUND + """
stored as (
  select cast(r.exec_id as varchar) as execution_id, r.field as invalid_field, 0 as data_pos, r.rank, r.primary_value as suggestion
  from rec_sug r
  union all
  select cast(r.exec_id as varchar), r.field, y.meta_pos + 1, r.rank, coalesce(c.required, '')
  from rec_sug r join payload y on y.exec_id = r.exec_id and y.field = r.field and y.meta_name is not null
  left join configs c on c.ordinal = r.ordinal and c.name = y.meta_name),
picked as (
  select f.execution_id, f.field_pos, f.invalid_field, e.event_type, case when e.event_type = 'click' then 1 else 0 end as spot
  from (select *, cast(event_id % (select count(*) from orders) as varchar) as execution_id from events) e
  join (select execution_id, count(distinct field_pos) as n from found group by 1) c using (execution_id)
  join found f on f.execution_id = e.execution_id and f.data_pos = 0 and f.field_pos = e.event_id % c.n
  where e.event_type in ('purchase', 'view', 'click')),
accepted as (
  select k.*, f.name, f.value, f.mapping,
         case k.event_type when 'view' then 'custom-' || k.execution_id when 'click' then coalesce(t.suggestion, 'manual')
              else t.suggestion end as answer
  from picked k join found f on f.execution_id = k.execution_id and f.field_pos = k.field_pos and f.data_pos = k.spot
  left join stored t on t.execution_id = k.execution_id and t.invalid_field = k.invalid_field and t.data_pos = k.spot and t.rank = 1),
approval as (
  select a.*, (select max(t.rank) from stored t where t.execution_id = a.execution_id and t.invalid_field = a.invalid_field
               and t.data_pos = a.spot and t.suggestion = a.answer) as chosen
  from accepted a),
written as (
  select execution_id, 0 as pos, name as field, value as old, answer as new, chosen, mapping as path, answer as value from approval
  union all
  select a.execution_id, f.data_pos, f.name, f.value, coalesce(nullif(t.suggestion, ''), f.value), a.chosen, f.mapping, nullif(t.suggestion, '')
  from approval a join found f on f.execution_id = a.execution_id and f.field_pos = a.field_pos and f.data_pos > 0
  left join stored t on t.execution_id = a.execution_id and t.invalid_field = a.invalid_field and t.data_pos = f.data_pos and t.rank = a.chosen
  where a.spot = 0),
outcome as (
  select a.execution_id, case when bool_and(f.validation_status = 'valid' or (f.field_pos = a.field_pos and (a.spot = 0 or f.data_pos = 1)))
                              then 'ACCEPTED' else 'PENDING' end as status
  from approval a join found f using (execution_id) group by a.execution_id),
updates as (
  select * from (
    select execution_id, pos, path, value from written where value is not null
    union all
    select w.execution_id, 100 + w.pos, w.path, w.new from written w join outcome o using (execution_id)
    where o.status = 'ACCEPTED' and w.new is not null
    union all
    select execution_id, 200, 'isValid', 'true' from outcome where status = 'ACCEPTED')
  where coalesce(path, '') <> '' and not starts_with(path, 'processor_details.')),
refused as (
  select cast(event_id % (select count(*) from orders) as varchar) as execution_id from events where event_type = 'error'),
drafts as (
  select e.event_id, cast(e.event_id % (select count(*) from orders) as varchar) as execution_id,
         case when e.event_id % 3 = 0 then p.p_name || ' v2' else p.p_name || ' gen' || cast(e.event_id % 3 as varchar) end as value,
         p.p_type as family
  from events e join part p on p.p_partkey = (e.event_id % (select count(*) from orders)) % (select count(*) from part)
  where e.event_type = 'signup'),
held as (
  select execution_id from (
    select arg_min(execution_id, event_id) as execution_id from drafts d where not exists (
      select 1 from ml m join ml_meta mm on mm.ordinal = m.ordinal
      where m.type = 'CPUModel' and m.value = d.value and mm.mk = 'Family' and mm.mv = d.family)
    group by value, family)
  where execution_id in (select execution_id from found where invalid_field = 'CPUModel')),
reviewed as (
  select u.* replace (
    case when h.execution_id is not null then 'ON HOLD' when r.execution_id is not null then 'REJECTED'
         else coalesce(o.status, u.status) end as status,
    case when coalesce(h.execution_id, r.execution_id, o.execution_id) is not null then '2001-08-10T00:00:00.000000Z'
         else u.history_updated_on end as history_updated_on)
  from (
    select execution_id, snapshot_id, status, invalid_fields, n_invalid_values, n_comparing, history_updated_on, last_modified_on from snaps
    union all
    select s.execution_id, s.snapshot_id, s.status, '', 0, 0, s.updated_on, null from seed s anti join snaps n on n.snapshot_id = s.snapshot_id) u
  left join outcome o using (execution_id) left join refused r using (execution_id) left join held h using (execution_id))
"""

SQL["apply_approvals"] = _REVIEW + """
select o.execution_id, o.status, string_agg(w.field, ',' order by w.pos) as history_fields,
       string_agg(coalesce(w.new, ''), '|' order by w.pos) as history_to,
       string_agg(case when w.chosen is null then 'dropdown' else 'suggestion' end, ',' order by w.pos) as history_source
from outcome o join written w using (execution_id) group by o.execution_id, o.status"""

SQL["execution_updates"] = _REVIEW + """
select execution_id as exec_id, path, value from updates
union all
select execution_id, 'entitliment_level', 'L0 Junk Data.' from refused"""

SQL["history_changes"] = _REVIEW + """
select execution_id, field, cast(pos as integer) as pos, coalesce(old, '') as "from", coalesce(new, '') as "to" from written"""

SQL["apply_updates"] = _REVIEW + """,
latest as (select execution_id, path, arg_max(value, pos) as value from updates group by 1, 2)
select u.execution_id as exec_id, coalesce(max(u.value) filter (where u.path = '""" + CPU + """'), any_value(x.cpu_raw)) as cpu_model,
       coalesce(max(u.value) filter (where u.path = '""" + CORES + """'), any_value(x.core_raw)) as core_count,
       coalesce(max(u.value) filter (where u.path = '""" + INST + """'), any_value(x.inst_raw)) as instance_type,
       coalesce(max(u.value) filter (where u.path = 'benchmarkCategory'), any_value(x.bcat_raw)) as benchmark_category,
       max(u.value) filter (where u.path = 'isValid') as is_valid
from latest u join ex x on cast(x.exec_id as varchar) = u.execution_id group by u.execution_id"""

SQL["reviewed_snapshots"] = _REVIEW + """
select * from reviewed"""

SQL["snapshot_detail"] = _REVIEW + """,
shown as (
  select f.execution_id, f.invalid_field, f.value, r.rank, r.ordinal, r.primary_value, r.overall_score, v.status as snapshot_status,
         case when h.execution_id is not null and f.invalid_field = 'CPUModel' then 'ON HOLD' when n.execution_id is not null then 'Rejected'
              when a.execution_id is not null then 'Approved' else 'invalid' end as current_status,
         case when h.execution_id is not null and f.invalid_field = 'CPUModel' then 'REJECTED' when n.execution_id is not null then 'Rejected'
              when a.execution_id is null then 'PENDING' when r.primary_value = a.answer then 'Accepted' else 'Rejected' end as status
  from found f join rec_sug r on cast(r.exec_id as varchar) = f.execution_id and r.field = f.invalid_field and f.data_pos = 0
  join reviewed v using (execution_id) left join held h using (execution_id) left join refused n using (execution_id)
  left join approval a on a.execution_id = f.execution_id and a.field_pos = f.field_pos and a.spot = 0),
texts as (
  select s.*, 'primary' as item, s.invalid_field as name, s.primary_value as suggestion, s.value as own from shown s
  union all
  select s.*, 'metadata', c.name, c.required, coalesce(f.value, '') from shown s join configs c on c.ordinal = s.ordinal
  left join found f on f.execution_id = s.execution_id and f.invalid_field = s.invalid_field and f.data_pos > 0 and f.name = c.name)
select execution_id, invalid_field, current_status, snapshot_status, item, name, cast(rank as integer) as rank, suggestion,
       """ + ratio("a", "b") + """ as score, overall_score, status
from (select *, lower(own) as a, lower(suggestion) as b from texts)"""
