"""Portable SQL: the fixture views and the validation core, written for DuckDB.

Mirrors ``hygeia.sources.fixtures`` and the validation semantics, but as plain
relational SQL over long tables (no shared code with the Spark plans).
"""

INT_RE = "'^[+-]?[0-9]+(_[0-9]+)*$'"

CPU = "platformProfile.sut.Summary.Server.CPUModel"
CORES = "platformProfile.sut.Summary.CPU.CPU(s)"
INST = "sutInstanceMetadata.instanceType"
CLOUD = "sutInstanceMetadata.cloudProvider"


def canon(v: str) -> str:
    digits = f"regexp_replace(regexp_replace({v}, '[+\\-_]', '', 'g'), '^0+([0-9])', '\\1')"
    return (f"(case when starts_with({v}, '-') and {digits} <> '0' then '-' || {digits} else {digits} end)")


def norm(v: str, is_int: str) -> str:
    return f"(case when {is_int} and regexp_matches({v}, {INT_RE}) then {canon(v)} else {v} end)"


def dp(v: str) -> str:
    return f"trim(regexp_replace(lower({v}), '[^a-z0-9_]', ' ', 'g'))"


FIXTURE = f"""
ml_cpu as (
  select min(p_partkey) as k, p_name, p_size % 4 as b, min(p_type) as family
  from part group by p_name, p_size % 4),
ml_inst as (select min(p_partkey) as k, p_type from part group by p_type),
ml_bench as (
  select min(o_orderkey) as k, o_orderpriority from orders group by o_orderpriority),
ml as (
  select k as ordinal, 'C' || cast(k as varchar) as ml_id, 'CPUModel' as type,
         case when b = 3 and starts_with(p_name, 'hot ') then 'Draft' else 'Published' end as status,
         p_name as value, '{CPU}' as mapping
  from ml_cpu
  union all
  select 1000000000000 + k, 'I' || cast(k as varchar), 'instanceType', 'Published', p_type, '{INST}'
  from ml_inst
  union all
  select 2000000000000 + 2 * k + i, 'B' || cast(k as varchar) || bt, 'Benchmark', 'Published', o_orderpriority,
         'benchmarkCategory'
  from ml_bench, (values (0, 'F'), (1, 'O')) v(i, bt)),
ml_meta as (
  select k as ordinal, pos, mk, mv from ml_cpu,
    (values (0, 'mapping_Family'), (1, 'Family'), (2, 'mapping_coreCount'), (3, 'coreCount')) e(pos, mk),
    lateral (select case pos when 0 then 'processor_details.family' when 1 then family
                             when 2 then '{CORES}' else cast((b + 1) * 16 as varchar) end as mv)
  union all
  select 1000000000000 + k, pos, mk, mv from ml_inst,
    (values (0, 'mapping_cloudProvider', '{CLOUD}'), (1, 'cloudProvider', 'AWS')) e(pos, mk, mv)
  union all
  select 2000000000000 + 2 * k + i, pos, mk, case when pos = 0 then bt else 'benchmarkType' end
  from ml_bench, (values (0, 'F'), (1, 'O')) v(i, bt), (values (0, 'BenchmarkType'), (1, 'mapping_BenchmarkType')) e(pos, mk)),
proc as (select p_name as cpu, min(p_type) as family from part group by p_name),
ex as (
  select o_orderkey as exec_id,
    case o_orderkey % 9 when 0 then upper(p_name) when 1 then '  ' || p_name || ' '
         when 2 then replace(p_name, ' ', '') when 3 then '' when 4 then 'nan'
         when 5 then p_name || ' v2' else p_name end as cpu_raw,
    case o_orderkey % 11 when 0 then cast((p_size % 4 + 1) * 16 + 1 as varchar)
         when 1 then '0' || cast((p_size % 4 + 1) * 16 as varchar) when 2 then ''
         else cast((p_size % 4 + 1) * 16 as varchar) end as core_raw,
    case when o_orderkey % 3 = 0 then 'Cloud' else 'server' end as sut_raw,
    case o_orderkey % 13 when 0 then lower(p_type) when 1 then '' else p_type end as inst_raw,
    case o_orderkey % 4 when 0 then 'GCP' when 1 then 'aws' else 'AWS' end as cloud_raw,
    o_orderpriority as bcat_raw, o_orderstatus as btype_raw, o_orderdate as created_on
  from orders join part on p_partkey = o_orderkey % (select count(*) from part))
"""

# Rules: mappings, field types, records, requirements (long), valid values.
RULES = f"""
pub as (select * from ml where status = 'Published'),
pub_meta as (select m.* from ml_meta m join pub using (ordinal)),
prim_map as (
  select type as field, arg_min(mapping, ordinal) as path, min(ordinal) as f_ord from pub group by type),
meta_named as (
  select case lower(replace(mk, 'mapping_', '')) when 'benchmarktype' then 'BenchmarkType'
              when 'cloudprovider' then 'cloudProvider' else replace(mk, 'mapping_', '') end as field,
         case when starts_with(mk, 'mapping_') then mv else '' end as path, ordinal, pos
  from pub_meta),
meta_map as (
  select field, arg_min(path, ordinal * 100 + pos) as path, min(ordinal * 100 + pos) as f_ord
  from meta_named where field not in (select field from prim_map) group by field),
fills as (
  select lower(replace(mk, 'mapping_', '')) as lname, arg_min(mv, ordinal * 100 + pos) as fill
  from pub_meta where starts_with(mk, 'mapping_') and mv <> '' group by 1),
mappings as (
  select field, path, path as resolved, true as is_primary, f_ord, 0 as grp from prim_map
  union all
  select m.field, m.path, case when m.path <> '' then m.path else coalesce(f.fill, '') end, false, m.f_ord, 1
  from meta_map m left join fills f on f.lname = lower(m.field)),
ex_raw as (
  select exec_id, '{CPU}' as path, trim(cpu_raw) as v from ex
  union all select exec_id, '{CORES}', trim(core_raw) from ex
  union all select exec_id, '{INST}', trim(inst_raw) from ex
  union all select exec_id, '{CLOUD}', trim(cloud_raw) from ex
  union all select exec_id, 'sutInstanceMetadata.sutType', trim(sut_raw) from ex
  union all select exec_id, 'benchmarkCategory', trim(bcat_raw) from ex
  union all select exec_id, 'benchmarkType', trim(btype_raw) from ex),
type_scan as (
  select m.field,
         count(*) filter (where r.v <> '' and lower(r.v) not in ('none', 'nan', 'null')) as n,
         count(*) filter (where r.v <> '' and lower(r.v) not in ('none', 'nan', 'null')
                          and not regexp_matches(r.v, {INT_RE})) as bad
  from mappings m join ex_raw r on r.path = m.resolved group by m.field),
ftypes as (
  select m.field, case when coalesce(t.n, 0) > 0 and t.bad = 0 then 'INTEGER' else 'STRING' end as field_type
  from mappings m left join type_scan t using (field)),
recs as (
  select p.ordinal, p.ml_id, p.type as field,
         {norm('trim(p.value)', "(select field_type = 'INTEGER' from ftypes where field = p.type)")} as value
  from pub p where p.type in (select field from mappings)),
req_keys as (
  select ordinal, mk as name, trim(mv) as mv from pub_meta
  where not starts_with(mk, 'mapping_') and mk <> 'mapping' and trim(mv) <> ''),
reqs as (
  select k.ordinal, k.name,
         coalesce((select arg_min(mv, pos) from pub_meta x where x.ordinal = k.ordinal
                   and lower(x.mk) = lower('mapping_' || k.name)), '') as path,
         {norm('k.mv', "coalesce((select field_type = 'INTEGER' from ftypes where field = k.name), false)")} as required
  from req_keys k),
configs as (
  select r.field, r.value, r.ordinal, r.ml_id, q.name, q.path, q.required,
         row_number() over (partition by r.ordinal order by q.name) - 1 as req_pos
  from recs r join reqs q using (ordinal) where r.value <> ''),
valid_set as (
  select field, value, arg_max(ml_id, ordinal) as ml_id from recs where value <> '' group by field, value),
meta_paths as (
  select r.field, q.name, arg_max(q.path, q.ordinal) as path, min(q.ordinal) as first
  from recs r join reqs q using (ordinal) where q.path <> '' group by r.field, q.name)
"""

# Validation: observed values, primary status, best configuration, payload.
VALIDATE = f"""
obs as (
  select r.exec_id, r.path, {norm('r.v', "coalesce((select field_type = 'INTEGER' from ftypes f where f.field = m.field), false)")} as v
  from ex_raw r left join mappings m on m.path = r.path and m.is_primary),
prim as (
  select o.exec_id, m.field, m.path, o.v as value, m.f_ord,
         case when m.field = 'instanceType'
              then coalesce((select lower(s.v) from ex_raw s where s.exec_id = o.exec_id
                             and s.path = 'sutInstanceMetadata.sutType'), '') = 'cloud'
              else true end as applicable
  from mappings m join obs o on o.path = m.path where m.is_primary),
prim2 as (
  select p.*, p.value in ('', 'nan') as empty, v.value is not null as hit,
         p.applicable and (p.value in ('', 'nan') or v.value is null) as prim_invalid
  from prim p left join valid_set v on v.field = p.field and v.value = p.value),
cpu_of as (select exec_id, value as cpu from prim2 where field = 'CPUModel'),
obs_meta as (
  select o.exec_id, o.path, {norm('o.v', "coalesce((select field_type = 'INTEGER' from ftypes f where f.field = mp.name), false)")} as v, mp.name
  from ex_raw o join (select distinct name, path from meta_paths) mp on mp.path = o.path
  union all
  select c.exec_id, 'processor_details.family', coalesce(pr.family, ''), 'Family'
  from cpu_of c left join proc pr on pr.cpu = c.cpu and c.cpu <> ''),
cfg_eval as (
  select p.exec_id, p.field, c.ordinal, c.ml_id, c.name, c.path, c.req_pos, coalesce(om.v, '') as mv,
         case when coalesce(om.v, '') in ('', 'nan') or {dp("coalesce(om.v, '')")} <> {dp('c.required')}
              then 'invalid' else 'valid' end as mstatus
  from prim2 p join configs c on c.field = p.field and c.value = p.value
  left join obs_meta om on om.exec_id = p.exec_id and om.path = c.path and om.name = c.name
  where p.applicable and not p.prim_invalid),
cfg_err as (
  select exec_id, field, ordinal, ml_id, count(*) filter (where mstatus = 'invalid') as errors
  from cfg_eval group by exec_id, field, ordinal, ml_id),
best as (
  select * from (select *, row_number() over (partition by exec_id, field order by errors, ordinal) as rn from cfg_err)
  where rn = 1),
pstatus as (
  select p.exec_id, p.field, p.value, case when p.prim_invalid then 'invalid' else 'valid' end as status,
         p.applicable, p.empty, b.ml_id as best_ml_id, b.ordinal as best_ordinal, b.errors as best_errors,
         p.prim_invalid or coalesce(b.errors, 0) > 0 as overall_invalid, p.prim_invalid, p.path, p.f_ord
  from prim2 p left join best b on b.exec_id = p.exec_id and b.field = p.field),
payload as (
  select s.exec_id, s.field, s.value, s.status as validation_status, s.path as mapping,
         e.req_pos as meta_pos, e.name as meta_name, e.mv as meta_value, e.mstatus as meta_status, e.path as meta_mapping
  from pstatus s join cfg_eval e on e.exec_id = s.exec_id and e.field = s.field and e.ordinal = s.best_ordinal
  where s.overall_invalid and not s.prim_invalid
  union all
  select s.exec_id, s.field, s.value, 'invalid', s.path,
         cast(row_number() over (partition by s.exec_id, s.field order by mp.first, mp.name) - 1 as integer),
         mp.name, coalesce(om.v, ''), 'invalid', mp.path
  from pstatus s join meta_paths mp on mp.field = s.field
  left join obs_meta om on om.exec_id = s.exec_id and om.path = mp.path and om.name = mp.name
  where s.prim_invalid and not s.empty
  union all
  select s.exec_id, s.field, s.value, 'invalid', s.path, null, null, null, null, null
  from pstatus s where s.prim_invalid and s.empty),
inv_names as (
  select exec_id, field as name from payload where validation_status = 'invalid'
  union select exec_id, meta_name from payload where meta_status = 'invalid'),
verdict as (
  select x.exec_id, not exists (select 1 from pstatus s where s.exec_id = x.exec_id and s.overall_invalid) as is_valid,
         coalesce((select count(*) from pstatus s where s.exec_id = x.exec_id and s.overall_invalid), 0) as n_invalid_fields,
         coalesce((select string_agg(name, ',' order by name) from inv_names n where n.exec_id = x.exec_id), '') as invalid_names
  from ex x)
"""


def with_ctes(*parts: str) -> str:
    return "with " + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip())
