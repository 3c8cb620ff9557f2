"""Oracle SQL: text scores of the fuzzy joins in DuckDB, on columns or expressions without side effects."""


def lcs(a: str, b: str) -> str:
    """Bit-parallel over HUGEINT: the shorter text has at most 120 characters."""
    s = f"(case when len({a}) <= len({b}) then {a} else {b} end)"
    t = f"(case when len({a}) <= len({b}) then {b} else {a} end)"
    full = f"((1::hugeint << len({s})) - 1)"
    masks = (f"list_transform(string_split({t}, ''), lambda ch: list_sum(list_transform(range(len({s})), "
             f"lambda i: case when {s}[i + 1] = ch then 1::hugeint << i::int else 0::hugeint end))::hugeint)")
    state = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(case when len({s}) = 0 then 0 else len({s}) - bit_count({state}) end)"


def share(distance: str, size: str) -> str:
    return f"(case when ({size}) = 0 then 100.0::double else 100.0::double * (1.0::double - ({distance})::double / ({size})) end)"


def ratio(a: str, b: str) -> str:
    return share(f"len({a}) + len({b}) - 2 * {lcs(a, b)}", f"len({a}) + len({b})")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def token_set(name: str, source: str, a: str, b: str) -> str:
    """CTEs ending in ``{name}``: the rows of ``source`` with token_set, the score of its columns a and b."""
    rests = share(f"len(xa) + len(xb) - 2 * {lcs('xa', 'xb')}", "sa + sb")
    return f"""
{name}_w as (select *, list_sort(list_distinct({words(a)})) as ta, list_sort(list_distinct({words(b)})) as tb from {source}),
{name}_x as (
  select *, len(array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ')) as nb,
         coalesce(array_to_string(list_filter(ta, lambda w: not list_contains(tb, w)), ' '), '') as xa,
         coalesce(array_to_string(list_filter(tb, lambda w: not list_contains(ta, w)), ' '), '') as xb from {name}_w),
{name}_y as (
  select *, coalesce(nb, 0) + (case when nb > 0 then 1 else 0 end) + len(xa) as sa,
         coalesce(nb, 0) + (case when nb > 0 then 1 else 0 end) + len(xb) as sb from {name}_x),
{name} as (
  select *, case when len(ta) = 0 or len(tb) = 0 then 0.0 when nb > 0 and (xa = '' or xb = '') then 100.0
                 when coalesce(nb, 0) = 0 then {rests}
                 else greatest({rests}, {share('1 + len(xa)', 'nb + sa')}, {share('1 + len(xb)', 'nb + sb')}) end as token_set
  from {name}_y)"""


def partial(name: str, source: str, a: str, b: str) -> str:
    """CTEs ending in ``{name}`` (a, b, partial): the best window for each distinct (a, b) of ``source``. Each window is one row."""
    window = "substr(t, greatest(p, 1)::int, (least(p + len(s) - 1, len(t)) - greatest(p, 1) + 1)::int)"
    return f"""
{name}_d as (select distinct {a} as a, {b} as b from {source}),
{name}_o as (
  select a, b, case when len(a) <= len(b) then a else b end as s, case when len(a) <= len(b) then b else a end as t from {name}_d
  union all select a, b, b, a from {name}_d where len(a) = len(b)),
{name}_w as (
  select a, b, s, {window} as w from (
    select *, unnest(range(2 - len(s), len(t) + 1)) as p from {name}_o where len(s) > 0 and not contains(t, s))),
{name}_e as (select s, w, {ratio('s', 'w')} as r from (select distinct s, w from {name}_w)),
{name}_m as (select a, b, max(r) as r from {name}_w join {name}_e using (s, w) group by a, b),
{name} as (
  select d.a, d.b, case when d.a = '' or d.b = '' then 0.0 when contains(d.a, d.b) or contains(d.b, d.a) then 100.0 else m.r end as partial
  from {name}_d d left join {name}_m m using (a, b))"""
