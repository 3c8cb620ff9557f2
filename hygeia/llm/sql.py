"""DuckDB SQL of the conversation repair and of the spelling variants."""

from __future__ import annotations

#: The table of crc32 (reflected polynomial 0xEDB88320), from its rule.
_CRC_TABLE = """crc as (
  select list(c order by i) as tab from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
    from (select unnest(range(256)) as i)))"""


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of an expression; ``crc.tab`` must be in reach."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _least(ways: list[str]) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str, text: str = "''", when: str = "true") -> str:
    """A path longer by one edit: cost, letters, repaired text; without end where the edit can't be."""
    return (f"{{'c': case when {when} then {state}.c + {cost} else 1000000000 end, 'a': {state}.a || '{letter}', "
            f"'t': {state}.t || {text}}}")


def _repair() -> str:
    kept = "o.role || ':' || o.text || chr(10)"
    user, assistant = "'user:' || o.text || chr(10)", "'assistant:' || o.text || chr(10)"
    new_user, new_assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    may = "not o.must"

    def keep(state, initial):
        return _way(state, "o.cut", "K", kept, f"{may} and o.x = '{initial}'")

    def rerole(state, text):
        return _way(state, "2 + o.cut", "R", text, may)

    gone = lambda s: _way(s, "3", "D")
    b0 = gone("v.s0")
    b1 = _least([gone("v.s1"), keep("v.s0", "s")])
    b2 = _least([gone("v.s2"), *(keep(s, "u") for s in ("v.s0", "v.s1", "v.s3")), *(rerole(s, user) for s in ("v.s0", "v.s1", "v.s3"))])
    b3 = _least([gone("v.s3"), keep("v.s2", "a"), rerole("v.s2", assistant)])
    a2 = _least(["b2", *(_way(s, "2", "I", new_user) for s in ("b0", "b1", "b3"))])
    a3 = _least(["b3", _way("a2", "2", "I", new_assistant)])
    return f"""
with recursive {_CRC_TABLE},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, crc),
hit as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
               case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text,
               unnest(range(case when k = 3 then 2 else 1 end)) as copy
        from k where k <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hit),
ordered as (select *, row_number() over (partition by conv_id, role, text order by i) as seen,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ends from placed),
fault as (select *, case when ends = '' then 'blank' when seen > 1 then 'duplicate' when right(ends, 1) not in ('.', '!', '?') then 'truncated' end as f,
                 left(role, 1) as x, lag(left(role, 1)) over (partition by conv_id order by i) as before from ordered),
o as (select conv_id, i, role, text, x, coalesce(f in ('blank', 'duplicate'), false) as must, (coalesce(f, '') = 'truncated')::int as cut from fault),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 'blank') as blank,
                  count(*) filter (where f = 'duplicate') as duplicate, count(*) filter (where f = 'truncated') as truncated,
                  count(*) filter (where before is not null and before || x not in ('su', 'ua', 'au')) as illegal, count(*) as n
           from fault group by conv_id),
v as (
  select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 't': ''}} as s0, {{'c': 1000000000, 'a': '', 't': ''}} as s1,
         {{'c': 2, 'a': 'I', 't': 'user:' || chr(10)}} as s2, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} as s3
  from counts
  union all
  select conv_id, i, b0 as s0, b1 as s1, a2 as s2, {a3} as s3 from (
    select *, {a2} as a2 from (
      select v.conv_id, o.i, {b0} as b0, {b1} as b1, {b2} as b2, {b3} as b3
      from v join o on v.conv_id is not distinct from o.conv_id and o.i = v.i + 1))),
best as (select v.conv_id, list_min([s0, s3]) as s from v join counts c on v.conv_id is not distinct from c.conv_id and v.i = c.n)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(s.c, 0)::bigint as cost,
       coalesce(s.a, '') as audit, sha256(coalesce(left(s.t, length(s.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join counts on e.conv_id is not distinct from counts.conv_id
     left join best on e.conv_id is not distinct from best.conv_id"""


CONVERSATION_REPAIR = _repair()

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPELLING_VARIANTS = rf"""
with recursive {_CRC_TABLE},
d as (select row_number() over () as r, coalesce(doc_id::varchar, '') as id, translate(text, '{_LETTERS}', '{_LETTERS.lower()}') as t from documents),
run as (select r, id, x, count(*) as n from (select r, id, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) as x from d) group by all),
h as (select x, n, {_crc32("id || ':' || x")} as h from run, crc),
spelt as (select case when h % 97 = 0 then left(x, (h % length(x))::int) || substr(x, (h % length(x))::int + 2) else x end as word, n from h),
w as (select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by word having sum(n) >= 3),
del as (select word, n, i, left(word, i) || substr(word, i + 2) as v from (select word, n, unnest(range(length(word))) as i from w)),
pairs as (
  select a.word, b.word as near, b.n as m from del a join del b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select del.word, w.word, w.n from del join w on del.v = w.word
  union select w.word, del.word, del.n from del join w on del.v = w.word),
top as (select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from pairs group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then near end as form, case when m >= 2 * w.n then m end as form_n
      from w left join top using (word)),
chain as (select word, form as at from f where form is not null
          union all select chain.word, f.form from chain join f on f.word = chain.at where f.form is not null),
root as (select chain.word, arg_max(chain.at, f.n) as root from chain join f on f.word = chain.at group by chain.word)
select f.word, form, coalesce(root.root, f.word) as root, f.n, n_near::bigint as n_near, form_n
from f left join root on root.word = f.word"""
