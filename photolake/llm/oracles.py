"""SQL of those corpus operators that SQL can express, for DuckDB."""

from __future__ import annotations

#: CRC-32 of a text of code points below 256, bit by bit.
_BYTES = "flatten(list_transform(string_split({s}, ''), lambda ch: case when ord(ch) < 128 then [ord(ch)::bigint] else [195::bigint, ord(ch)::bigint - 64] end))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"


def _crc(s: str) -> str:
    return _CRC.format(s=s)


SPELLING = rf"""with recursive runs as (select coalesce(cast(doc_id as varchar), '') as d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
per as (select d, w, count(*) as k from runs group by 1, 2),
hashed as (select w, k, {_crc("d || ':' || w")} as h from per),
said as (select case when h % 97 = 0 then left(w, cast(h % length(w) as bigint)) || substr(w, cast(h % length(w) as bigint) + 2) else w end as word, k from hashed),
vocab as (select word, cast(sum(k) as bigint) as n from said where length(word) >= 5 group by 1 having sum(k) >= 3),
cuts as (select word, n, length(word) as size, i, left(word, i - 1) || substr(word, i + 1) as cut from (select *, unnest(range(1, length(word) + 1)) as i from vocab)),
near as (select a.word, b.word as other, b.n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.size = b.size and a.word <> b.word
 union select c.word, v.word, v.n from cuts c join vocab v on v.word = c.cut union select v.word, c.word, c.n from cuts c join vocab v on v.word = c.cut),
best as (select word, count(*) as n_near, max(n) as most from near group by 1),
form as (select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.most >= 2 * v.n then b.most end as form_n, case when b.most >= 2 * v.n then (select min(x.other) from near x where x.word = v.word and x.n = b.most) end as form from vocab v left join best b using (word)),
chain as (select word, word as here, 0 as step from form union all select c.word, f.form, c.step + 1 from chain c join form f on f.word = c.here where f.form is not null)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from form f join (select word, max_by(here, step) as root from chain group by 1) c using (word)"""


def _more(state: str, cost: str, letter: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} end"


#: Cheapest edits by what was written last (s0 nothing, s1 system, s2 user, s3 assistant), first with one insertion at most (t), then over a row.
_INSERTED = f"s0 as t0, s1 as t1, least(s2, {_more('s0', '3', 'I')}, {_more('s1', '3', 'I')}, {_more('s3', '3', 'I')}) as t2, least(s3, {_more('s2', '3', 'I')}) as t3"


def _kept(state: str, initial: str) -> str:
    return f"case when not gone and initial = '{initial}' then {_more(state, 'more', 'K')} end"


def _changed(state: str) -> str:
    return f"case when not gone then {_more(state, '(3 + more)', 'R')} end"


_OVER = ", ".join(
    (
        f"{_more('t0', '4', 'D')} as s0",
        f"least({_more('t1', '4', 'D')}, {_kept('t0', 's')}) as s1",
        "least(" + ", ".join((_more("t2", "4", "D"), *(x for t in ("t0", "t1", "t3") for x in (_kept(t, "u"), _changed(t))))) + ") as s2",
        f"least({_more('t3', '4', 'D')}, {_kept('t2', 'a')}, {_changed('t2')}) as s3",
    )
)

REPAIR = rf"""with recursive marked as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from marked),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from damaged),
faulty as (select *, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when seen > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end as fault from placed),
rws as (select *, fault in ('b', 'd') as gone, case when fault = 't' then 3 else 0 end as more, lag(initial) over (partition by conv_id order by i) as before from faulty),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from rws group by 1),
ways as (select conv_id, 0::bigint as i, {{'c': 0, 'a': ''}} as s0, null::struct(c integer, a varchar) as s1, null::struct(c integer, a varchar) as s2, null::struct(c integer, a varchar) as s3 from facts
 union all select conv_id, i, {_OVER} from (select r.*, {_INSERTED} from ways w join rws r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1)),
ended as (select conv_id, least(t0, t3) as best from (select w.conv_id, {_INSERTED} from ways w join facts f on f.conv_id is not distinct from w.conv_id and f.n = w.i)),
letters as (select conv_id, p, substr(best.a, p, 1) as letter from (select *, unnest(range(1, length(best.a) + 1)) as p from ended)),
said as (select *, count(*) filter (letter <> 'I') over (partition by conv_id order by p) as i, row_number() over (partition by conv_id, letter <> 'D' order by p) - 1 as place from letters),
written as (select s.conv_id, s.p, s.place, s.letter, r.role, case when s.letter = 'I' then '' else r.text end as text, first_value(case when s.letter = 'K' and r.initial = 's' then 1 else 0 end) over (partition by s.conv_id order by s.p) as system from said s left join rws r on r.conv_id is not distinct from s.conv_id and r.i = s.i where s.letter <> 'D'),
whole as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (place + system) % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by p)) as digest from written group by 1),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal, cast(coalesce(d.best.c, 0) as bigint) as cost, coalesce(d.best.a, '') as audit, coalesce(w.digest, sha256('')) as repaired_sha256
 from every e left join facts f on f.conv_id is not distinct from e.conv_id left join ended d on d.conv_id is not distinct from e.conv_id left join whole w on w.conv_id is not distinct from e.conv_id"""
