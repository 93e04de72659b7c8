"""DuckDB SQL of those operators that it can express."""

from __future__ import annotations

#: CRC-32 of the bytes b with the table t: t by eight halvings of each number, the reversed polynomial 0xEDB88320.
CRC_TABLE = "crc_table as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"
UTF8 = """flatten(list_transform(string_split({0}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] when unicode(x) < 2048 then [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]
    when unicode(x) < 65536 then [224 + (unicode(x) >> 12), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)]
    else [240 + (unicode(x) >> 18), 128 + ((unicode(x) >> 12) & 63), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)] end))"""


def crc(text: str) -> str:
    """The checksum of a text; the table is a column t."""
    steps = f"list_reduce(list_prepend(4294967295::bigint, {UTF8.format(text)}), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))"
    return f"case when {text} = '' then 0 else xor({steps}, 4294967295) end"


#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64


def wide(x: str) -> str:
    return f"({x})::uhugeint"


def product(x: str, y: int) -> str:
    return f"(({x}) * {y}::uhugeint % {WORD}::uhugeint)"


def turned(x: str, n: int) -> str:
    return f"((({x}) * {1 << n}::uhugeint % {WORD}::uhugeint) + (({x}) // {1 << (64 - n)}::uhugeint))"


def hashed(table: str, name: str, columns: list[str], keep: str) -> str:
    """CTEs name_1 ... that hash whole numbers of 64 bits one after the other, each with the last one's hash as its seed, 42 at first.

    The last has the hash as h, unsigned; ``keep`` lists the columns that go along. Negative numbers count as their bits.
    """
    out, source = [], f"(select *, 42::uhugeint as h from {table})"
    for k, c in enumerate(columns):
        bits = f"(case when {c} < 0 then {WORD}::hugeint + {c} else {c} end)"
        steps = [
            ("h", f"xor(({wide('h')} + {P5}::uhugeint + 8) % {WORD}::uhugeint, {product(turned(product(wide(bits), P2), 31), P1)})"),
            ("h", f"({product(turned('h', 27), P1)} + {P4}::uhugeint) % {WORD}::uhugeint"),
            ("h", product(f"xor(h, h // {1 << 33}::uhugeint)", P2)),
            ("h", product(f"xor(h, h // {1 << 29}::uhugeint)", P3)),
            ("h", f"xor(h, h // {1 << 32}::uhugeint)"),
        ]
        for j, (_, step) in enumerate(steps):
            out.append(f"{name}_{k}_{j} as (select {keep}, {step} as h from {source})")
            source = f"{name}_{k}_{j}"
    return ",\n".join(out) + f",\n{name} as (select * from {source})"


def op12(shards: int, buckets: int, overhead: int) -> str:
    """Shards by the greatest uniform number of a hash of doc_id and shard, as all weights are one."""
    return f"""with {CRC_TABLE},
doc as (select doc_id::bigint as doc_id, strlen(coalesce(text, ''))::bigint + {overhead} as size, {crc("coalesce(text, '')")} as text_crc32 from documents, crc_table),
key as (select distinct doc_id from doc), pair as (select doc_id, s::bigint as s from key, range({shards + 1}) r(s)),
{hashed("pair", "drawn", ["doc_id", "s"], "doc_id, s")},
best as (select doc_id, arg_max(s, h // 4096::uhugeint * 100 - s) filter (where s < {shards}) as shard, arg_max(s, h // 4096::uhugeint * 100 - s) as grown from drawn group by doc_id),
{hashed("doc", "dealt", ["doc_id", "size", "text_crc32"], "doc_id, size, text_crc32")},
placed as (select *, (case when h >= {WORD >> 1}::uhugeint then h::hugeint - {WORD}::hugeint else h::hugeint end % {buckets} + {buckets}) % {buckets} as bucket from dealt join best using (doc_id))
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by bucket, doc_id, size, text_crc32) - 1 as slot, grown::int as grown_shard from placed"""


OP11 = r"""with doc as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
word as (select lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from doc),
kept as (select lang, term, count(*) as lang_n from word group by lang, term having count(distinct id) >= {least}),
own as (select lang, source, term, count(*) as n from word join kept using (lang, term) group by all),
grp as (select distinct lang, source from doc),
every as (select lang, source, term, coalesce(n, 0) as n, lang_n from grp join kept using (lang) left join own using (lang, source, term)),
total as (select *, sum(n) over (partition by lang, source) as own_total, count(*) over (partition by lang, source) as v, sum(lang_n) over (partition by lang, source) as lang_total from every),
share as (select *, 1 + (1000000000::hugeint*(n + 5)) // (own_total + 5*v)::hugeint as p, 1 + (1000000000::hugeint*(lang_n + 5)) // (lang_total + 5*v)::hugeint as q from total),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from share where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= {top}"""

#: The cheapest edits, then the first by letters, to each state after each turn: u, a due and the state after, as the operator has them.
OP13 = rf"""with recursive {CRC_TABLE},
raw as (select conv_id, turn::bigint as turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
marked as (select *, {crc("k")} % 20 as m from raw, crc_table),
damaged as (select conv_id, turn, case when m = 4 then 'user' else role end as role, case when m = 1 then '' when m = 2 then translate(text, '.!?', '') else text end as text, unnest(case when m = 3 then [0, 1] else [0] end) as copy from marked where m <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by n) > 1 as again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from ordered),
x as (select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by n) as c_before, count(*) over (partition by conv_id) as size from seen),
due(q, role, next) as (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
put(q, r, cost, letters, lines) as (select q, q, 0, '', []::varchar[] from due union all select q, next, 3, 'I', [role || ':'] from due union all select a.q, b.next, 6, 'II', [a.role || ':', b.role || ':'] from due a join due b on b.q = a.next),
may(c, q, next) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
run as (
  select distinct conv_id, 0::bigint as n, 0 as q, 0 as cost, '' as audit, []::varchar[] as lines from x
  union all
  select conv_id, n, q, b.cost, b.audit, b.lines from (
    select conv_id, n, q, arg_min({{'cost': cost, 'audit': audit, 'lines': lines}}, {{'cost': cost, 'audit': audit}}) as b from (
      select x.conv_id, x.n, w.q, run.cost + put.cost + w.cost as cost, run.audit || put.letters || w.letter as audit, run.lines || put.lines || w.line as lines
      from run join put on put.q = run.q join x on x.conv_id is not distinct from run.conv_id and x.n = run.n + 1
      join lateral (select put.r as q, 4 as cost, 'D' as letter, []::varchar[] as line
        union all select next, case when x.fault = 'truncated' then 3 else 0 end, 'K', [x.role || ':' || x.text] from may where may.c = x.c and may.q = put.r and x.fault not in ('blank', 'duplicate')
        union all select next, 3 + case when x.fault = 'truncated' then 3 else 0 end, 'R', [due.role || ':' || x.text] from due where due.q = put.r and x.fault not in ('blank', 'duplicate')) w on true)
    group by conv_id, n, q)),
ending as (select run.conv_id, arg_min({{'cost': run.cost + put.cost, 'audit': audit || letters, 'lines': run.lines || put.lines}}, {{'cost': run.cost + put.cost, 'audit': audit || letters}}) as b
  from run join put on put.q = run.q and put.r in (0, 3) join (select conv_id, max(n) as n from x group by conv_id) e on e.conv_id is not distinct from run.conv_id and e.n = run.n group by run.conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
  count_if(c_before is not null and c_before || c not in ('su', 'ua', 'au')) as illegal from x group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(b.cost, 0)::bigint as cost, coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join ending e on e.conv_id is not distinct from o.conv_id"""
