"""SQL of the queries that SQL can express, over the given tables."""

from __future__ import annotations

from vellum.llm.quality_rules import LEAST_ROWS, SCALE, SLACK, SPREADS

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

JACCARD_JOIN = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORDS}) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
link as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
sides as (select a, b from link union all select b, a from link),
reach as (select a as x, a as y from sides union select x, b from reach join sides on a = y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(r.least, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select x as doc_id, min(y) as least from reach group by 1) r using (doc_id)
"""

MIXING = f"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || coalesce(text, '')), 1, 15))::bigint as hash from documents),
per as (select source, sum(size)::bigint as source_size from s group by 1),
w as (select source, source_size, ([5.0::double, 2, 1])[1 + (row_number() over (order by source nulls last) - 1) % 3] as w, (3 * source_size)::double as cap from per),
m as (select *, sum(source_size) over ()::double as want,
  coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest from w),
f as (select *, cap * rest <= (want - before) * w as is_full from m),
t as (select source, source_size, case when is_full then cap
  else (want - coalesce(sum(case when is_full then cap end) over (), 0)) / sum(case when not is_full then w end) over () * w end as target from f),
k as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
h as (select source, hash, sum(size) as n from s where size > 0 group by all),
u as (select *, coalesce(sum(n) over (partition by source order by hash rows between unbounded preceding and 1 preceding), 0) as before from h),
x as (select k.source, case when 2 * (target - whole * source_size - before) >= n then hash else hash - 1 end as threshold
  from u join k on u.source is not distinct from k.source
  where before <= target - whole * source_size and target - whole * source_size < before + n)
select doc_id, size, source_size, target,
  (size * (whole + case when hash <= coalesce(threshold, -1) then 1 else 0 end))::bigint as taken
from s join k on s.source is not distinct from k.source left join x on s.source is not distinct from x.source
"""

_VALUE = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def _value(measure: str) -> str:
    top, below = _VALUE[measure]
    return f"({top} * {SCALE} // greatest({below}, 1))"


_MEASURES = ", ".join(f"{{'measure': '{k}', 'v': {_value(k)}}}" for k in _VALUE)
_SLACKS = " ".join(f"when '{k}' then {v}" for k, v in SLACK.items())


def _limit(name: str, keys: str) -> str:
    group = f"{keys}, " if keys else ""
    return f"""{name}_s as (select {group}measure, bucket, sum(n) as n from hist group by all),
{name}_u as (select *, sum(n) over (partition by {group}measure order by bucket) as up, sum(n) over (partition by {group}measure) as every from {name}_s),
{name}_q as (select {group}measure, min(bucket) filter (100 * up >= 25 * every) as lo, min(bucket) filter (100 * up >= 75 * every) as hi, max(every) as n_rows from {name}_u group by all),
{name} as (select {group}measure, n_rows, hi + {SPREADS} * (hi - lo) + case measure {_SLACKS} end as most from {name}_q)"""


QUALITY_RULES = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) as lines from documents),
win as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win) where n > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by 1),
base as (select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join covered using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
long as (select doc_id, lang, source, base_failed, m.measure, m.v from (select *, unnest([{_MEASURES}]) as m from judged)),
hist as (select lang, source, measure, case when v < 256 then v else (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) end as bucket, count(*) as n
  from long where not base_failed group by all),
{_limit("own", "lang, source")},
{_limit("per_lang", "lang")},
{_limit("overall", "")},
fine as (select l.doc_id, bool_and(v <= coalesce(case when o.n_rows >= {LEAST_ROWS} then o.most when p.n_rows >= {LEAST_ROWS} then p.most when o.most is not null then g.most end, v)) as ok
  from long l left join own o on l.lang is not distinct from o.lang and l.source is not distinct from o.source and l.measure = o.measure
  left join per_lang p on l.lang is not distinct from p.lang and l.measure = p.measure left join overall g on l.measure = g.measure group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from judged join fine using (doc_id)
"""

WARC = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
  row_number() over (partition by coalesce(html, '') order by page_id desc nulls last, url desc nulls last) as place,
  first(page_id) over (partition by coalesce(html, '') order by page_id desc nulls last, url desc nulls last) as kept from pages)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and place > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and place > 1 then kept end as refers_to from p
"""

_CRC_BIT = "case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
PREFIX_TRIE = f"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as r from conversations where conv_id is not null),
b as (select distinct c, c - c % 5 as base, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint) as codes from t),
h as (select c, base, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda crc, code:
  list_reduce(list_prepend(xor(crc, code), range(8)), lambda x, i: {_CRC_BIT})), 4294967295::bigint) % 9 as h from b),
rows as (select h.c, 0 as own, r, role, text from h join t on t.c = h.base and t.r <= h.h
  union all select h.c, 1, r, role, text from h join t on t.c = h.c and t.r > h.h),
p as (select *, row_number() over (partition by c order by own, r) as depth, list({{'r': role, 't': text}}) over (partition by c order by own, r) as prefix from rows),
k as (select c, depth, prefix[:depth - 1] as above, prefix, strlen(text) as bytes from p
  union all select c, 0, null, []::struct(r varchar, t varchar)[], 0 from h),
n as (select prefix, depth, min(c) as conv_id, count(*) as n_convs, any_value(above) as above, any_value(bytes) as bytes from k group by all),
l as (select c, max(depth) as depth from k group by 1),
e as (select prefix, sha256(string_agg(c::varchar, ',' order by c)) as ends from l join k using (c, depth) group by 1),
d as (select above as prefix, count(*) as n_children from n where depth > 0 group by 1),
leaf as (select n.* from n left join d using (prefix) where d.prefix is null),
up as (select prefix[:i] as prefix, 0::bigint as leaves, (n_convs - 1) * bytes as saved from n, lateral (select unnest(range(depth + 1)) as i)
  union all select prefix[:i], 1, 0 from leaf, lateral (select unnest(range(depth + 1)) as i)),
sub as (select prefix, sum(leaves)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from up group by 1)
select n.conv_id, n.depth, a.conv_id as parent_conv_id, n.n_convs, coalesce(d.n_children, 0) as n_children, n_leaves, saved_tokens,
  coalesce(e.ends, sha256('')) as ends_sha256
from n join sub using (prefix) left join d using (prefix) left join e using (prefix) left join n a on n.depth > 0 and a.prefix = n.above
"""

PHRASES = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, m, unnest(list_transform(range(1, (len(w) - m + 2)::bigint), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4, 5]) as m) where len(w) >= m),
f as materialized (select lang, m, phrase, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where m = 1 group by 1),
c as (select * from f where m > 1 and a >= 100),
inner_parts as (select distinct c.lang, c.a, array_to_string(string_split(c.phrase, ' ')[i:i + k - 1], ' ') as phrase
  from c, (select unnest(range(1, 5)) as i), (select unnest(range(2, 5)) as k) where k < c.m and i + k - 1 <= c.m),
o as (select c.* from c where not exists (select 1 from inner_parts x where x.lang = c.lang and x.phrase = c.phrase and 100 * x.a >= 100 * c.a)),
sides as (select o.*, k, array_to_string(string_split(o.phrase, ' ')[:k], ' ') as lp, array_to_string(string_split(o.phrase, ' ')[k + 1:], ' ') as rp
  from o join (select unnest(range(1, 5)) as k) on k < o.m),
cut as (select s.lang, s.phrase, s.a, k, l.a as l, r.a as r, n.n, ((1000::hugeint * s.a * n.n) // (l.a::hugeint * r.a))::bigint as score
  from sides s join f l on l.lang = s.lang and l.phrase = s.lp join f r on r.lang = s.lang and r.phrase = s.rp join n on n.lang = s.lang),
b as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
