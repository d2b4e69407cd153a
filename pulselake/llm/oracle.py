"""SQL for the text queries that SQL can express."""

from .quality import BOILERPLATE, BORDER, MENU, phrase_pattern

ORACLE: dict[str, str] = {}

ORACLE["op1_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) as k from (select doc_id, h, unnest(range(0, n - 199)) as s from d where n >= 200)),
rep as (select doc_id, s from (select doc_id, s, count(*) over (partition by k) as c from win) where c > 1),
cut as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 200 then 0 else 1 end as fresh from rep),
run as (select doc_id, min(s) as a, max(s) + 200 as b from (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as g from cut) group by doc_id, g),
gap as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from run),
kept as (select doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) as front, max(b) as e, sum(b - a) as removed, count(*) as spans from gap join d using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when spans is null then h else coalesce(front, '') || substr(h, 2 * e + 1) end)) as kept_sha256 from d left join kept using (doc_id)"""

ORACLE["op3_minhash_near_dedup"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select doc_id, unnest(list_distinct(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) when len(ws) = 1 then ws else []::varchar[] end)) as s from w),
n as (select doc_id, count(*) as n from sh group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 80 * (nx.n + ny.n - k)),
e as (select x, y from l union select y, x from l),
r as (select doc_id as id, doc_id as reach from documents union select r.id, e.y from r join e on e.x = r.reach)
select id as doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(reach) as component_id, id = min(reach) as kept from r left join n on n.doc_id = id group by id"""

_BOILERPLATE, _MENU = (phrase_pattern(p, BORDER).replace("'", "''") for p in (BOILERPLATE, MENU))
ORACLE["op2_line_quality"] = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
gram as (select doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) > 2)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from gram) where c > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by 1),
line as (select doc_id, ls[i] as line, i from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from d))),
seen as (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') as t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as nw from line),
judged as (select doc_id, i, line, nw, nw > 0 and (
    (nw <= 25 and regexp_matches(t, '(?i){_BOILERPLATE}')) or (nw <= 4 and regexp_matches(t, '(?i){_MENU}'))
    or (len(regexp_extract_all(t, '\s[|>»·•]\s')) >= 3 and 4 * len(regexp_extract_all(t, '\s[|>»·•]\s')) >= nw)
    or len(regexp_extract_all(t, '[#*$%&|<>]')) > 0.10::double * greatest(1, length(t)) or len(regexp_extract_all(t, '[{{}}]')) > 0.05::double * length(t)
    or not regexp_matches(t, '[.!?:;…。！？]["''”’»)\]]*$|["”»]$')) as bad from seen),
sums as (select doc_id, count_if(nw > 0) as n_lines, count_if(nw > 0) - count(distinct case when nw > 0 then line end) as dup, count_if(bad) as n_bad, coalesce(sum(length(line)) filter (where bad), 0) as lost,
    coalesce(sum(length(line)) filter (where nw > 0), 0) as total, string_agg(case when not bad then line end, chr(10) order by i) as clean from judged group by 1),
base as (select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(r.n, 0)::bigint as n_repeat_words from d left join repeats r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, dup::bigint as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.30::double * total as kept, n_lines::bigint as n_lines, n_bad::bigint as n_failed_lines, lost::bigint as lost_chars, sha256(coalesce(clean, '')) as clean_sha256 from base join sums using (doc_id)"""

ORACLE["op6_bin_packing"] = """
with recursive bits(n, v, round) as (select range, range, 0 from range(256) union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, round + 1 from bits where round < 8),
tab as (select list(v order by n) as t from bits where round = 8),
d as (select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size, text, coalesce(sha256(text), '04f8ff2682604862e405bf88de102ed7710ac45c1205957625e4ee3e5f5a2241') as k from documents),
g as (select k, sum(size)::bigint as bytes, row_number() over (order by sum(size) desc, k) as i from d group by k),
cap as (select ceil(sum(bytes) / 8.0)::bigint as c from g),
r as (select 0::bigint as i, [c, c, c, c, c, c, c, c] as left_, 0 as shard from cap union all
  select i, list_transform(left_, lambda x, p: case when p = pos_ then x - bytes else x end), pos_::int - 1 from (
    select g.i, g.bytes, r.left_, case when list_max(r.left_) >= g.bytes then list_position(r.left_, list_min(list_filter(r.left_, lambda x: x >= g.bytes)))
      else 9 - list_position(list_reverse(r.left_), list_max(r.left_)) end as pos_ from r join g on g.i = r.i + 1)),
p as (select d.*, r.shard from d join g using (k) join r using (i))
select doc_id, size::bigint as size, coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295), 0)::bigint as text_crc32, 'bytes' as law, shard::int as shard, row_number() over (partition by shard order by sha256(concat_ws(' ', k, doc_id::varchar))) - 1 as slot, null::int as grown_shard from p, tab"""
