"""SQL twins of the text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import license_scan
from .sharding import tree

#: The table of CRC-32 from its rule, and the checksum of a text's bytes by one fold.
CRC_TABLE = "crc_steps as (select i, 0 as k, i as c from range(256) t(i)), crc8 as (select i, list_reduce(list_concat([i::bigint], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) as c from crc_steps), crc as (select list(c order by i) as crc_table from crc8)"
CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b: xor(c >> 8, crc_table[((xor(c, b)) & 255) + 1])))"


def _draw(region: int, rack: int, shard: int) -> str:
    return f"{{'draw': -ln((('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '/{region}/{rack}/{shard}'), 1, 13))::bigint::double + 0.5) / 4503599627370496::double), 'shard': {shard}}}"


def _descend(shards: int) -> str:
    leaves = [_draw(region, rack, s) for region, racks in tree(shards).items() for rack, own in racks.items() for s in own]
    return f"least({', '.join(leaves)}).shard"


SHARDING = f"""with {CRC_TABLE}, d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, cast(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bigint[]) as bytes from documents
), c as (select doc_id, size, {CRC32} as text_crc32 from d, crc), s as (select *, {_descend(40)} as shard, {_descend(41)} as grown_shard from c)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as int) as shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot, cast(grown_shard as int) as grown_shard from s"""

REPEATS = """with d as (select doc_id, encode(coalesce(text, '')) as raw, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, s, raw[s:s + 49] as w from (select doc_id, raw, unnest(range(1, n - 48)) as s from d where n >= 50)),
least as (select w, min(doc_id) as m from w group by 1),
hit as (select w.doc_id, w.s from w join least l on l.w = w.w where l.m < w.doc_id),
edge as (select doc_id, s, s > coalesce(lag(s) over (partition by doc_id order by s) + 50, -1) as opens from hit),
run as (select doc_id, s, sum(opens::int) over (partition by doc_id order by s) as r from edge),
span as (select doc_id, r, min(s) as a, max(s) + 49 as b from run group by 1, 2),
gap as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) + 1 as a, a - 1 as b from span union all select doc_id, max(b) + 1, null from span group by 1),
kept as (select g.doc_id, string_agg(hex(raw[g.a:coalesce(g.b, n)]), '' order by g.a) as h from gap g join d using (doc_id) group by 1),
total as (select doc_id, sum(b - a + 1) as removed, count(*) as spans from span group by 1)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, case when removed is null then sha256(raw) else sha256(unhex(h)) end as kept_sha256
from d left join total using (doc_id) left join kept using (doc_id)"""

#: Enough for pages of well-formed articles with these elements and entities, as the given ones are.
HTML_TEXT = r"""with b as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') as parts from pages),
t as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g'))) as parts from b)
select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as text, cast(length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10))) as bigint) as n_chars from t"""

#: Cheapest edits row by row: of each state the cheapest letters, the ASCII-least of those, with what they make.
CONVERSATIONS = rf"""with recursive {CRC_TABLE}, own as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    cast(list_transform(regexp_extract_all(hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))), '..'), lambda h: ('0x' || h)::bigint) as bigint[]) as bytes from conversations
), hit as (select conv_id, turn, role, text, cast({CRC32} as bigint) % 20 as hit from own, crc), damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when hit = 3 then [0, 1] else [0] end) as copy from hit where hit <> 0
), placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i from damaged),
rows_ as (select conv_id, turn, i, role, text, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from placed),
total as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id),
put(q, q1, letters, price, lines) as (values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, 'user:' || chr(10)), (1, 2, 'I', 3, 'user:' || chr(10)), (3, 2, 'I', 3, 'user:' || chr(10)), (2, 3, 'I', 3, 'assistant:' || chr(10)), (0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(q1, letter, initial, q2, price, role) as (values (0, 'K', 's', 1, 0, null), (0, 'K', 'u', 2, 0, null), (1, 'K', 'u', 2, 0, null), (2, 'K', 'a', 3, 0, null), (3, 'K', 'u', 2, 0, null), (0, 'R', null, 2, 3, 'user'), (1, 'R', null, 2, 3, 'user'), (2, 'R', null, 3, 3, 'assistant'), (3, 'R', null, 2, 3, 'user'), (0, 'D', null, 0, 4, null), (1, 'D', null, 1, 4, null), (2, 'D', null, 2, 4, null), (3, 'D', null, 3, 4, null)),
chain as (
  select conv_id, 0::bigint as i, 0 as q, {{'cost': 0, 'audit': '', 'body': ''}} as best from total
  union all
  select c.conv_id, c.i + 1, e.q2, min({{'cost': c.best.cost + p.price + e.price + case when e.letter <> 'D' and r.fault = 3 then 3 else 0 end, 'audit': c.best.audit || p.letters || e.letter, 'body': c.best.body || p.lines || case when e.letter = 'D' then '' else coalesce(e.role, r.role) || ':' || r.text || chr(10) end}})
  from chain c join rows_ r on r.conv_id is not distinct from c.conv_id and r.i = c.i join put p on p.q = c.q join edit e on e.q1 = p.q1 and (e.initial is null or e.initial = r.initial) and (e.letter = 'D' or r.fault not in (1, 2)) group by c.conv_id, c.i, e.q2
), last as (
  select c.conv_id, min({{'cost': c.best.cost + p.price, 'audit': c.best.audit || p.letters, 'body': c.best.body || p.lines}}) as best from chain c join total t on t.conv_id is not distinct from c.conv_id and t.n = c.i join put p on p.q = c.q and p.q1 in (0, 3) group by c.conv_id
)
select k.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(best.body[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join total t on t.conv_id is not distinct from k.conv_id left join last l on l.conv_id is not distinct from k.conv_id"""

#: Word triples of texts against those of the wordings, by equality of the words.
LICENSES = rf"""with t(wording, label, phrase, w) as (select k, label, phrase, string_split(words, ' ') from (values {', '.join(f"({k}, '{label}', {phrase}, '{words}')" for k, label, phrase, words in license_scan.wordings())}) v(k, label, phrase, words)),
grams as (select wording, tp, w[tp + 1] || ' ' || w[tp + 2] || ' ' || w[tp + 3] as gram from (select wording, w, unnest(range(0, len(w) - 2)) as tp from t)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
hits as (select r, wording, p - tp as diagonal, tp from (select r, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as gram from (select r, w, unnest(range(0, len(w) - 2)) as p from d)) join grams using (gram)),
voted as (select r, wording, diagonal, count(*) as n, min(tp) as a, max(tp) as b from hits group by 1, 2, 3),
phrases as (select r, label, diagonal as place, 1.0::double as covered from voted join t using (wording) where phrase and n = len(w) - 2),
edges as (select v.*, coalesce(diagonal - lag(diagonal) over (partition by r, wording order by diagonal) > {license_scan.GAP}, true) as opens from voted v join t using (wording) where not phrase),
spanned as (select *, sum(opens::int) over (partition by r, wording order by diagonal) as span from edges),
ends as (select r, wording, span, min(diagonal + a) as lo, max(diagonal + b + 2) as hi from spanned group by 1, 2, 3),
cover as (select r, wording, span, count(distinct tp + k) as words from hits join spanned using (r, wording, diagonal), range(3) x(k) group by 1, 2, 3),
notices as (select r, label, null::bigint as place, words / len(w)::double as covered from cover join ends using (r, wording, span) join t using (wording) where words >= {license_scan.COVERED} * len(w) and 2 * words >= hi - lo + 1),
found as (select r, count(place) as n_base, min(place) as first_word, max(place) as last_word, array_to_string(list_sort(list(distinct label) filter (place is not null)), ',') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(covered) as score from (select * from phrases union all select * from notices) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join found using (r)"""

#: Words one letter apart share what is left when the letter is taken from one of them, or from both at one place.
SPELLING = rf"""with recursive {CRC_TABLE}, runs as (
  select id, run, count(*) as c from (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents where text is not null) where length(run) >= 7 group by 1, 2
), coded as (select run, c, cast(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::bigint) as bigint[]) as bytes from runs),
summed as (select run, c, cast({CRC32} as bigint) as h from coded, crc),
words as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(c) as bigint) as n from summed group by 1 having length(word) >= 7 and sum(c) >= 2),
less as (select word, p, left(word, p - 1) || substr(word, p + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as p from words)),
pairs as (select w.word as a, l.word as b from words w join less l on l.rest = w.word union select l.word, w.word from words w join less l on l.rest = w.word union select x.word, y.word from less x join less y on x.rest = y.rest and x.p = y.p and x.word <> y.word),
ranked as (select a as word, b as other, n as other_n, count(*) over (partition by a) as n_near, row_number() over (partition by a order by n desc, b) as place from pairs join words on word = b),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n from words w left join ranked r on r.word = w.word and place = 1),
led as (select word, word as root, form as next from formed union all select l.word, l.next, f.form from led l join formed f on f.word = l.next)
select f.word, f.form, l.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from formed f join led l on l.word = f.word and l.next is null"""

ORACLE_SQL = {"op5_html_text": HTML_TEXT, "op7_repeats": REPEATS, "op8_sharding": SHARDING, "op11_conversation_repair": CONVERSATIONS, "op12_license_scan": LICENSES, "op13_spelling_variants": SPELLING}
