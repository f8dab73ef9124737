"""DuckDB SQL for the operators that SQL can express."""

UPPER, SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WORD = r"'[^\x20\x09-\x0D]+'"
BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRINGS = rf"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
win as (select doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from t)),
least_doc as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, p from (select w.doc_id, unnest(range(w.s, w.s + 13)) as p from win w join least_doc l on w.k = l.k where l.m < w.doc_id)),
pos as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from t),
kept as (select pos.doc_id, count(gone.p) as n_removed, coalesce(string_agg(word, ' ' order by pos.p) filter (where gone.p is null), '') as text
         from pos left join gone on pos.doc_id = gone.doc_id and pos.p = gone.p group by pos.doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from t left join kept on t.doc_id = kept.doc_id"""

LINES = rf"""
with x as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER}, {SMALL}) as key from x),
often as (select key, max(doc_id) as last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
d as (select k.*, often.key is not null and k.doc_id <> often.last_doc as dropped from k left join often on k.key = often.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from d group by doc_id"""

NGRAMS = rf"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {SMALL}), {WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + 2), ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as p from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(d, r) as (select doc_id, doc_id from documents union select both_ways.y, reach.r from reach join both_ways on both_ways.x = reach.d where both_ways.y > reach.r)
select t.doc_id, coalesce(n.n, 0) as n_shingles, min(reach.r) as component_id
from t left join n on t.doc_id = n.doc_id join reach on reach.d = t.doc_id group by t.doc_id, n.n"""

CONTAMINATION = rf"""
with b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {SMALL}), {BENCH_WORD}) as w from benchmark),
pat as (select distinct item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') as k
        from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0)),
t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {SMALL}), {BENCH_WORD}) as w from documents),
win as (select doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') as k
        from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s from t cross join (select distinct m from pat))),
found as (select win.doc_id, win.s, win.m, pat.item_id from win join pat on win.m = pat.m and win.k = pat.k),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id from found) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, n_hit is not null as contaminated
from t left join hits on t.doc_id = hits.doc_id left join items on t.doc_id = items.doc_id"""

COLLOCATIONS = rf"""
with p as (select doc_id, coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {UPPER}, {SMALL}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda s: array_to_string(list_slice(w, s, s + size - 1), ' '))) as phrase from w cross join (select unnest([1, 2, 3]) as size)),
f as (select lang, size, phrase, count(*) as n from g group by all),
total as (select lang, cast(sum(n) as bigint) as n from f where size = 1 group by lang),
c as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size > 1 and n >= 10),
cut as (select lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as x, array_to_string(list_slice(w, k + 1, size), ' ') as y from (select *, unnest(range(1, size)) as k from c)),
s as (select cut.lang, cut.phrase, a, k, fx.n as l, fy.n as r, cast((cast(1000000 as hugeint) * a * a) // (cast(fx.n as hugeint) * fy.n) as bigint) as score
      from cut join f fx on cut.lang = fx.lang and cut.x = fx.phrase join f fy on cut.lang = fy.lang and cut.y = fy.phrase),
worst as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) as phrase, a as held from c where size = 3),
kept as (select worst.* from worst left join (select lang, phrase, max(held) as held from inner_ group by all) i on worst.lang = i.lang and worst.phrase = i.phrase where i.held is null or 100 * i.held < 50 * a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, total.n, score
from kept join total on kept.lang = total.lang qualify rank <= 2000"""

ORACLES = {"op1_substring_dedup": SUBSTRINGS, "op2_line_dedup": LINES, "op8_ngram_join": NGRAMS, "op10_decontamination": CONTAMINATION, "op12_collocations": COLLOCATIONS}
