"""Expected results of text queries as SQL, over whole tables with unique ids."""

from __future__ import annotations

#: Only A to Z are lowered.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = rf"""
with docs as (
    select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), items as (
    select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), phrases as (
    select distinct item, size, list_slice(w, s, s + size - 1) as phrase
    from (select item, w, size, unnest(range(1, len(w) - size + 2)) as s
          from (select item, w, least(10, len(w)) as size from items where len(w) > 0))
), starts as (
    select doc_id, size, s, list_slice(w, s, s + size - 1) as phrase
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s
          from docs, (select distinct size from phrases) where len(w) >= size)
), met as (
    select doc_id, s, size, item from starts join phrases using (size, phrase)
), hit as (
    select doc_id, count(distinct k) as n_hit
    from (select doc_id, unnest(range(s, s + size)) as k from met) group by doc_id
), found as (
    select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from met group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hit using (doc_id) left join found using (doc_id)
"""

ORACLES["op4_substring_dedup"] = r"""
with docs as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), starts as (
    select doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) as phrase
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as s from docs where len(w) >= 35)
), gone as (
    select distinct doc_id, unnest(range(s, s + 35)) as k
    from starts join (select phrase from starts group by phrase having count(*) > 1) using (phrase)
), words as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from docs
), kept as (
    select doc_id, string_agg(word, ' ' order by k) as t, count(*) as n
    from words anti join gone using (doc_id, k) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

ORACLES["op9_suffix_dedup"] = r"""
with docs as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), starts as (
    select doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) as piece
    from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as s from docs where len(h) >= 200)
), later as (
    select doc_id, s from (
        select doc_id, s, row_number() over (partition by piece order by doc_id, s) as place from starts) where place > 1
), runs as (
    select doc_id, min(s) as a, max(s) + 100 as b from (
        select doc_id, s, sum(new) over (partition by doc_id order by s) as run from (
            select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 100 then 0 else 1 end as new from later))
    group by doc_id, run
), gaps as (
    select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before, lead(a) over (partition by doc_id order by a) as after
    from runs
), cut as (
    select doc_id, count(*) as n_spans, cast(sum(b - a) as bigint) as n_removed,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || case when after is null then substr(h, 2 * b + 1) else '' end, '' order by a) as rest
    from gaps join docs using (doc_id) group by doc_id
)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(rest, h))) as kept_sha256
from docs left join cut using (doc_id)
"""

ORACLES["op11_ranked_search"] = r"""
with words as (
    select doc, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as doc, doc_id, text from documents)
), postings as (
    select doc, doc_id, term, count(*) as tf from words group by all
), lengths as (
    select doc, sum(tf) as n from postings group by all
), totals as (
    select count(*) as docs, sum(n) as len from lengths
), wanted as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), weights as (
    select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
    from postings, totals group by term
), scored as (
    select item_id, doc, doc_id,
        cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) as bigint) as score
    from wanted join postings using (term) join weights using (term) join lengths using (doc), totals
    group by item_id, doc, doc_id
), ranked as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score
    from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
