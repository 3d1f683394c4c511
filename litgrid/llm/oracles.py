"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bw as (select distinct item_id, least(10, len(w)) as n, w[p : p + least(10, len(w)) - 1] as win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as p from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select r, p, n, w[p : p + n - 1] as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n)),
hit as (select r, p, bw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
pos as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hit) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join items using (r)
"""


OP8 = r"""
with m as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  substr(md5('mix-1' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 16) as h, coalesce('s' || source, 'n') as k from documents),
s as (select k, source, cast(sum(size) as bigint) as source_size from m group by all),
w as (select *, row_number() over (order by source nulls last) - 1 as place from s),
w2 as (select *, [3.0, 1.0, 2.0][place % 3 + 1]::double as weight, 2.0::double * source_size as cap from w),
w3 as (select *, cap / weight as ratio from w2),
w4 as (select *, 1.5::double * sum(source_size) over () as goal, sum(weight) over () as all_weight,
       sum(cap) over (order by ratio, place rows unbounded preceding) - cap as capped, sum(weight) over (order by ratio, place rows unbounded preceding) - weight as passed from w3),
l as (select arg_min((goal - capped) / (all_weight - passed), (ratio, place)) as level from w4 where (goal - capped) / (all_weight - passed) <= ratio),
t as (select k, source_size, coalesce(least(cap, level * weight), cap) as target from w4 left join l on true),
r as (select m.*, source_size, target, row_number() over (partition by m.k order by floor(sqrt(size)), h, doc_id, size) as rank,
             case when source_size > 0 then target / source_size else 0.0::double end as e,
             cast(('0x' || substr(md5('mix-1:' || m.k), 1, 7)) as bigint) / 268435456.0::double as u from m join t on m.k = t.k)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * (floor(rank * e + u) - floor((rank - 1) * e + u)) as bigint) as taken from r
"""


OP4 = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, array_to_string(w[p : p + 3], ' ') as x from (select r, w, unnest(range(1, greatest(len(w) - 2, 2))) as p from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as a, b.r as b, count(*) as i from s a join s b on a.x = b.x and a.r < b.r group by all),
links as (select a, b from pairs join n na on na.r = a join n nb on nb.r = b where 100 * i >= 85 * (na.n + nb.n - i)),
both_ways as (select a, b from links union all select b, a from links),
reach(r, t) as (select r, r from d union select reach.r, b from reach join both_ways on reach.t = both_ways.a)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(other.doc_id) as component_id
from d join reach on d.r = reach.r join d other on other.r = reach.t left join n on n.r = d.r group by d.r, d.doc_id
"""


OP11 = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select count(*) as n_all, cast(sum(len(w)) as bigint) as l_all from d where len(w) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
f as (select term, count(*) as df from t group by term),
b as (select i, item_id, unnest(w) as term from (select row_number() over () as i, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark)),
s as (select i, item_id, d.r, doc_id, cast(sum(cast(floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double)) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_all) // l_all)))) as bigint) as score
      from b join t using (term) join f using (term) join d on d.r = t.r, g group by all),
k as (select item_id, cast(row_number() over (partition by i order by score desc, doc_id nulls first) as integer) as rank, doc_id, score from s where score > 0)
select * from k where rank <= 20
"""


BASE_LM = rf"""
with t as (select doc_id, unnest(list_append(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), chr(10))) as w from documents),
c as (select w, count(*) as c from t where doc_id % 7 <> 2 group by w),
m as (select cast(sum(c) as bigint) as n, count(*) as v from c)
select doc_id, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1)::double / (n + v + 1))), 4) as base_score from t left join c using (w), m group by doc_id
"""


BASE_QUALITY = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d where len(w) > 2),
k as (select doc_id, p, count(*) over (partition by doc_id, w[p], w[p + 1], w[p + 2]) as n from p),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from k where n > 1) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
c as (select d.doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from d left join r on d.doc_id = r.doc_id left join l on d.doc_id = l.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""


BASE_SHARDING = """
select cast(40 as bigint) as n_shards, count(*) as n, cast(sum(coalesce(octet_length(encode(text)), 0) + 16) as bigint) as size, count(*) as slots, count(*) as distinct_slots, cast(0 as bigint) as texts_in_several from documents
"""


def oracle_sql() -> dict[str, str]:
    return {"base_of_lm_scoring": BASE_LM, "base_of_quality_rules": BASE_QUALITY, "base_of_sharding": BASE_SHARDING, "op11_lexical_search": OP11, "op4_jaccard_join": OP4, "op6_decontamination": OP6, "op8_mixing": OP8}
