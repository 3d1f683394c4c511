"""DuckDB SQL of the registered queries, written from the clean columns wherever the query parses rendered text."""

from __future__ import annotations

GOLD = """gold as (select o_orderkey as id, 'rs' || o_custkey as snp, o_orderstatus as chr, case when o_orderkey % 13 <> 0 then cast(o_custkey as double) end as bp,
    case when o_orderkey % 9 <> 0 then o_orderpriority end as ra1, o_totalprice as price from orders),
pred as (select id, snp, case when id % 5 = 0 then 'X' else chr end as chr, bp, ra1 from gold, (values (1), (2)) c(k) where price >= 60000 and (k = 1 or id % 11 = 0))"""

PRF = """round(case when tp + fp = 0 then 0 else tp::double / (tp + fp) end, 9) as precision, round(case when tp + fn = 0 then 0 else tp::double / (tp + fn) end, 9) as recall,
    round(case when tp = 0 then 0 else 2 * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)) end, 9) as f1"""

FIELDS = """pf as (select snp, 'chr' as field, chr as v, false as num from pred union all select snp, 'bp', cast(bp as varchar), true from pred union all select snp, 'ra1', ra1, false from pred),
gf as (select snp, 'chr' as field, chr as v, false as num from gold union all select snp, 'bp', cast(bp as varchar), true from gold union all select snp, 'ra1', ra1, false from gold),
b as (select snp, field, v, bool_or(num) as num, sum(p) as np, sum(g) as ng from (select *, 1 as p, 0 as g from pf union all select *, 0, 1 from gf) group by snp, field, v),
m as (select *, case when num and v is null then 0 else least(np, ng) end as tp from b)"""

HEADERS = """h as (select n_nationkey as table_id, c, name from (select n_nationkey, unnest([0, 1, 2, 3, 4, 5]) as c, unnest(['SNP', case when n_nationkey % 2 = 0 then 'P value' else 'P joint' end,
    case when n_nationkey % 3 = 0 then 'meta P' else 'Gene' end, 'OR (95% CI)', case when n_nationkey % 5 = 0 then 'β G' else 'HR' end, 'marker ' || n_name]) as name from nation))"""

# Which words in a header tell which role.
ROLE_WORDS = """w(role, word) as (values ('rs', 'snp (rs)'), ('rs', 'variant (rs)'), ('rs', 'snp all'), ('rs', 'rs-id'), ('rs', 'rsid'), ('rs', 'snp'), ('rs', 'marker'), ('location', 'location and base pair change'), ('location', 'chr:position'),
    ('chr', 'chr:position'), ('chr', 'chr'), ('chr', 'chromosome'), ('bp', 'position'), ('bp', 'bp'), ('bp', 'base pair'), ('bp', 'pos'), ('locus', 'nearest gene'), ('locus', 'closest gene'), ('locus', 'nearestgene'), ('locus', 'locusname'), ('locus', 'locus name'), ('locus', 'gene'),
    ('maf', 'eaf'), ('maf', 'maf'), ('maf', 'af'), ('cohort', 'cohort'), ('cohort', 'consortium'), ('cohort', 'study'), ('cohort', 'dataset'), ('cohort', 'sample set'), ('imputation', 'imputation'), ('imputation', 'reference panel'), ('imputation', 'panel'),
    ('population', 'population'), ('population', 'ancestry'), ('population', 'ethnicity'), ('sample_size', 'sample size'), ('sample_size', 'total n'), ('sample_size', 'n='), ('sample_size', 'participants'), ('sample_size', 'subjects'), ('ea_oa', 'ea/oa'), ('ea_oa', 'ea / oa'), ('ea_oa', 'effect allele/other allele'),
    ('a1a2maf', 'a1/a2'), ('a1a2maf', 'a1/a2 a (maf)'), ('a1a2maf', 'a1/a2a (maf)'), ('major_minor', 'major/ minor alleles'), ('major_minor', 'major/minor'), ('major_minor', 'alleles'), ('major_minor', 'allele'), ('ci', '95'), ('ci', 'ci'), ('interaction', 'interaction'), ('interaction', 'snp x'), ('interaction', 'snp*'))"""

FAULTY = """f as (select o_orderkey, case when o_orderkey % 10 = 0 then '' when o_orderkey % 10 = 1 then 'gene' else 'rs' || o_orderkey end as snp, case when o_orderkey % 7 = 0 then '2' else '1e-5' end as p,
    case when o_orderkey % 3 = 0 then '23' else 'X' end as chr, case when o_orderkey % 4 = 0 then 'NR' else 'A' end as ra from orders),
v as (select *, case when o_orderkey % 10 in (0, 1) or o_orderkey % 7 = 0 then 'failed' else 'warning' end as row_status from f)"""

DIAGNOSIS = f"""{GOLD},
p2 as (select id, case when id % 17 = 0 then 'rs0' else snp end as snp, chr, ra1 from pred),
g2 as (select id, snp, chr, ra1 from gold),
pn as (select *, row_number() over (partition by snp, chr, ra1 order by id) as n from p2),
gn as (select *, row_number() over (partition by snp, chr, ra1 order by id) as n from g2),
gc as (select snp, chr, ra1, count(*) as c from g2 group by all),
pc as (select snp, chr, ra1, count(*) as c from p2 group by all),
pu as (select pn.* from pn left join gc on pn.snp = gc.snp and pn.chr = gc.chr and pn.ra1 is not distinct from gc.ra1 where n > coalesce(c, 0)),
gu as (select gn.* from gn left join pc on gn.snp = pc.snp and gn.chr = pc.chr and gn.ra1 is not distinct from pc.ra1 where n > coalesce(c, 0)),
why as (select pu.*, exists (select 1 from g2 where g2.snp = pu.snp) as known, exists (select 1 from g2 where g2.snp = pu.snp and g2.chr = pu.chr) as chr_ok,
        exists (select 1 from g2 where g2.snp = pu.snp and g2.ra1 is not distinct from pu.ra1) as ra1_ok from pu),
d as (select 'pred_unmatched' as type, case when not known then 'snp_not_in_gold' when chr_ok and ra1_ok then 'key_mismatch' else concat_ws('|', case when not chr_ok then 'chr_mismatch' end, case when not ra1_ok then 'ra1_mismatch' end) end as reason,
             id, snp, chr, ra1 from why
      union all select 'gold_unmatched', 'missing_in_prediction', id, snp, chr, ra1 from gu)"""

SUPPLIER = "sc as (select s_nationkey as table_id, s_suppkey as row_idx, 0 as col_idx, s_name as value from supplier union all select s_nationkey, s_suppkey, 1, 'N/A' from supplier union all select s_nationkey, s_suppkey, 2, printf('%.2f', s_acctbal::double) from supplier)"

PUBLICATIONS = """pub as (select d.doc_id, 'On the ' || lang || case when quality = 1 then ' genetics' else '' end as title, case when toxic = 1 then 'Dementia' else 'none' end as abstract,
    case when d.doc_id % 4 = 0 then 'review' else 'article' end as type, case when d.doc_id % 3 = 0 then 'tau proteins' else lower(source) end as mesh from documents d left join labels l on d.doc_id = l.doc_id),
flags as (select doc_id, type = 'review' as stop, mesh = 'tau proteins' as m, abstract = 'Dementia' as t, contains(title, 'genetics') as g, mesh in ('src1', 'tau proteins') as o, mesh from pub),
rel as (select doc_id, cast(-4 * stop::int + 4 * m::int + 3 * t::int + 4 * g::int + o::int as int) as score,
    concat_ws(' | ', case when stop then 'excluded publication type' end, case when m then 'AD-related MeSH' end, case when t then 'AD keyword in title/abstract' end, case when g then 'genetics keyword in title/abstract' end,
              case when g then 'genetics keyword in title' end, case when o then 'profile mesh overlap: ' || mesh end) as reason from flags)"""

SQL = {
    "row_match_prf": f"""with {GOLD}, b as (select chr, snp, ra1, bp, sum(p) as np, sum(g) as ng from (select chr, snp, ra1, bp, 1 as p, 0 as g from pred union all select chr, snp, ra1, bp, 0, 1 from gold) group by all),
t as (select chr, sum(case when bp is null then 0 else least(np, ng) end) as tp, sum(np) as p, sum(ng) as g from b group by chr), u as (select chr, cast(tp as bigint) as tp, cast(p - tp as bigint) as fp, cast(g - tp as bigint) as fn from t)
select chr, tp, fp, fn, {PRF} from u""",
    "field_match_metrics": f"""with {GOLD}, {FIELDS}, u as (select field, cast(sum(tp) as bigint) as tp, cast(sum(np - tp) as bigint) as fp, cast(sum(ng - tp) as bigint) as fn from m group by field) select field, tp, fp, fn, {PRF} from u""",
    "pooled_field_metrics": f"""with {GOLD}, {FIELDS}, u as (select cast(sum(tp) as bigint) as tp, cast(sum(np - tp) as bigint) as fp, cast(sum(ng - tp) as bigint) as fn from m where v is not null) select tp, fp, fn, {PRF} from u""",
    "adaptive_keys": "select unnest(['snp', 'chr', 'bp', 'ra1']) as key, unnest([true, true, true, false]) as used",
    "bag_except_rows": "select l_suppkey, l_linenumber from lineitem where l_linestatus = 'O' except all select l_suppkey, l_linenumber from lineitem where l_linestatus = 'F'",
    "diagnose_unmatched": f"with {DIAGNOSIS} select * from d",
    "reason_counts": f"with {DIAGNOSIS} select reason, count(*) as n from d where type = 'pred_unmatched' group by reason",
    "scope_filter": """with r as (select event_id, user_id % 10 <> 0 as s, value > 1 as v, event_id % 4 = 0 as q, event_id % 6 = 0 as x from events)
select 'raw' as scope, count(*) as n, cast(sum(event_id) as bigint) as ids from r union all select 'like', count(*), cast(sum(event_id) as bigint) from r where s and v union all select 'primary', count(*), cast(sum(event_id) as bigint) from r where s and v and not q and not x""",
    "summary_rollup": """select case when grouping(o_orderpriority) = 1 then 'combined' else o_orderpriority end as source, count(*) as n_rows, count(*) filter (o_orderstatus = 'O') as n_open, count(*) filter (o_orderkey % 2 = 0) as n_even
from orders group by rollup (o_orderpriority)""",
    "set_equal": """with a as (select distinct l_returnflag, l_suppkey from lineitem where l_linenumber > 1), b as (select distinct l_returnflag, l_suppkey from lineitem where l_linenumber < 5),
k as (select l_returnflag, l_suppkey, max(x) as x, max(y) as y from (select *, 1 as x, 0 as y from a union all select *, 0, 1 from b) group by all)
select l_returnflag, count(*) filter (x = 0) as n_missing, count(*) filter (y = 0) as n_extra, count(*) filter (x = 0 or y = 0) = 0 as equal from k group by l_returnflag""",
    "per_key_counts": """select l_suppkey, count(*) filter (l_linestatus = 'O') as n_pred, count(*) filter (l_linestatus = 'F') as n_gold, count(*) filter (l_linestatus = 'O') = count(*) filter (l_linestatus = 'F') as equal
from lineitem group by l_suppkey having count(*) filter (l_linestatus = 'F') > 0""",
    "multiset_equal": """select distinct o_custkey, field, equal from (select o_custkey, 'o_orderpriority' as field, true as equal from orders union all
select o_custkey, 'o_orderstatus', count(*) filter (o_orderkey % 40 = 0) = 0 from orders group by o_custkey)""",
    "norm_identifiers": """select c_custkey, 'rs' || c_custkey as snp, cast(c_custkey % 22 as varchar) as chrom, array_to_string(list_sort(['b', lower(c_mktsegment)]), ';') as tokens, cast(c_custkey as varchar) as whole, upper(c_mktsegment) as allele,
case when c_custkey % 4 <> 0 then c_name end as named from customer""",
    "text_cells": """select p_partkey, case p_partkey % 5 when 0 then '' when 1 then '' when 2 then '-' when 3 then 'NR' else p_name end as cell, p_partkey % 5 <> 4 as looks_missing, p_partkey % 5 in (0, 1, 3) as missing,
'a ' || lower(p_brand) as normal, regexp_replace(regexp_replace('(' || p_brand || '): ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as file_name,
substr(p_brand || '_' || p_type || ' _long enough to be cut_', 1, 31) as sheet from part""",
    "footnote_strip": """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: case when len(w) > 1 then regexp_replace(w, '[a-z]$', '') else w end), ' ') as stripped, 'rs' || p_partkey || '/Gene' || p_size as top,
'APOE, ' || p_brand as locus from part""",
    "links_and_ids": """select c_custkey, 'PMC' || c_custkey as article, cast(c_custkey as int) as table_no, lpad(cast(c_custkey as varchar), 8, '1') as pmid, 'PMC' || c_custkey as pmcid, 2 as n_links, c_custkey % 3 = 0 as flag from customer""",
    "sci_number": """select l_orderkey, l_linenumber, l_suppkey, round(log10((round(l_discount * 100) + 1.5)::double) - (l_orderkey % 9 + 1), 9) as safe_log, round(log10((round(l_discount * 100) + 1.5)::double) - (l_orderkey % 9 + 1), 9) as norm_log,
-(l_orderkey % 9 + 1)::double as p_log, -(l_orderkey % 9 + 1)::double as signed, true as "none", true as no_number, round(log10((round(l_discount * 100) + 1)::double) - (l_orderkey % 9 + 1), 9) as large_x,
round(log10((round(l_discount * 100) + 1)::double) - (l_orderkey % 9 + 1), 9) as spaced_e from lineitem""",
    "effect_and_interval": """select l_orderkey, l_linenumber, l_suppkey, q + 0.25::double as effect, case when l_returnflag = 'A' then '(' || (q - 1) || '-' || (q + 1) || ')' else '' end as ci, round(l_discount::double, 4) as as_ratio,
cast('0.0' || q as double) as p, -(q + 0.5::double) as beta from (select *, cast(l_quantity as int) as q from lineitem)""",
    "alleles_and_positions": """select l_orderkey, l_linenumber, l_suppkey, l_linestatus as minor, l_returnflag as major, l_returnflag as a1, l_linestatus as a2, '0.198' as maf, cast(l_suppkey % 22 + 1 as varchar) as chrom, cast(l_orderkey as varchar) as pos,
(l_suppkey % 22 + 1) || '|' || l_orderkey || '|CT|A' as location from lineitem""",
    "cell_unpivot": f"with {SUPPLIER} select * from sc",
    "cell_pivot": "select s_nationkey as table_id, s_suppkey as row_idx, s_name as name, 'N/A' as empty, s_acctbal::double as balance from supplier",
    "drop_empty": "select s_nationkey as table_id, 2 * count(*) as n_cells, cast(2 as bigint) as n_columns, count(*) as n_rows from supplier group by all",
    "header_choice": """with k as (select *, row_number() over (partition by p_size order by p_partkey) as k from part),
s as (select p_size, k, case when k = 4 then 3 else len(regexp_extract_all(p_brand || ' ' || p_type || ' ' || p_partkey, '(?i)(snp|rsid|p\\s*-?value|beta|or|odds|chr|position|bp|allele|maf|ci)')) end as hits from k),
b as (select p_size, arg_max(k, (hits, -k)) as head from s where k <= 5 group by p_size)
select k.p_size as table_id, max(case when k.k = head then case when k.k = 4 then 'SNP (rsID)|P value|p VALUE_2' else p_brand || '|' || p_type || '|' || p_partkey end end) as names, 3 * count(*) filter (k.k > head) as n_cells
from k join b on k.p_size = b.p_size group by k.p_size""",
    "last_match_column": "select n_nationkey as table_id, 'marker ' || n_name as last_name, 'SNP' as first_name from nation",
    "pvalue_column_tier": "select n_nationkey as table_id, case when n_nationkey % 3 = 0 then 'meta P' when n_nationkey % 2 = 1 then 'P joint' else 'P value' end as name from nation",
    "effect_column": "select n_nationkey as table_id, case when n_nationkey % 5 = 0 then 'β G' else 'OR (95% CI)' end as name, case when n_nationkey % 5 = 0 then 'Beta' else 'OR' end as effect_type from nation",
    "column_roles": f"""with {HEADERS}, {ROLE_WORDS}, best as (select table_id, role, max(c) as c from h join w on contains(lower(name), word) group by all
union all select table_id, 'p', arg_max(c, (case name when 'meta P' then 9 when 'P joint' then 8 else 7 end, c)) from h where name in ('meta P', 'P joint', 'P value') group by all
union all select table_id, 'effect', arg_max(c, case name when 'β G' then 9 when 'OR (95% CI)' then 8 else 7 end) from h where name in ('β G', 'OR (95% CI)', 'HR') group by all)
select best.table_id, role, best.c as col_idx, name from best join h on best.table_id = h.table_id and best.c = h.c""",
    "subgroup_defs": """select n_nationkey as table_id, n_name || ' group' as label, 'effect' as metric, n_name || ' group | OR' as name from nation union all select n_nationkey, n_name || ' group', 'p', n_name || ' group | P' from nation
union all select n_nationkey, 'male', 'effect', 'male | OR' from nation""",
    "forward_fill": """select o_custkey, o_orderkey, last_value(case when o_orderkey % 3 = 0 then o_orderstatus end ignore nulls) over w as status, last_value(case when o_orderkey % 4 = 0 then o_orderpriority end ignore nulls) over w as priority
from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row)""",
    "table_score": """with f as (select page_id, page_id % 2 = 0 or page_id % 5 = 0 and false as g, page_id % 3 = 0 as p, page_id % 7 = 0 as e, page_id % 5 = 0 as n from pages),
s as (select *, g::int * 3 + p::int * 3 + e::int - n::int * 4 + (g and p)::int * 2 + (p and e)::int as sc from (select page_id, g or n as g, p, e, n from f))
select page_id, cast(sc as int) as score, concat_ws(';', case when g then 'gene-like keyword' end, case when p then 'p-value-like keyword' end, case when e then 'association-statistic keyword' end, case when n then 'gene-count summary table' end,
case when g and p then 'gene+p-value rule matched' end, case when p and e then 'association-table support' end) as reasons, sc >= 5 as selected from s""",
    "page_links": """with l as (select page_id, regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*href=["'']([^"''#]+)', 1) as x from pages) select page_id, cast(len(list_distinct(x)) as bigint) as n_links, coalesce(x[1], '') as first_link from l""",
    "html_grid": """with n as (select n_regionkey as page_id, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as r from nation)
select cast(page_id as bigint) as page_id, 0 as table_no, 't1' as html_id, cast(r as int) as row_idx, c as col_idx, case c when 0 then 'region' when 1 then cast(n_nationkey as varchar) else n_name || ' x' end as value from n, (values (0), (1), (2), (3)) v(c)""",
    "table_records": """with s as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as n, s_nationkey % 2 = 1 as odd, s_suppkey as k from supplier)
select s_nationkey as table_id, k as row_idx, case when odd then 0 else 10 end as layout, case when odd then 'GENE' || (k % 7) else 'rs' || k end as name, 'rs' || k as top_snp, case when odd then '3' else '19' end as chrom, 'GENE' || (k % 7) as locus,
round((k % 3) + 0.5::double, 6) as effect, '(0.1-9.9)' as ci, round((k % 4 + 1) - log10((k % 8 + 1)::double), 6) as log_p, 'OR' as effect_type, case when odd then 0.7::double else 0.55::double end as confidence from s""",
    "group_labels": "select n_nationkey as table_id, n_name || ' group' as label from nation",
    "pipe_headers": """select n_nationkey as table_id, 'S' as section, 'A a' as subgroup, 'p' as metric, 'S | A a | p' as name from nation union all select n_nationkey, n_name, 'B', 'or', n_name || ' | B | OR' from nation""",
    "subheader_merge": """with t as (select s_nationkey as table_id, count(*) as n from supplier group by all), h(c, even, odd) as (values (0, 'G1 SNP', 'G1'), (1, 'G1 P value', 'G1_2'), (2, 'G2 Beta', 'G2'))
select table_id, c as col_idx, case when table_id % 2 = 0 then even else odd end as name, cast(case when table_id % 2 = 0 then 3 * (n - 1) else 3 * n end as bigint) as n_cells from t, h""",
    "section_rows": "select s_nationkey as table_id, s_suppkey as row_idx, 'Group ' || s_name as label from supplier where s_suppkey % 3 = 0",
    "page_words": "select n_nationkey, n_name || chr(10) || 'a & b' || chr(10) || 'c < d' as text from nation",
    "text_sources": """select doc_id, case when doc_id % 2 = 0 then 'pdf' when doc_id % 3 = 0 then 'layout' else 'scan' end as source, cast(case when doc_id % 2 = 0 or doc_id % 3 = 0 then 621 else len(text) + 501 end as bigint) as n_chars from documents""",
    "audit_fields": "select count(*) as n from orders where o_orderkey % 4 = 0",
    "publication_records": """select cast(doc_id as varchar) as pmid, 'On ' || lang as title, 'AIM: ' || lang || '/' || source as abstract, 'Review;' || lang as types, source || ' / genetics; ' || lang || ';' || lang as mesh,
case when doc_id % 2 = 0 then '2019' else '2018' end as year from documents""",
    "curated_sheet": """select 'P1' as paper, 'T' || lpad(cast(s_nationkey as varchar), 5, '0') as tab, 'rs' || s_suppkey as top_snp, case when s_nationkey % 2 = 1 then '3' else '19' end as chrom, 'NR' as build, cast(47 as bigint) as n_columns from supplier""",
    "report_columns": f"with {DIAGNOSIS} select type, cast(null as varchar) as source_file, count(*) as n from d group by type",
    "keyword_rules": """select doc_id, case when contains(t, 'the') or contains(t, 'and') then 'first' when contains(t, 'der') or contains(t, 'die') then 'second' when contains(t, 'les') or contains(t, 'que') then 'third' else 'NR' end as label,
case when contains(t, 'the') or contains(t, 'and') or contains(t, 'der') or contains(t, 'die') or contains(t, 'les') or contains(t, 'que') then 0.7::double else 0.25::double end as confidence,
case lang when 'en' then 'European ancestry' when 'de' then 'Multi-ethnic' else 'NR' end as population, cast(n_chars + 1000 as varchar) as sample_size from (select *, lower(text) as t from documents)""",
    "stage_and_model": """with f as (select doc_id, doc_id % 2 = 0 as m, doc_id % 3 = 0 as c, doc_id % 5 = 0 as r, doc_id % 7 = 0 as h from documents)
select doc_id, case when m then 'Meta-analysis' when r then 'Replication/Validation' else 'NR' end as stage, case when c then 'cox regression (with covariates)' else 'NR' end as model, case when r and h then 'HRC;TOPMed' when r then 'TOPMed' when h then 'HRC' else 'NR' end as imputation,
case when h then 'Imaging' else 'NR' end as association from f""",
    "sectionize": """with d as (select doc_id, lang, source, cast(n_chars as varchar) as n from documents) select doc_id, 'methods' as section, 'A ' || lang as content from d union all select doc_id, 'results', 'B ' || source || chr(10) || 'C' from d
union all select doc_id, 'supplement', n from d union all select doc_id, 'all', concat_ws(chr(10), 'Intro', 'Intro', 'A ' || lang, 'B ' || source, 'C', n) from d""",
    "snippets": """with t as (select doc_id, text, lower(text) as l from documents),
x as (select doc_id, text, w, i, unnest(string_split(l, w)) as piece, generate_subscripts(string_split(l, w), 1) as k, len(string_split(l, w)) as pieces from t, (values ('@mail', 1), ('password', 2)) v(w, i)),
m as (select doc_id, text, w, i, k, pieces, cast(sum(len(piece) + len(w)) over (partition by doc_id, i order by k) as bigint) - len(w) as p from x),
s as (select doc_id, i, p, replace(substr(text, greatest(p - 240, 0) + 1, least(p, 240) + len(w) + 240), chr(10), ' ') as s from m where k < pieces),
d as (select *, row_number() over (partition by doc_id, substr(s, 1, 200) order by i, p) as nth from s),
r as (select *, row_number() over (partition by doc_id order by i, p) as k from d where nth = 1)
select documents.doc_id, cast(least(count(r.s), 8) as bigint) as n, coalesce(max(case when k = 1 then s end), '') as first from documents left join r on documents.doc_id = r.doc_id group by documents.doc_id""",
    "vocab_canonical": """select c_custkey, case when c_custkey % 2 = 0 then 'PENN;ADGC;IGAP;HRS' else 'PENN;HRS' end as cohort, case when c_custkey % 3 = 0 then 'HRC;1000G' else '1000G' end as panel, case when c_custkey % 2 = 0 then 'Meta' else 'Joint' end as kind,
'minor allele frequency of effect allele; hrcx' as expanded from customer""",
    "cohort_vote": """with t as (select doc_id, lower(text) as t from documents), v as (select doc_id, cohort, (len(t) - len(replace(t, w, ''))) // len(w) as n from t, (values ('A', 'the '), ('B', 'and '), ('C', ' les '), ('D', ' der ')) c(cohort, w)),
r as (select *, row_number() over (partition by doc_id order by n desc, cohort) as r, coalesce(lead(n) over (partition by doc_id order by n desc, cohort), 0) as second from v where n > 0)
select doc_id, cohort, cast(n as bigint) as n from r where r = 1 and n >= greatest(2, second + 1)""",
    "context_merge": """select o_orderkey, o_orderpriority as pmid, cast(o_orderkey % 3 as int) as table_idx, case when o_orderkey % 2 = 1 then 'own' when o_orderpriority = '1-URGENT' then case when o_orderkey % 3 = 2 then 'Asian' else 'European' end else 'NR' end as Population,
case when o_orderpriority = '2-HIGH' and o_orderkey % 3 = 1 then 'Amish' else 'NR' end as Cohort from orders""",
    "confidence_blend": """select l_orderkey, l_linenumber, round(0.4::double * l_discount + 0.4::double * least(l_tax, l_discount * 2) + 0.1::double, 9) as confidence, l_returnflag as kept, l_linestatus || chr(10) || '[Stage evidence] ' || l_returnflag || chr(10) || '[None evidence]' as evidence from lineitem""",
    "record_ids": "select o_orderpriority, o_orderkey, o_orderpriority || '_R' || lpad(cast(row_number() over (partition by o_orderpriority order by o_orderkey) as varchar), 5, '0') as RecordID from orders",
    "cell_validation": f"""with {FAULTY} select o_orderkey, row_status, case when o_orderkey % 10 in (0, 1) then 'issue' else 'ok' end as snp_status, case when o_orderkey % 7 = 0 then 'p-value is outside 0-1' else '' end as p_issues,
case when o_orderkey % 3 = 0 then 'review' else 'ok' end as chr_status from v""",
    "row_status_counts": f"with {FAULTY} select row_status, count(*) as n from v group by row_status",
    "missing_fields": "select 'RA 1(Reported Allele 1)' as field, count(*) as n from orders where o_orderkey % 4 = 0 union all select 'TopSNP', count(*) from orders where o_orderkey % 10 = 0",
    "review_states": "select case l_linenumber when 2 then 'issue' when 3 then 'checked' when 4 then '' else 'review' end as state, count(*) as n from lineitem group by all",
    "keyword_profile": f"with {PUBLICATIONS} select mesh as term, count(*) as n from pub group by mesh having count(*) >= 2",
    "relevance_score": f"with {PUBLICATIONS} select doc_id, score, reason, score >= 4 as relevant from rel",
    "literature_summary": f"with {PUBLICATIONS} select count(*) as hits, count(*) filter (score >= 4) as relevant_hits from rel",
    "upsert_tracker": "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1",
    "bulk_tracker_action": """select 'complete' as status, '2024-01-02T03:04:05' as updated_at, count(*) as n from orders where o_custkey % 5 = 0 and o_custkey % 7 <> 0 having count(*) > 0
union all select o_orderstatus, null, count(*) from orders where o_custkey % 5 <> 0 and o_custkey % 7 <> 0 group by o_orderstatus""",
    "annotations_merge": "select case when conv_id % 6 = 0 then 'issue' end as status, case when conv_id % 6 = 0 then 'see' end as comment, count(*) as n from conversations group by all",
    "sheet_edits": "select n_nationkey as row_idx, 'name' as col, case when n_nationkey % 4 = 0 then null when n_nationkey % 2 = 0 then lower(n_name) else n_name end as value from nation",
    "json_props": "select cast(len(json_keys(props)) as bigint) as n_keys, event_type, count(*) as n from events group by all",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
