"""DuckDB SQL of more_queries, written from the published rules and the clean columns."""

from __future__ import annotations

from litgrid.plans.oracles import DIAGNOSIS, FAULTY, GOLD, PUBLICATIONS, ROLE_WORDS

SITE = "https://pmc.ncbi.nlm.nih.gov/articles/PMC"

#: Two papers of three have gold rows; source s1 has no ra1, and combined rows come once more. bp is ignored.
EVALUATED = f"""{GOLD},
g as (select cast(id % 3 as int) as paper, snp, chr, ra1, price::double as pvalue from gold where id % 3 < 2),
p0 as (select cast(id % 3 as int) as paper, snp, chr, case when id % 2 = 0 then ra1 end as ra1, case when price is not null then price::double end as pvalue, 's' || (id % 2) as source_file from (select pred.id, pred.snp, pred.chr, pred.ra1, gold.price from pred join gold using (id))),
p as (select * from p0 union all select paper, snp, chr, ra1, pvalue, 'combined_inputs' from p0),
gs as (select g.*, source_file from g, (select unnest(['s0', 's1', 'combined_inputs']) as source_file)),
-- s1 has no ra1 to match by
pk as (select paper, source_file, snp, chr, case when source_file = 's1' then '-' else ra1 end as k, ra1, pvalue from p),
gk as (select paper, source_file, snp, chr, case when source_file = 's1' then '-' else ra1 end as k, ra1, pvalue from gs)"""

SCORES = """round(case when tp + fp = 0 then 0 else tp::double / (tp + fp) end, 9) as {0}precision, round(case when tp + fn = 0 then 0 else tp::double / (tp + fn) end, 9) as {0}recall,
round(case when tp = 0 then 0 else 2 * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)) end, 9) as {0}f1"""

SUMMARY = f"""{EVALUATED},
b as (select paper, source_file, snp, chr, k, pvalue, sum(x) as np, sum(y) as ng from (select paper, source_file, snp, chr, k, pvalue, 1 as x, 0 as y from pk where paper < 2 union all select paper, source_file, snp, chr, k, pvalue, 0, 1 from gk) group by all),
t as (select paper, source_file, sum(least(np, ng)) as tp, sum(np) - sum(least(np, ng)) as fp, sum(ng) - sum(least(np, ng)) as fn, sum(ng) as ng from b group by all),
n as (select paper, source_file, count(*) as n from p group by all),
summary as (select n.paper, n.source_file, case when n.paper < 2 then 'evaluated' else 'not_in_gold' end as status, case when n.paper > 1 then '' when n.source_file = 's1' then 'snp,chr,pvalue' else 'snp,chr,ra1,pvalue' end as key_cols, n.n as n_pred_rows, cast(coalesce(t.ng, 0) as bigint) as n_gold_rows,
    case when n.paper < 2 then round(tp / (tp + fp), 9) end as row_precision, case when n.paper < 2 then round(tp / (tp + fn), 9) end as row_recall, case when n.paper < 2 then round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) end as row_f1
  from n left join t on n.paper = t.paper and n.source_file = t.source_file)"""

FIELD_ROWS = """f as (select paper, source_file, snp, chr, k, pvalue, field, v, sum(x) as np, sum(y) as ng from (
  select paper, source_file, snp, chr, k, pvalue, unnest(['pvalue', 'chr', 'ra1']) as field, unnest([cast(pvalue as varchar), chr, ra1]) as v, 1 as x, 0 as y from pk where paper < 2
  union all select paper, source_file, snp, chr, k, pvalue, unnest(['pvalue', 'chr', 'ra1']), unnest([cast(pvalue as varchar), chr, ra1]), 0, 1 from gk) group by all)"""


def canonical(chr_text: str, effect: str, match: str, cohort: str, bp: bool = True) -> str:
    p = "case when k % 3 = 0 then (k % 7 + 1) * pow(10::double, -(k % 5 + 1)) else (k % 7 + 1) / 100.0::double end"
    return f"""with o as (select o_orderkey as k, * from orders) select printf('%.8e', 77.0::double) as pmid, 'rs' || k as snp, cast(k % 22 + 1 as varchar) as chr, printf('%.8e', k::double) as bp, case when k % 6 <> 0 then o_orderstatus end as ra1, printf('%.8e', {p}) as pvalue,
printf('%.8e', {effect}::double) as effect, '{cohort}' as cohort, case when k % 4 <> 0 then 'a;b' end as population, printf('%.8e', o_custkey::double) as sample_size, lower(o_orderpriority) as analysis_group, cast(null as varchar) as locus_name, cast(null as varchar) as phenotype, cast(null as varchar) as phenotype_derived,
printf('%.8e', {match}::double) as effect_match from o"""


LAYOUTS = [
    "select 1 as kind, unnest([0, 1, 2]) as sub_no, unnest(['rs' || k, 'rs9' || k, 'rs9' || k]) as top_snp, unnest(['ADGC', 'ADGC', 'ADSP']) as grp, unnest([1.5, 1.25, 1.75]) as effect, unnest([0.5, 0.4, 0.3]) as p, 'OR' as effect_type, 0.8 as confidence, '||||G1|||||' || unnest(['IGAP SNP ADGC P-value', 'Exonic SNP ADGC P-value', 'Exonic SNP ADSP P-value']) as rest, * from s where kind0 = 0",
    "select 2, 0, 'rs' || k, 'All', 2.0, 0.25, 'HR', 0.8, '|||||(1.5, 2.5)|' || k || '|A+B|all|', * from s where kind0 = 1",
    "select 3, 0, 'rs' || k, 'carriers', 1.5, 0.5, 'HR', 0.82, '2|' || k || '|G|A|BIN1|(1.1, 1.9)|10/20|||', * from s where kind0 = 2",
    "select 4, unnest([0, 1]), 'rs' || k, unnest(['APOE*4+', 'APOE*4-']), unnest([1.5, 0.75]), unnest([0.5, 0.25]), 'OR', 0.8, '1|' || k || '|A||CR1|||||', * from s where kind0 = 3",
    "select 5, i, 'rs' || k, ['AD status', 'NP', 'NFT', 'CAA', 'NP + NFT', 'NP + CAA', 'NFT + CAA'][i + 1], case when i < 4 then 0.5 end, 0.25, case when i < 4 then 'Beta' else 'NR' end, 0.82, '1||A|G|CR1|||||' || case when i < 4 then 'Univariate ' else 'Joint ' end || ['AD status', 'NP', 'NFT', 'CAA', 'NP + NFT', 'NP + CAA', 'NFT + CAA'][i + 1] || ' P-value', * exclude (i) from (select *, unnest([0, 1, 2, 3, 4, 5, 6]) as i from s where kind0 = 4)",
    "select 6, unnest([0, 1]), 'rs' || k || ' x rs2', unnest(['one', 'two']), 2.5, unnest([0.5, 0.25]), 'OR', 0.8, '||||A, B|(1.1-3.1)||||', * from s where kind0 = 5",
    "select 7, 0, 'rs' || k, 'Memory | ADNI', 0.125, 0.5, 'Beta', 0.8, '3|' || k || '|A|G|CLU|||ADNI||', * from s where kind0 = 6",
    "select 8, unnest([0, 1]), 'rs' || k, unnest(['eQTL association', 'AD association']), unnest([0.5, null]), unnest([0.25, 0.125]), unnest(['Beta', 'NR']), 0.78, '||||CR1L||||Probe set: ' || k || '; closest gene: CR1|' || unnest(['eQTL association P-value', 'AD association P-value']), * from s where kind0 = 7",
    "select 9, unnest([0, 1]), 'rs' || k, 'eQTL', unnest([0.25, -0.5]), unnest([0.5, 0.25]), 'Beta', 0.75, '||A|G|CLU||||eQTL comparison table|', * from s where kind0 = 8",
]

SQL = {
    "table_addresses": f"""select c_custkey, case when c_custkey % 2 = 1 then 'https://pmc.ncbi.nlm.nih.gov/articles/pmc' || c_custkey || '/table/T0' || c_custkey || '/' else '{SITE}' || c_custkey || '/table/a-tbl-' || c_custkey || '/' end as link,
case when c_custkey % 2 = 1 then 'T0' || c_custkey else 'a-tbl-' || c_custkey end as table_id, cast(c_custkey as int) as number, '{SITE}' || case when c_custkey % 2 = 1 then c_custkey || '/table/' || c_custkey || '/' else c_custkey || '/' end as page,
case when c_custkey % 2 = 1 then '{SITE}' || c_custkey || '/' else 'http://a/articles/PMC' || c_custkey end as article, c_custkey % 2 = 1 as special, cast(c_custkey as int) as id_number, cast(c_custkey as varchar) as sheet_pmid, cast(c_custkey as int) as sheet_number,
case when c_custkey % 2 = 1 then 'run' else 'a_b' end as tag, c_custkey % 2 = 1 as is_url, case when c_custkey % 2 = 1 then 'sPMC' || c_custkey || '/' else '' end as site, printf('%.1f%%', cast('0.' || lpad(cast(c_custkey as varchar), 5, '0') || '1' as double) * 100) as percent from customer""".replace("'sPMC'", "'s/PMC'"),
    "editor_values": """select l_orderkey, l_linenumber, l_suppkey, l_linenumber || case when l_orderkey % 2 = 0 then '.25' else '.25e-07' end as p, case when l_linenumber > 2 then l_returnflag else '' end as chr from lineitem""",
    "source_numbers": """with t as (select distinct o_custkey, o_orderkey from orders), n as (select *, row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as n from t)
select 'dir/table_' || o_custkey || '.xlsx' as path, o_orderkey as table_no, case when o_custkey % 2 = 0 then o_custkey || '_table77' else 'x' end as paper_id, cast(case when n > 1 then r when o_custkey % 2 = 0 then 77 else o_custkey end as int) as logical_no from n""",
    "header_levels": "select n_nationkey, case when n_nationkey % 2 = 0 then 'Group | P' else 'Group | ' || n_name || ' | P' end as name from nation",
    "publication_ids": """with t as (select doc_id, case when doc_id % 2 = 0 then 'See PMC99 and PMCID: PMC' || (doc_id + 10000) else 'No' end || case when doc_id % 3 = 0 then '; PubMed ' || (doc_id + 1000000) else '' end as b from documents)
select doc_id, case when doc_id % 2 = 0 then 'PMC' || (doc_id + 10000) else 'NR' end as pmcid, case when doc_id % 3 = 0 then cast(doc_id + 1000000 as varchar) else 'NR' end as pmid, case when doc_id % 2 = 0 or doc_id % 3 = 0 then b else '' end as evidence from t""",
    "paper_findings": """with t as (select doc_id, doc_id % 2 = 0 as a, doc_id % 3 = 0 as c, case when doc_id % 2 = 0 then 'A meta-analysis of Europeans, N = 5000. ' else 'Zzz. ' end || case when doc_id % 3 = 0 then 'Cox, with HRC.' else 'qqq' end as b from documents)
select doc_id, case when c then 'HRC|0.85|panel keyword detection (TOPMed/HRC/1000G)|' || b || '|false' when doc_id < 50 then 'TOPMed|0.60|paper metadata fallback|paper-level fallback metadata for PMID ' || doc_id || '|true' else 'NR|0.30|no imputation keywords found||true' end as imputation,
case when a then 'Meta-analysis|0.80|found meta-analysis cues|' || b || '|false' else 'NR|0.25|no stage cues found||true' end as stage, 'NR|0.25|no association cues found||true' as association,
case when c then 'cox regression|0.65|model family cues only|' || b || '|true' else 'NR|0.25|no model cues||true' end as model, case when a then 'European ancestry|0.75|section-aware population keyword|' || b || ' ' || b || '|true' else 'NR|0.25|no population cues found in methods/results/supplement||true' end as population,
case when a then '5000|0.70|section-aware sample size extraction|' || b || ' ' || b || '|true' else 'NR|0.25|no sample size cues found||true' end as sample_size from t""",
    "cohort_of_rows": """with t as (select c_custkey, c_custkey % 4 as r, c_custkey % 3 as b from customer)
select c_custkey, case when r = 0 then 'ADGC' when r = 1 then case b when 0 then 'ADNI' when 1 then 'HRS;ADNI' else 'ADNI' end else case b when 0 then 'ADNI' when 1 then 'HRS' else 'NR' end end as value,
case when r = 0 then 0.9::double when r = 1 then case b when 0 then 0.8 when 1 then 0.45 else 0.6 end else case b when 0 then 0.8 when 1 then 0.6 else 0.25 end end as confidence, not (r = 0 or b = 0) as review from t""",
    "validation_issues": f"""with {FAULTY},
w as (select *, o_orderkey % 2 = 0 as note, case when o_orderkey % 10 = 0 then 'TopSNP: missing required value' when o_orderkey % 10 = 1 then 'TopSNP: SNP does not look like an rsID' end as i1, case when o_orderkey % 7 = 0 then 'P-value: p-value is outside 0-1' end as i2, case when o_orderkey % 3 = 0 then 'Chr: chromosome format is unusual' end as i4,
  case when o_orderkey % 4 = 0 then 'RA 1(Reported Allele 1): missing value' end as i6 from v),
l as (select *, list_filter([i1, i2, 'EffectSize(altvsref): missing value', i4, 'BP(Position): missing value', i6, 'Cohort_simplified (no counts): missing value', 'Sample size: missing value', 'Imputation_simple2: missing value', 'Population_map: missing value', 'Analysis group: missing value', 'Phenotype: missing value', case when note then 'P-value: multiple p-value columns may need a note' end], lambda x: x is not null) as issues from w)
select cast(row_number() over (partition by o_orderkey % 50 order by o_orderkey) - 1 as int) as row_index, cast(o_orderkey as varchar) as record_id, row_status, array_to_string(issues[1:2], ';') as first_issues, cast(len(issues) as int) as n_issues, cast(len(issues) - case when note and i2 is not null then 1 else 0 end as int) as n_fields, issues[-1] as last_issue from l""",
    "gold_canonical": canonical("chr", "1.5", "1.5", "x"),
    "predicted_canonical": canonical("", "0.5", "case when k % 2 = 0 then 1.64872 else 0.5 end", "x;y"),
    "gold_papers": "select distinct cast(o_custkey as varchar) as pmid from orders where o_orderkey % 5 <> 0",
    "evaluation_summary": f"with {SUMMARY} select * from summary",
    "evaluation_fields": f"""with {EVALUATED}, {FIELD_ROWS}, t as (select paper, source_file, field, cast(sum(least(np, ng)) as bigint) as tp, cast(sum(np - least(np, ng)) as bigint) as fp, cast(sum(ng - least(np, ng)) as bigint) as fn from f where not (source_file = 's1' and field = 'ra1') group by all)
select paper, source_file, field, tp, fp, fn, {SCORES.format("")} from t""",
    "evaluation_sets": f"""with {EVALUATED}, {FIELD_ROWS}, t as (select paper, source_file, sum(least(np, ng)) as tp, sum(np - least(np, ng)) as fp, sum(ng - least(np, ng)) as fn from f where v is not null and field in ('pvalue', 'chr') group by all)
select paper, source_file, 'easy_fields' as metric_set, 'pvalue,effect,cohort,sample_size,analysis_group,population,chr' as fields, {SCORES.format("")} from t""",
    "evaluation_view": f"with {SUMMARY} select paper, source_file, status, n_pred_rows as pred_total, cast(case when paper < 2 then 4 else 1 end as int) as n_fields from summary where source_file = 'combined_inputs'",
    "golden_rows": """with o as (select o_orderkey as k, regexp_extract(cast(o_orderkey as varchar), '(\\d{2})$', 1) as p from orders) select cast(p as int) || '_PMC' || cast(p as int) as table_name, count(*) as n, cast(count(*) as int) as last, min('RS' || k || 'g') as first_snp, min(cast(k % 22 + 1 as varchar)) as first_chr
from o where p <> '' and cast(p as int) between 1 and 39 group by cast(p as int)""",
    "golden_names": """select c_custkey || case when c_custkey % 3 = 0 then '_PMC' else '_' end || c_custkey || case when c_custkey % 5 = 0 then '.txt' when c_custkey % 2 = 0 then '.csv' else '.xlsx' end as file_name,
case when c_custkey % 5 = 0 then 'not a .csv or .xlsx' when c_custkey % 3 <> 0 then 'not named pmid_pmcid' else 'not in the golden set' end as fault from customer where c_custkey % 5 = 0 or c_custkey % 3 <> 0 or c_custkey % 4 = 0""",
    "golden_columns": """select '3' as table_name, 'RA' as "column", min('rs' || o_custkey) as "SNP" from orders where o_orderkey % 10 = 3 and 'rs' || o_custkey > 'rs5' union all select '4', 'P-value', min('rs' || o_custkey) from orders where o_orderkey % 10 = 4 and 'rs' || o_custkey > 'rs3'""",
    "review_cells": """with o as (select o_orderkey as k, o_orderkey % 6 = 0 and o_orderkey % 4 <> 0 as noted from orders), c as (
select 'TopSNP' as col, case when noted then 'issue' when k % 10 = 0 then 'review' else '' end as status, case when noted then 'see' when k % 10 = 0 then 'missing value' else '' end as comment from o
union all select unnest(['P-value', 'Chr', 'Comment']), '', '' from o) select col, status, comment, count(*) as n from c group by all""",
    "review_rows": "select case when o_orderkey % 10 = 0 then 'review' else '' end as row_status, count(*) as n from orders group by all",
    "edited_sheet": "select 'Chr' as col, count(*) as n_null, count(*) as updated_rows from orders where o_orderkey % 8 = 1",
    "annotated_sheet": """select status, comment, count(*) as n from (select 'issue' as status, '' as comment from orders where o_orderkey % 4 = 0 union all select 'review', 'c' from orders where o_orderkey % 2 = 1 and o_orderkey % 3 <> 0) group by all""",
    "fix_list": f"with {DIAGNOSIS} select type, reason, '' as bp, '' as effect, 'f.csv' as source_mismatch_file, count(*) as n from d where type = 'pred_unmatched' group by all",
    "mismatch_counts": f"with {DIAGNOSIS} select 'missing_in_prediction' as reason, count(*) as count from d where type = 'gold_unmatched' union all select 'failed', count(*) from d where type = 'pred_unmatched'",
    "pred_total": f"with {EVALUATED} select count(*) as pred_total from p where source_file = 's0'",
    "latest_runs": "select 'd/from_' || o_custkey || '_table2_v1.xlsx' as path, cast(o_custkey as varchar) as pmid, 'e' || max(o_orderkey) as eval_report from orders group by o_custkey",
    "related_tables": """with p as (select distinct o_custkey as c, case when o_custkey % 5 = 0 then 'd/x' || o_custkey else 'd/from_' || o_custkey || '_table' || (o_orderkey % 3) || '_v1.xlsx' end as path from orders)
select path, cast(count(*) over (partition by c) as int) as n, min(path) over (partition by c) as first from p""",
    "run_views": """select 'e' || o_orderkey as eval_report, cast(2 as bigint) as table_count, cast(case when o_custkey % 3 = 0 then 0 else 6 end as bigint) as success_rows, cast(case when o_custkey % 3 = 0 then 7 else 0 end as bigint) as failed_rows, cast(case when o_custkey % 3 = 0 then 2 end as int) as n_reasons from orders""",
    "tracker_of_results": """select cast(o.k as varchar) as pmid, '' as pmcid, 'in_progress' as status, case when c_custkey is not null then 'high' else 'medium' end as priority, case when c_custkey is not null then 'm' else '' end as message, coalesce(c_name, '') as paper_title, cast(2 as bigint) as table_count
from (select distinct o_custkey as k from orders) o left join customer c on o.k = c_custkey and c_custkey % 2 = 0""",
    "issue_files": "select 'pmid_7_mismatch_' || unnest(['combined_inputs', '1', '2']) || '_raw.csv' as file_name",
    "table_listing": """with n as (select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey, n_name from nation)
select cast(n_regionkey as bigint) as page_id, string_agg(r || ': id=T' || n_nationkey || '; label=Table ' || n_nationkey || '; caption=' || n_name, ' | ' order by r) as text from n group by n_regionkey""",
    "article_table_links": f"""select page_id, '{SITE}' || page_id || '/table/T' || unnest([2, 1]) || '/' as link, 'T' || unnest([2, 1]) as table_id, cast(unnest([2, 1]) as int) as table_index from pages""",
    "table_types": "select n_nationkey as table_id, case n_nationkey % 4 when 0 then 'survival' when 1 then 'or_table' when 2 then 'beta_table' else 'unknown' end as kind from nation",
    "all_match_columns": """select n_nationkey as table_id, unnest([0, 1, 2, 3, 4]) as col_idx, unnest(['SNP', case when n_nationkey % 2 = 0 then 'Marker x' else 'OR' end, 'HR', 'β', 'N']) as name, unnest([true, n_nationkey % 2 = 0, false, false, false]) as hit, unnest(['NR', case when n_nationkey % 2 = 0 then 'NR' else 'OR' end, 'HR', 'Beta', 'NR']) as kind from nation""",
    "sheet_rows": "select 'f' || s_nationkey as path, cast(s_suppkey + 1 as int) as row_idx, s_name as \"TopSNP\", case when s_nationkey % 2 = 1 then 'X' end as \"Chr\" from supplier",
    "publication_list": f"""with {PUBLICATIONS} select cast(pub.doc_id as varchar) as pmid, '2020' as year, title, case when type = 'review' then 'Review' else 'Article' end as publication_types, case when pub.doc_id % 3 = 0 then 'Tau  proteins' else source end || '; b' as mesh_terms, 4 as score, true as is_alzheimers_relevant, 'r' as reason from pub join documents d on pub.doc_id = d.doc_id""",
    "layout_records": f"""with s as (select cast(s_nationkey as int) as table_id, cast(s_suppkey as int) as row_idx, s_suppkey as k, s_nationkey % 9 as kind0 from supplier), u as ({" union all ".join(LAYOUTS)})
select table_id, row_idx, cast(kind as int) as layout, cast(sub_no as int) as sub_no, top_snp, grp, effect::double as effect, p::double as p, effect_type, confidence::double as confidence, rest from u""",
    "subgroup_records": """with s as (select s_nationkey as table_id, s_suppkey as k, s_nationkey % 2 = 0 as e, unnest(['male group', 'female group']) as grp from supplier)
select table_id, cast(k + 1 as bigint) as row_idx, 'rs' || k as top_snp, grp, case when grp = 'male group' then 1.5::double else 1.25 end as effect, case when grp = 'male group' then '(1.1-1.9)' else '' end as ci, case when grp = 'male group' then 0.5::double else 0.25 end as p, 'OR' as effect_type,
case when e then 'C' else 'G' end as ra1, case when e then 'T' else 'A' end as ra2, case when e then '0.25' else '' end as maf from s where grp = 'male group' or k % 3 <> 0""",
    "sheet_opened": "select cast(n_nationkey as varchar) as n_nationkey, n_name, case when n_nationkey % 2 = 0 then 'c' else '' end as n_comment, cast(7 as bigint) as row_count from nation where n_nationkey < 7",
    "article_tables": """with p as (select page_id, page_id % 5 as k from pages), r(k, table_id, table_no, rule) as (values (0, 'T2', 1, 'id'), (1, 'x-T3', 2, 'label'), (2, 'Z9', 1, 'link'), (3, 'T2', 2, 'place'), (4, 'T7', 0, 'place'), (4, 'T7', 1, 'place'))
select page_id, table_id, cast(table_no as int) as table_no, rule from p join r using (k)""",
    "rule_roles": f"""with h as (select s_suppkey as table_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as c, unnest(['SNP', case when s_suppkey % 2 = 0 then 'P value' else 'P joint' end, case when s_suppkey % 3 = 0 then 'meta P' else 'Nearest Gene' end, 'OR (95% CI)',
    case when s_suppkey % 5 = 0 then 'β G' else 'HR' end, case when s_suppkey % 7 = 0 then 'Chr:Position' else 'BP' end, case when s_suppkey % 4 = 0 then 'A1/A2' else 'EA/OA' end, 'marker ' || s_name]) as name from supplier), {ROLE_WORDS},
best as (select table_id, role, max(c) as c from h join w on contains(lower(name), word) group by all
union all select table_id, 'p', case when table_id % 3 = 0 then 2 else 1 end from h group by all
union all select table_id, 'effect', case when table_id % 5 = 0 then 4 else 3 end from h group by all
union all select table_id, 'variant', case when table_id % 7 = 0 then 5 else 7 end from h group by all
union all select table_id, a, max(c) from h, (values ('a1'), ('a2')) v(a) where contains(lower(name), a) group by all
union all select table_id, 'numbered', min(c) from h where regexp_matches(name, '[0-9]') and not starts_with(name, 'marker') group by all)
select best.table_id, role, best.c as col_idx, name from best join h on best.table_id = h.table_id and best.c = h.c""",
    "filled_gaps": "select 0 as col_idx, lang as value, count(*) as n from documents group by lang union all select 1, source, count(*) from documents group by source",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
