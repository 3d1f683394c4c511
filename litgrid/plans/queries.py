"""Registered queries of the engine's own operators over the driver's tables.

The tables hold no result tables of papers, so messy cells are rendered from clean columns and parsed back, or operators run on columns of like
shape. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import numbers as num
from litgrid.functions import text as tx
from litgrid.operators import align, cells, context, enrich, extract, headers, literature, scoring
from litgrid.plans import rules
from litgrid.sources import html_tables, sheets


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores before costly expressions, where a file's row groups make fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- alignment -----------------------------------------------------------------------------------------------------------------------


def gold_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("rs"), F.col("o_custkey")).alias("snp"), F.col("o_orderstatus").alias("chr"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey").cast("double")).alias("bp"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("ra1"), F.col("o_totalprice").alias("price"))


def pred_orders(spark, sf_dir):
    """Gold rows as a weak extraction gives them: the cheapest are lost, every fifth status is wrong, every eleventh row comes twice."""
    g = gold_orders(spark, sf_dir).where("price >= 60000")
    g = g.withColumn("chr", F.when(F.col("id") % 5 == 0, F.lit("X")).otherwise(F.col("chr")))
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 11 == 0, 2).otherwise(1)))).drop("copy")


def row_match_prf(spark, sf_dir):
    p, r, f1 = "precision", "recall", "f1"
    out = align.row_match(pred_orders(spark, sf_dir), gold_orders(spark, sf_dir), ["snp", "ra1", "bp"], ["chr"])
    return out.select("chr", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in (p, r, f1)])


def field_match_metrics(spark, sf_dir):
    out = align.field_match(pred_orders(spark, sf_dir), gold_orders(spark, sf_dir), ["snp"], ["chr", "bp", "ra1"])
    return out.select("field", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def pooled_field_metrics(spark, sf_dir):
    out = align.pooled_match(pred_orders(spark, sf_dir), gold_orders(spark, sf_dir), ["snp"], ["chr", "bp", "ra1"])
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def adaptive_keys(spark, sf_dir):
    pred = pred_orders(spark, sf_dir).withColumn("ra1", F.lit(None).cast("string"))
    return align.adaptive_keys(pred, gold_orders(spark, sf_dir), ["snp", "chr", "bp", "ra1"])


def bag_except_rows(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_linestatus")
    return align.bag_except(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), ["l_suppkey", "l_linenumber"]).drop("copy")


def diagnose_unmatched(spark, sf_dir):
    keys = ["snp", "chr", "ra1"]
    pred = pred_orders(spark, sf_dir).withColumn("snp", F.when(F.col("id") % 17 == 0, F.lit("rs0")).otherwise(F.col("snp")))
    return align.diagnose(pred.select("id", *keys), gold_orders(spark, sf_dir).select("id", *keys), keys, "id")


def reason_counts(spark, sf_dir):
    return align.reason_counts(diagnose_unmatched(spark, sf_dir), "pred_unmatched")


def scope_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("snp"), F.when(F.col("value") > 1, F.col("value")).alias("pvalue"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 0, " eQTL").otherwise("")).alias("analysis_group"), F.when(F.col("event_id") % 6 == 0, "Gene Expression").alias("phenotype_derived"))
    per = [align.scoped(rows, s).select(F.lit(s).alias("scope"), "event_id") for s in ("raw", "like", "primary")]
    return per[0].unionByName(per[1]).unionByName(per[2]).groupBy("scope").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def summary_rollup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return align.summary_rollup(o, "o_orderpriority", {"n_rows": F.lit(1), "n_open": (F.col("o_orderstatus") == "O").cast("int"), "n_even": (F.col("o_orderkey") % 2 == 0).cast("int")})


def set_equal(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber")
    return align.sets_equal(li.where("l_linenumber > 1"), li.where("l_linenumber < 5"), "l_suppkey", "l_returnflag")


def per_key_counts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus")
    return align.counts_equal(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), "l_suppkey")


def multiset_equal(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 == 0, "?").otherwise(F.col("o_orderstatus")))
    return align.multisets_equal(changed, o, "o_custkey", ["o_orderstatus", "o_orderpriority"])


# --- scalars -------------------------------------------------------------------------------------------------------------------------


def norm_identifiers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        tx.norm_snp(F.concat(F.lit("  RS"), key, F.when(F.col("c_custkey") % 3 == 0, "g").otherwise(""))).alias("snp"),
        tx.norm_chr(F.concat(F.lit("Chr"), (F.col("c_custkey") % 22).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise(""))).alias("chrom"),
        tx.token_set(F.concat(F.lit("B/"), F.lower("c_mktsegment"), F.lit(", b |"), F.col("c_mktsegment"))).alias("tokens"),
        tx.integer_like(F.concat(key, F.lit(".0"))).alias("whole"),
        tx.allele(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("allele"),
        tx.to_str(F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))).alias("named"),
    )


def text_cells(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    messy = F.when(F.col("p_partkey") % 5 == 0, "N/A").when(F.col("p_partkey") % 5 == 1, " nan").when(F.col("p_partkey") % 5 == 2, "-").when(F.col("p_partkey") % 5 == 3, "NR").otherwise(F.concat(F.lit("\n"), F.col("p_name"), F.lit(" ")))
    return p.select("p_partkey", tx.cell(messy).alias("cell"), tx.looks_missing(messy).alias("looks_missing"), tx.is_missing_value(messy).alias("missing"), tx.normalize(F.concat(F.lit("  A \n"), F.col("p_brand"))).alias("normal"), tx.safe_name(F.concat(F.lit("("), F.col("p_brand"), F.lit("): "), F.col("p_type"))).alias("file_name"), tx.sheet_name(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(" [long enough to be cut]"))).alias("sheet"))


def footnote_strip(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.strip_footnote("p_name").alias("stripped"), tx.sanitize_topsnp(F.concat(F.lit("rs"), F.col("p_partkey"), F.lit("b/ Gene"), F.col("p_size"), F.lit("c"))).alias("top"), tx.sanitize_locus(F.concat(F.lit(" APOEb , ,"), F.col("p_brand"))).alias("locus"))


def links_and_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://x.example/articles/pmc"), key, F.lit("/table/T0"), key, F.lit("/"))
    return c.select("c_custkey", tx.article_id(url).alias("article"), tx.table_number(url).alias("table_no"), tx.pmid_of_sources(F.lit("paper.pdf"), F.concat(F.lit("a.csv, dir/"), F.lpad(key, 8, "1"), F.lit("_table1.xlsx"))).alias("pmid"), tx.pmcid(F.when(F.col("c_custkey") % 2 == 0, key).otherwise(F.concat(F.lit("pmc"), key))).alias("pmcid"), F.size(tx.links(F.concat(key, F.lit(",\n ,b")))).cast("int").alias("n_links"), tx.flag(F.when(F.col("c_custkey") % 3 == 0, " YES").otherwise("no")).alias("flag"))


def sci_number(spark, sf_dir):
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount"))
    digits, power = F.round(F.col("l_discount") * 100).cast("int") + 1, (F.col("l_orderkey") % 9 + 1).cast("int")
    shown = F.concat(digits, F.lit(".5 × 10"), F.when(F.col("l_orderkey") % 2 == 0, "^").otherwise(""), F.lit("−"), power)
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.log10(num.safe_float(shown)), 9).alias("safe_log"), F.round(F.log10(num.norm_num(shown)), 9).alias("norm_log"), F.round(F.log10(num.p_value(power.cast("string"), F.lit("-log10(P)"))), 9).alias("p_log"), num.norm_num(F.concat(F.lit("-"), power)).alias("signed"), num.safe_float(F.lit("n.s.")).isNull().alias("none"), num.safe_float(F.concat(F.lit("rs1101"), power)).isNull().alias("no_number"), F.round(F.log10(num.norm_num(F.concat(digits, F.lit(" X 10^-"), power))), 9).alias("large_x"), F.round(F.log10(num.norm_num(F.concat(digits, F.lit(" e-"), power))), 9).alias("spaced_e"))


def effect_and_interval(spark, sf_dir):
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_discount"))
    value, low, high = F.col("l_quantity").cast("int"), F.col("l_quantity").cast("int") - 1, F.col("l_quantity").cast("int") + 1
    shown = F.concat(value, F.lit(".25 ("), low, F.lit("–"), high, F.lit(")"))
    kind = F.when(F.col("l_returnflag") == "A", "OR").otherwise("Beta")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", num.effect_of(shown).alias("effect"), num.interval_of(shown, kind).alias("ci"), F.round(F.log(num.effect_for_match(F.col("l_discount"), F.lit("BETA"))), 4).alias("as_ratio"), num.p_of_pair(F.concat(F.lit("0.0"), value, F.lit(" (-"), value, F.lit(".5)"))).alias("p"), num.beta_of_pair(F.concat(F.lit("0.0"), value, F.lit(" (-"), value, F.lit(".5)"))).alias("beta"))


def alleles_and_positions(spark, sf_dir):
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"))
    pair = F.concat(F.col("l_returnflag"), F.lit(" / "), F.col("l_linestatus"))
    minor, major = num.minor_major(pair)
    a1, a2, maf = num.alleles_and_frequency(F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"), F.lit(" (0.198)")))
    chrom, pos = num.chromosome_position(F.concat(F.col("l_suppkey") % 22 + 1, F.lit(":"), F.col("l_orderkey")), F.lit(""))
    c, b, ra1, ra2 = num.location_alleles(F.concat(F.col("l_suppkey") % 22 + 1, F.lit(":"), F.col("l_orderkey"), F.lit("_a_CT")))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", minor.alias("minor"), major.alias("major"), a1.alias("a1"), a2.alias("a2"), maf.alias("maf"), chrom.alias("chrom"), pos.alias("pos"), F.concat_ws("|", c, b, ra1, ra2).alias("location"))


# --- tables as cells -----------------------------------------------------------------------------------------------------------------


def supplier_cells(spark, sf_dir):
    return cells.to_cells(read(spark, sf_dir, "supplier").withColumn("empty", F.lit("N/A")), "s_nationkey", "s_suppkey", ["s_name", "empty", "s_acctbal"])


def cell_unpivot(spark, sf_dir):
    c = supplier_cells(spark, sf_dir)
    # money as a number, which engines write in different ways
    return c.withColumn("value", F.when(F.col("col_idx") == 2, F.format_string("%.2f", F.col("value").try_cast("double"))).otherwise(F.col("value")))


def cell_pivot(spark, sf_dir):
    return cells.from_cells(supplier_cells(spark, sf_dir), ["name", "empty", "balance"]).withColumn("balance", F.col("balance").cast("double"))


def drop_empty(spark, sf_dir):
    return cells.drop_empty(supplier_cells(spark, sf_dir)).groupBy("table_id").agg(F.count("*").alias("n_cells"), F.count_distinct("col_idx").alias("n_columns"), F.count_distinct("row_idx").alias("n_rows"))


def part_cells(spark, sf_dir):
    """One table for each part size; the fourth part's row is made a header."""
    p = read(spark, sf_dir, "part").withColumn("k", F.row_number().over(cells.Window.partitionBy("p_size").orderBy("p_partkey")))
    head = F.col("k") == 4
    named = p.withColumns({"a": F.when(head, "SNP (rsID)").otherwise(F.col("p_brand")), "b": F.when(head, "P value").otherwise(F.col("p_type")), "c": F.when(head, "p VALUE").otherwise(F.col("p_partkey").cast("string"))})
    return cells.to_cells(named, "p_size", "k", ["a", "b", "c"])


def header_choice(spark, sf_dir):
    body, columns = cells.with_header(part_cells(spark, sf_dir))
    n = body.groupBy("table_id").agg(F.count("*").alias("n_cells"))
    names = columns.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "name"))), lambda x: x["name"]), "|").alias("names"))
    return names.join(n, "table_id", "left").select("table_id", "names", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"))


def header_columns(spark, sf_dir):
    """Six headers a customer nation, which differ by table."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    names = F.array(F.lit("SNP"), F.when(k % 2 == 0, "P value").otherwise("P joint"), F.when(k % 3 == 0, "meta P").otherwise("Gene"), F.lit("OR (95% CI)"), F.when(k % 5 == 0, "β G").otherwise("HR"), F.concat(F.lit("marker "), F.col("n_name")))
    return n.select(k.alias("table_id"), F.posexplode(names).alias("col_idx", "name"))


def last_match_column(spark, sf_dir):
    return headers.last_match(header_columns(spark, sf_dir), rules.ROLE_PATTERNS["rs"]).withColumnRenamed("name", "last_name").join(headers.first_match(header_columns(spark, sf_dir), rules.ROLE_PATTERNS["rs"]).withColumnRenamed("name", "first_name"), "table_id")


def pvalue_column_tier(spark, sf_dir):
    return headers.p_value_column(header_columns(spark, sf_dir))


def effect_column(spark, sf_dir):
    return headers.effect_column(header_columns(spark, sf_dir))


def column_roles(spark, sf_dir):
    return headers.roles(header_columns(spark, sf_dir))


def subgroup_defs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    names = F.array(F.concat(F.col("n_name"), F.lit(" group | OR")), F.concat(F.col("n_name"), F.lit(" group | P")), F.lit("male | OR"), F.lit("other | N"))
    return headers.subgroups(n.select(F.col("n_nationkey").alias("table_id"), F.posexplode(names).alias("col_idx", "name")))


def forward_fill(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("priority"))
    return cells.forward_fill(o, "o_custkey", "o_orderkey", ["status", "priority"])


def header_similarity(spark, sf_dir):
    return headers.map_to_prompts(header_columns(spark, sf_dir).select("name"))


def table_score(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    body = F.concat(F.when(F.col("page_id") % 2 == 0, "Gene ").otherwise(""), F.when(F.col("page_id") % 3 == 0, "P-value ").otherwise(""), F.when(F.col("page_id") % 5 == 0, "number of genes ").otherwise(""), F.when(F.col("page_id") % 7 == 0, "95% CI").otherwise("."))
    found = scoring.scored_tables(p.select("page_id", body.alias("text")))
    return found.select("page_id", "score", F.array_join("reasons", ";").alias("reasons"), "selected")


def page_links(spark, sf_dir):
    found = scoring.page_links(read(spark, sf_dir, "pages"))
    return found.select("page_id", F.size("links").cast("bigint").alias("n_links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"))


def html_grid(spark, sf_dir):
    """One HTML table for each region, its name spanning the rows of its nations."""
    n = read(spark, sf_dir, "nation")
    row = F.concat(F.lit("<td>"), F.col("n_nationkey"), F.lit("</td><td colspan='2'>"), F.col("n_name"), F.lit("&nbsp; x</td>"))
    body = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("rows"))
    page = F.concat(F.lit("<table id='t1'><tr><td rowspan="), F.size("rows"), F.lit(">region</td>"), F.array_join(F.transform("rows", lambda x: x["r"]), "</tr><tr>"), F.lit("</tr></table>"))
    return html_tables.html_cells(body.select(F.col("n_regionkey").alias("page_id"), page.alias("html"))).drop("label", "caption", "table_index")


def rendered_tables(spark, sf_dir):
    """Result tables of suppliers, one for each nation: even nations in the generic layout with merged cells, odd ones with section | subgroup | metric headers."""
    s = read(spark, sf_dir, "supplier")
    t, k, odd = F.col("s_nationkey").alias("table_id"), F.col("s_suppkey"), F.col("s_nationkey") % 2 == 1
    rs, gene = F.concat(F.lit("rs"), k), F.concat(F.lit("GENE"), k % 7)
    effect, p = F.concat(k % 3, F.lit(".5 (0.1-9.9)")), F.concat(k % 8 + 1, F.lit(" x 10^-"), k % 4 + 1)
    s = s.withColumn("first", F.row_number().over(cells.Window.partitionBy("s_nationkey").orderBy("s_suppkey")) == 1)
    generic = F.array(rs, F.when(F.col("first"), "19").otherwise(""), gene, effect, p)
    piped = F.array(rs, effect, p, gene, F.lit("3"))
    heads = F.when(odd, F.array(*[F.lit(h) for h in ("Exonic | A | SNP", "Exonic | A | OR", "Exonic | A | P", "Nearest gene", "Chr")])).otherwise(F.array(*[F.lit(h) for h in ("SNP", "Chr", "Gene", "OR (95% CI)", "P value")]))
    values = s.select(t, k.alias("row_idx"), F.posexplode(F.when(odd, piped).otherwise(generic)).alias("col_idx", "value"))
    columns = s.select("s_nationkey").distinct().select(t, F.posexplode(heads).alias("col_idx", "name"))
    return values, columns


def table_records(spark, sf_dir):
    found = extract.records(*rendered_tables(spark, sf_dir))
    return found.select("table_id", "row_idx", "layout", "name", "top_snp", "chrom", "locus", F.round("effect", 6).alias("effect"), "ci", F.round(-F.log10("p"), 6).alias("log_p"), "effect_type", "confidence")


def group_labels(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    names = F.array(F.lit("Group | P"), F.concat(F.col("n_name"), F.lit("  group | OR")), F.lit("SNP"))
    return headers.group_label(n.select(F.col("n_nationkey").alias("table_id"), F.posexplode(names).alias("col_idx", "name")))


def pipe_headers(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    names = F.array(F.lit("S | A a | P"), F.concat(F.lit("S | A a | "), F.lit("p")), F.concat(F.col("n_name"), F.lit(" | B | OR")), F.lit("x | y"))
    return headers.pipe_columns(n.select(F.col("n_nationkey").alias("table_id"), F.posexplode(names).alias("col_idx", "name")))


def subheader_merge(spark, sf_dir):
    """One table for each nation with a second header level in its first row; odd ones without."""
    s = read(spark, sf_dir, "supplier")
    n = F.row_number().over(cells.Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = s.withColumn("sub", (n == 1) & (F.col("s_nationkey") % 2 == 0))
    shown = s.withColumns({"a": F.when(F.col("sub"), "SNP").otherwise("x"), "b": F.when(F.col("sub"), "P value").otherwise("y"), "c": F.when(F.col("sub"), "Beta").otherwise("z")})
    columns = s.select("s_nationkey").distinct().select(F.col("s_nationkey").alias("table_id"), F.posexplode(F.array(F.lit("G1"), F.lit("G1"), F.lit("G2"))).alias("col_idx", "name"))
    body, named = cells.merge_subheader(cells.to_cells(shown, "s_nationkey", "s_suppkey", ["a", "b", "c"]), columns)
    counted = body.groupBy("table_id").agg(F.count("*").alias("n_cells"))
    return named.join(counted, "table_id", "left").select("table_id", "col_idx", "name", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"))


def section_rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    label = F.concat(F.lit("Group "), F.col("s_name"))
    third = F.col("s_suppkey") % 3 == 0
    shown = s.withColumns({"a": F.when(third, label).otherwise(F.concat(F.lit("rs"), F.col("s_suppkey"))), "b": F.when(third, label).otherwise("x"), "c": F.when(third, "").otherwise("y")})
    return cells.section_rows(cells.to_cells(shown, "s_nationkey", "s_suppkey", ["a", "b", "c"]), "phenotype|trait")


def page_words(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    html = F.concat(F.lit("<html><style>p {}</style><script>var x = '<p>';</script><h1>"), F.col("n_name"), F.lit("</h1><p>a&nbsp;&amp; <b>b</b></p>\n\n<p>c &lt; d</p></html>"))
    return html_tables.page_text(n.select("n_nationkey", html.alias("html"))).select("n_nationkey", "text")


def text_sources(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    signal = F.concat(F.lit("Methods and results. "), F.repeat(F.lit("word "), 120))
    body, source = context.text_with_fallback(F.when(F.col("doc_id") % 2 == 0, signal).otherwise(F.col("text")), ("layout", F.when(F.col("doc_id") % 3 == 0, signal)), ("scan", F.concat(F.col("text"), F.repeat(F.lit("x"), 501))))
    return d.select("doc_id", source.alias("source"), F.length(body).cast("bigint").alias("n_chars"))


def audit_fields(spark, sf_dir):
    f = faulty(spark, sf_dir)
    fields = {"TopSNP": (F.col("TopSNP"), F.lit(0.5), "row"), "RA 1": (F.col("`RA 1(Reported Allele 1)`"), F.lit(0.4), "row")}
    return enrich.review_count(f.select(enrich.audit(fields).alias("audit")))


def publication_records(spark, sf_dir):
    """Publication XML rendered from documents and read back."""
    d = read(spark, sf_dir, "documents")
    tag = lambda t, c, a="": F.concat(F.lit(f"<{t}{a}>"), c, F.lit(f"</{t}>"))
    lang, key = F.col("lang"), F.col("doc_id").cast("string")
    article = F.concat(tag("ArticleTitle", F.concat(F.lit("On <i>"), lang, F.lit("</i>"))), tag("Abstract", F.concat(tag("AbstractText", lang, ' Label="AIM"'), tag("AbstractText", F.col("source")))), tag("PublicationTypeList", F.concat(tag("PublicationType", F.lit("Review")), tag("PublicationType", lang), tag("PublicationType", F.lit("Review")))), tag("Journal", tag("JournalIssue", tag("PubDate", F.when(F.col("doc_id") % 2 == 0, tag("Year", F.lit("2019"))).otherwise(tag("MedlineDate", F.lit("2018 Jan")))))))
    mesh = tag("MeshHeadingList", F.concat(tag("MeshHeading", F.concat(tag("DescriptorName", F.col("source")), tag("QualifierName", F.lit("genetics")), tag("QualifierName", lang))), tag("MeshHeading", tag("DescriptorName", lang))))
    xml = tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", key), tag("Article", article), mesh)))
    found = sheets.publications(d.select(xml.alias("xml")))
    return found.select("pmid", "title", F.replace("abstract", F.lit("\n"), F.lit("/")).alias("abstract"), F.array_join("publication_types", ";").alias("types"), F.array_join("mesh_terms", ";").alias("mesh"), "year")


def curated_sheet(spark, sf_dir):
    """The fixed sheet of rendered tables: filled and NR columns."""
    sheet = extract.curated(extract.records(*rendered_tables(spark, sf_dir)), "P1")
    return sheet.select(F.col("PaperIDX").alias("paper"), F.col("TableIDX").alias("tab"), F.col("TopSNP").alias("top_snp"), F.col("Chr").alias("chrom"), F.col("`Genome build (hg18/hg37/hg38)`").alias("build"), F.lit(len(sheet.columns)).cast("bigint").alias("n_columns"))


def report_columns(spark, sf_dir):
    rows = diagnose_unmatched(spark, sf_dir)
    return align.with_report_columns(rows.drop("id"), ["type", "reason", "source_file", "snp"]).groupBy("type", "source_file").agg(F.count("*").alias("n"))


# --- text context --------------------------------------------------------------------------------------------------------------------


def keyword_rules(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    words = {"first": ["the", "and"], "second": ["der", "die"], "third": ["les", "que"]}
    label = context.first_label(tx.normalize("text"), words, 0.7, 0.25, "tokens")
    pop = context.population(F.concat(F.col("lang"), F.when(F.col("lang") == "en", " Europeans and Asians").when(F.col("lang") == "de", " trans-ethnic").otherwise("")))
    size = context.sample_size(F.concat(F.lit("N = "), F.col("n_chars") + 1000, F.lit(" of 12 participants")))
    return d.select("doc_id", label["value"].alias("label"), label["confidence"].alias("confidence"), pop["value"].alias("population"), size["value"].alias("sample_size"))


def stage_and_model(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "A meta-analysis. ").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "Cox model, adjusted. ").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "Replication with TOPMed. ").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "HRC panel; MRI. ").otherwise("zzz")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", context.stage(t)["value"].alias("stage"), context.model_type(t)["value"].alias("model"), context.imputation(t)["value"].alias("imputation"), context.association_type(t)["value"].alias("association"))


def sectionize(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    body = F.concat(F.lit("Intro\nMETHODS \nA "), F.col("lang"), F.lit("\n\nResults\nB "), F.col("source"), F.lit("\nC\nAppendix\n"), F.col("n_chars"))
    return context.sections(d.select("doc_id", body.alias("text")))


def snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    found = context.snippets(F.col("text"), ["@mail", "password"])
    return d.select("doc_id", F.size(found).cast("bigint").alias("n"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"))


def vocab_canonical(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    listed = F.concat(F.lit("the Penn group; "), F.when(F.col("c_custkey") % 2 == 0, "adgc/IGAP").otherwise("unknown"), F.lit(", hrs"))
    return c.select("c_custkey", tx.cohort_codes(listed).alias("cohort"), tx.imputation_codes(F.concat(F.lit("1000 Genomes"), F.when(F.col("c_custkey") % 3 == 0, " and HRC").otherwise(""))).alias("panel"), tx.meta_or_joint(F.when(F.col("c_custkey") % 2 == 0, "Meta-analysis").otherwise("joint x")).alias("kind"), tx.expand_abbreviations(F.lit("MAF of EA; hrcx")).alias("expanded"))


def cohort_vote(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return context.dominant(context.cohort_votes(d, {"the ": "A", "and ": "B", " les ": "C", " der ": "D"}))


def context_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pmid"), (F.col("o_orderkey") % 3).cast("int").alias("table_idx"), F.when(F.col("o_orderkey") % 2 == 0, "NR").otherwise("own").alias("Population"), F.lit("NR").alias("Cohort"))
    hints = spark.createDataFrame([("1-URGENT", None, "Population", "European"), ("1-URGENT", 2, "Population", "Asian"), ("2-HIGH", 1, "Cohort", "Amish")], "pmid string, table_idx int, field string, value string")
    return context.with_hints(o, hints, "pmid", "table_idx", ["Population", "Cohort"])


def confidence_blend(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(enrich.blended_confidence(F.col("l_discount"), [F.col("l_tax"), F.col("l_discount") * 2], F.lit(0.5)), 9).alias("confidence"), enrich.first_present(F.when(F.col("l_linenumber") == 1, "NR").otherwise(F.lit("")), F.col("l_returnflag")).alias("kept"), enrich.evidence(F.col("l_linestatus"), {"Stage": F.col("l_returnflag"), "None": F.lit("")}).alias("evidence"))


def record_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return enrich.record_ids(o, "o_orderpriority", ["o_orderkey"])


def faulty(spark, sf_dir):
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey"))
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.when(k % 10 == 0, "").when(k % 10 == 1, "gene").otherwise(F.concat(F.lit("rs"), k)).alias("TopSNP"), F.when(k % 7 == 0, "2").otherwise("1e-5").alias("P-value"), F.when(k % 3 == 0, "23").otherwise("X").alias("Chr"), F.when(k % 4 == 0, "NR").otherwise("A").alias("RA 1(Reported Allele 1)"))


def cell_validation(spark, sf_dir):
    v = enrich.validated(faulty(spark, sf_dir))
    return v.select("o_orderkey", "row_status", v["checks"]["TopSNP"]["status"].alias("snp_status"), F.array_join(v["checks"]["P-value"]["issues"], ",").alias("p_issues"), v["checks"]["Chr"]["status"].alias("chr_status"))


def row_status_counts(spark, sf_dir):
    return enrich.validation_summary(enrich.validated(faulty(spark, sf_dir)))


def missing_fields(spark, sf_dir):
    return enrich.missing_fields(faulty(spark, sf_dir), ["TopSNP", "P-value", "Chr", "RA 1(Reported Allele 1)"])


def review_states(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    states = F.array(F.when(F.col("l_linenumber") == 2, "issue").otherwise("review"), F.lit("resolved"))
    return li.groupBy(enrich.review_status(F.when(F.col("l_linenumber") == 3, F.array(F.lit("resolved"))).when(F.col("l_linenumber") == 4, F.array(F.lit(""))).otherwise(states)).alias("state")).agg(F.count("*").alias("n"))


# --- literature, tracking ------------------------------------------------------------------------------------------------------------


def publications(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.concat(F.lit("On the "), F.col("lang"), F.when(F.col("quality") == 1, " genetics").otherwise("")).alias("title"), F.when(F.col("toxic") == 1, "Dementia").otherwise("none").alias("abstract"), F.array(F.when(F.col("doc_id") % 4 == 0, "Review").otherwise("Article")).alias("types"), F.array(F.when(F.col("doc_id") % 3 == 0, "Tau  proteins").otherwise(F.col("source"))).alias("mesh"))


def keyword_profile(spark, sf_dir):
    return literature.profile(publications(spark, sf_dir), "mesh", "doc_id").select("term", "n")


def relevance_score(spark, sf_dir):
    p = publications(spark, sf_dir)
    score, reason = literature.relevance(F.col("title"), F.col("abstract"), F.col("types"), F.col("mesh"), F.array(F.lit("src1"), F.lit("tau proteins")))
    return literature.ranked(p.select("doc_id", score.alias("score"), reason.alias("reason")), "doc_id")


def literature_summary(spark, sf_dir):
    return literature.summary(relevance_score(spark, sf_dir))


def upsert_tracker(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return enrich.upsert(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id"], "turn")


def bulk_tracker_action(spark, sf_dir):
    """Two actions that do nothing (a status and an action that there are not), a move by padded keys, and a deletion."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    same = enrich.bulk_action(enrich.bulk_action(o, o.where("o_custkey % 3 = 0"), "o_custkey", "move", "done"), o, "o_custkey", "archive", "new")
    padded = o.where("o_custkey % 5 = 0").select(F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("o_custkey")).unionByName(spark.createDataFrame([(" ",)], "o_custkey string"))
    moved = enrich.bulk_action(same, padded, "o_custkey", "move", "complete", "2024-01-02T03:04:05")
    left = enrich.bulk_action(moved, o.where("o_custkey % 7 = 0"), "o_custkey", "delete")
    return left.groupBy("status", "updated_at").agg(F.count("*").alias("n"))


def annotations_merge(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_idx"), F.col("turn").cast("string").alias("col"), F.col("role").alias("value"))
    notes = c.where("row_idx % 3 = 0").select("row_idx", "col", F.lit("issue").alias("status"), F.lit("see").alias("comment"), F.when(F.col("row_idx") % 2 == 0, "v1").otherwise("v0").alias("fingerprint"))
    return enrich.with_annotations(c, notes, F.lit("v1")).groupBy("status", "comment").agg(F.count("*").alias("n"))


def sheet_edits(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_idx"), F.lit("name").alias("col"), F.col("n_name").alias("value"))
    edits = n.where("row_idx % 2 = 0").select("row_idx", "col", F.when(F.col("row_idx") % 4 == 0, " ").otherwise(F.lower("value")).alias("value"))
    return enrich.with_edits(n, edits)


def json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"), "event_type").agg(F.count("*").alias("n"))


QUERIES = (
    row_match_prf, field_match_metrics, pooled_field_metrics, adaptive_keys, bag_except_rows, diagnose_unmatched, reason_counts, scope_filter, summary_rollup, set_equal, per_key_counts, multiset_equal,
    norm_identifiers, text_cells, footnote_strip, links_and_ids, sci_number, effect_and_interval, alleles_and_positions,
    cell_unpivot, cell_pivot, drop_empty, header_choice, last_match_column, pvalue_column_tier, effect_column, column_roles, subgroup_defs, forward_fill, header_similarity, table_score, page_links, html_grid, table_records, group_labels, pipe_headers, subheader_merge, section_rows, page_words, text_sources, audit_fields, publication_records, curated_sheet, report_columns,
    keyword_rules, stage_and_model, sectionize, snippets, vocab_canonical, cohort_vote, context_merge, confidence_blend, record_ids, cell_validation, row_status_counts, missing_fields, review_states,
    keyword_profile, relevance_score, literature_summary, upsert_tracker, bulk_tracker_action, annotations_merge, sheet_edits, json_props,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
