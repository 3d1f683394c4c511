from litgrid.sources import html_tables, sheets

PAGE = """<table-wrap id="t1"><label>Table 1</label><caption><p>Loci &amp; genes</p></caption>
<table><tr><th rowspan="2">SNP</th><th colspan="2">OR</th></tr><tr><td>a</td><td>b <i>c</i></td></tr><tr><td>rs1</td><td rowspan="3">x</td></tr></table></table-wrap>
<table id="T2"><tr><td>1<table><tr><td>inner</td></tr></table></td></tr></table><script>var a = '<table>';</script>"""


def test_spans_expand():
    first, second, inner = html_tables.tables_of(PAGE)[:3]
    assert first["grid"] == [["SNP", "OR", "OR"], ["SNP", "a", "b c"], ["rs1", "x", ""], ["", "x", ""], ["", "x", ""]]
    assert (first["id"], html_tables.clean(first["label"]), html_tables.clean(first["caption"])) == ("t1", "Table 1", "Loci & genes")
    assert second["grid"] == [["1"]] or second["grid"][0][0].startswith("1")
    assert inner["grid"] == [["inner"]]


def test_cells_and_choice(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    cells = html_tables.html_cells(pages).cache()
    assert cells.where("table_no = 0").count() == 15
    assert {r["table_no"] for r in html_tables.pick_table(cells, "t2").collect()} == {1}
    assert {r["table_no"] for r in html_tables.pick_table(cells, "tbl1").collect()} == {0}
    text = html_tables.page_text(pages).where("page_id = 1").first()["text"]
    assert "Loci & genes" in text and "var a" not in text


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b>", 1.5), (2, None, 2.0)], "k int, t string, v double")
    sheets.write_sheet(df, str(tmp_path / "x.xlsx"), ["k"])
    got = sorted((r["row_idx"], r["col_idx"], r["value"]) for r in sheets.read_workbooks(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "k"), (0, 1, "t"), (0, 2, "v"), (1, 0, "1"), (1, 1, "a<b>"), (1, 2, "1.5"), (2, 0, "2"), (2, 2, "2.0")]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y, z"\n1,2\n')
    assert [(r["row_idx"], r["col_idx"], r["value"]) for r in sheets.tables_from(spark, str(tmp_path / "a.csv")).orderBy("row_idx", "col_idx").collect()] == [(0, 0, "x"), (0, 1, "y, z"), (1, 0, "1"), (1, 1, "2")]


def test_publications(spark):
    xml = """<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A <i>gene</i></ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract>
    <PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Review</PublicationType></PublicationTypeList><Journal><JournalIssue><PubDate><MedlineDate>2019 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>Tau Proteins</DescriptorName><QualifierName>genetics</QualifierName><QualifierName>blood</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"""
    got = sheets.publications(spark.createDataFrame([(xml,)], "xml string")).first().asDict()
    assert got == {"pmid": "7", "title": "A gene", "abstract": "AIM: x\ny", "publication_types": ["Review"], "mesh_terms": ["Tau Proteins / genetics; blood"], "year": "2019"}
