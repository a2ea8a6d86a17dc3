from pyspark.sql import functions as F

from quarryline.operators import chunking, documents, tables

PAGE = """<html><head><title>t</title></head><body><ix:header><ix:hidden><ix:nonNumeric name="dei:EntityCentralIndexKey" contextRef="c">00012</ix:nonNumeric>
<ix:nonNumeric name="dei:DocumentFiscalYearFocus" contextRef="c"><b>2020</b></ix:nonNumeric></ix:hidden>
<xbrli:context id="c"><xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header>
<p>PART I</p><table><tr><td><a href="#i1">Item 1.</a><td>Business<tr><td><a href="#i7">Item 7.</a><td>Discussion</table>
<table><tr><td>ITEM 1.</td><td>BUSINESS</td></tr></table><p id="i1">We sell things.</p><p id="i7">Item 7. Discussion</p>
<p>Results of the year</p><p>(in millions)</p>
<table><tr><td rowspan=2>Year</td><td colspan=4>Ended December 31</td></tr><tr><td colspan=2>2020</td><td colspan=2>2019</td></tr>
<tr><td>Revenue</td><td>$</td><td><ix:nonFraction name="us-gaap:Revenues" contextRef="c" unitRef="u" scale="6">1,200</ix:nonFraction></td><td>$</td><td>(900</td><td>)</td></tr>
<tr><td>Rate</td><td>5</td><td>%</td><td>6</td><td>%</td></tr><tr><td>Cost<td><td><ix:nonFraction name="us-gaap:Cost" contextRef="x" unitRef="u" scale="6" sign="-">7</ix:nonFraction><td><td>&#8212;</table>
<p>Done.</p></body></html>"""


def docs(spark):
    return documents.parsed(spark.createDataFrame([("a", PAGE), ("b", ""), ("c", None), ("d", "<td>x<td>y")], "k string, h string"), "k", "h").cache()


def test_hidden_facts_open_cells_and_values(spark):
    d = docs(spark)
    r = d.filter("key = 'a'").first()
    assert r["dei"] == {"dei:EntityCentralIndexKey": "00012", "dei:DocumentFiscalYearFocus": "2020"} and documents.broken_spans(d).count() == 0
    got = {x["concept"]: (x["value"], x["monetary"]) for x in documents.span_values(d).collect()}
    assert got == {"us-gaap:Revenues": (1_200_000_000, True), "us-gaap:Cost": (-7_000_000, True)}
    assert [x["concept"] for x in documents.in_context(documents.span_values(d), d).collect()] == ["us-gaap:Revenues"]
    b = documents.blocks(d).filter("key = 'a'").orderBy("block_no").collect()
    assert [x["kind"] for x in b].count("table") == 3 and b[1]["rows"][0] == ["Item 1.", "Business"]


def test_sections_from_headings_and_links(spark):
    d = docs(spark)
    b = documents.blocks(d)
    s = {(r["item_code"], r["title"]) for r in documents.sections(documents.headings(b)).collect()}
    assert s == {("I.1", "BUSINESS"), ("I.7", "Discussion")}
    e = {(r["part"], r["item_code"], r["block_no"]) for r in documents.index_entries(d).collect()}
    places = {r["block_text"]: r["block_no"] for r in b.filter("key = 'a'").collect()}
    assert e == {("I", "1", places["We sell things."]), ("I", "7", places["Item 7. Discussion"])}
    at = documents.section_of(b.select("key", "block_no"), documents.sections(documents.headings(b)))
    assert {r["block_no"]: r["item_code"] for r in at.filter("key = 'a'").collect()}[places["We sell things."]] == "I.1"


def test_tables_on_their_grid(spark):
    r = tables.extracted(docs(spark)).collect()
    assert len(r) == 1
    t = r[0]
    assert t["columns"] == ["Year", "Ended December 31 2020", "Ended December 31 2019"] and t["header_rows"] == 2
    assert t["body"] == [["Revenue", "$1,200", "$(900)"], ["Rate", "5%", "6%"], ["Cost", "7", "—"]]
    assert (t["unit_scale"], t["scale_source"], t["currency"], t["title"]) == ("millions", "caption", "USD", "Results of the year") and len(t["fiscal_periods"]) == 2 and not t["collapsed"]
    df = spark.createDataFrame([(["a|b", "c"], [["1", "2"]])], "c array<string>, b array<array<string>>")
    line = tables.context_line(F.lit("T"), F.lit("Acme"), F.lit("FY2020"), F.lit("Item 8"), F.lit("millions"), F.lit("USD"))
    assert df.select(tables.markdown(line, F.col("c"), F.col("b")).alias("m")).first()["m"] == "[Table: T | Acme | FY2020 | Item 8 | in millions, USD]\n| a\\|b | c |\n|---|---|\n| 1 | 2 |"


def test_navigation_and_quarantine(spark):
    b = spark.createDataFrame([("a", n, "Back to contents", 20 * n, 20 * n + 16) for n in range(3)] + [("a", 3, "See the note on page four for all details of it, in full length.", 60, 124)], "key string, block_no int, block_text string, char_start int, char_end int")
    links = spark.createDataFrame([("a", "toc", 20 * n, 20 * n + 16) for n in range(3)] + [("a", "toc", 60, 63)], "key string, target string, char_start int, char_end int")
    assert {r["block_no"] for r in documents.navigation_blocks(b, links).collect()} == {0, 1, 2}
    m = [("a", "10-K", 9, [], 5, [], True, 4, 3, 4, 0, 10, 10, 0, 0.7, 2020), ("b", "10-K", 1, ["7"], 5, ["1"], None, 0, 0, 0, 0, 0, 0, 2, 0.1, None)]
    names = "key string, form_type string, sections int, missing array<string>, required int, stubs array<string>, has_1a boolean, data_tables int, scaled_tables int, scale_eligible int, collapsed_tables int, numeric_spans int, resolved_spans int, span_mismatches int, alpha double, fiscal_year int"
    got = {r["key"]: (r["failures"], r["score"]) for r in documents.quarantine(spark.createDataFrame(m, names), {"sections": 3, "data_tables": 1, "alpha": (0.5, 0.9)}).collect()}
    assert got["a"] == ([], 0.95) and got["b"] == (["sections", "missing 7", "stub 1", "no 1A", "data tables", "letters", "no fiscal year", "spans"], 0.4)


def test_document_chunks_fit_tile_and_are_named_once(spark):
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    prose = " ".join(f"S{i} {words(7)}." for i in range(9)) + f" Long {words(12)}; {words(14, 'c')}; {words(33, 'x')}."
    rows = [f"| r{i} | {i} |" for i in range(12)]
    units = [("a", "1", 0, "prose", "Short one.", None, "[h]", None), ("a", "1", 1, "prose", prose, None, "[h]", None), ("a", "1", 2, "table", None, rows, "[h]", ["| n | v |"]), ("a", "1", 3, "layout", words(30), [words(15), words(15, "z")], "[h]", None),
             ("a", "2", 4, "prose", "", None, "[h]", None), ("b", "1", 0, "prose", None, None, None, None), ("c", "1", 0, "prose", "y " * 3, None, "[k]", None)]
    df = spark.createDataFrame(units, "key string, section string, block_no int, kind string, text string, rows array<string>, header string, context array<string>")
    got = chunking.chunk_documents(df, 20, 5).collect()
    assert len({r["chunk_id"] for r in got}) == len(got) and all(r["size"] <= 20 for r in got) and {r["key"] for r in got} == {"a", "c"}
    body = [x for r in got if r["chunk_type"] == "table" for x in r["raw_text"].split("\n") if x != "| n | v |"]
    assert body == rows and all(r["raw_text"].startswith("| n | v |") for r in got if r["chunk_type"] == "table")
    said = " ".join(r["raw_text"] for r in got if r["chunk_type"] == "prose" and r["key"] == "a").split()
    assert set(prose.split()) <= set(said) and set(words(15, "z").split()) <= set(said)
    s = {r["key"]: r for r in chunking.chunk_stats(chunking.chunk_documents(df, 20, 5)).collect()}["a"]
    assert (s["paragraphs_split"], s["tables_split"], s["layout_tables_split"], s["over_budget"]) == (1, 1, 1, 0) and s["whitespace_splits"] >= 2
    assert chunking.chunk_documents(df.limit(0), 20, 5).count() == 0
