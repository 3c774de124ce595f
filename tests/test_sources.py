from cohortlens.sources import tables


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('x\ty\n"q\t1\n\t2\n')
    assert sorted(map(tuple, tables.scan_tsv_noquote(spark, str(tmp_path / "a.tsv"), "x string, y int").collect())) == [("", 2), ('"q', 1)]
    (tmp_path / "p.txt").write_text("C1|NA|z|\nC2\n")
    got = tables.scan_pipe_headerless(spark, str(tmp_path / "p.txt"), ["a", "b", "c"]).collect()
    assert sorted(map(tuple, got)) == [("C1", None, "z"), ("C2", None, None)]


def test_footer(spark, tmp_path):
    (tmp_path / "f.csv").write_text('state,rate\nAA,1.5\nBB,2\n---\nDataset: Deaths\nYear: 2020\n')
    got = tables.scan_csv_with_footer(spark, str(tmp_path / "f.csv"), "state string, rate double", ["Dataset", "Year"]).collect()
    assert sorted(map(tuple, got)) == [("AA", 1.5, "Deaths", "2020"), ("BB", 2.0, "Deaths", "2020")]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x", "", "y"]')
    assert [(r.pos, r.value) for r in tables.scan_json_array(spark, str(tmp_path / "a.json")).collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "l.jsonl").write_text('{"text": "t", "pubmed_id": "bad", "label": [["0", "1", "C"]]}\n{"pubmed_id": "7"}\n')
    got = sorted((r.pubmed_id, r.text, len(r.label)) for r in tables.scan_jsonl(spark, str(tmp_path / "l.jsonl")).collect())
    assert got == [(-1, "t", 1), (7, "", 0)]


def test_xml_repair():
    own = tables.xml_sections('<article><body><sec><title>M</title><p>a <x:i>b</x:i></p><sec><title>N</title><p>c</p></sec></sec></body></article>')
    assert [(s["level"], s["title"], s["text"]) for s in own] == [(1, "M", "a b"), (2, "N", "c")]
    assert tables.xml_sections("not xml") == []


def test_waterfall_and_sinks(spark, tmp_path):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b"), (9, "b")], "k int, v string")
    assert sorted(map(tuple, tables.waterfall(keys, [a, b], "k").select("k", "v").collect())) == [(1, "a"), (2, "b")]
    tables.sink_jsonl(spark.sql("select 1 as id, array() as label"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"id":1,"label":[]}']
