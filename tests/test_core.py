"""The core's operators against hand-made cases and brute force, and every query against its SQL."""

import datetime as dt
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.functions import text as t, web
from lamina.operators import graph, history, models, ontology, resolve, triples as tr
from lamina.plans import catalog
from lamina.sources import readers, sinks
from lamina.sources.buckets import BucketedTable
from lamina.streaming import ingest

SNAP = "snap_id bigint, source_file string, stable_id string, properties map<string,string>, recorded_at timestamp, text string"


def snaps(spark, rows):
    return spark.createDataFrame([(i, None, e, p, dt.datetime.fromisoformat(r) if r else None, "x") for i, (e, p, r) in enumerate(rows)], SNAP)


def chains(df):
    return sorted(map(tuple, df.collect()))


def test_versions_by_the_rules(spark):
    rows = [
        ("a", {"valid_from": "2010", "type": "x"}, "2010-05-01"),
        ("a", {"valid_from": "2011-02-03", "type": " X "}, "2011-05-01"),  # same but for case and blanks
        ("a", {"valid_from": "2012", "type": "y", "valid_to": "2012-06-01"}, "2012-05-01"),
        ("a", {"valid_from": "2013", "type": "y"}, "2013-05-01"),  # starts again after the end
        ("b", {"type": "None", "name": None}, "2010-01-01"),  # states nothing
        ("b", {"type": "z"}, "2010-03-04"),  # dated by its recording
        ("b", {"type": "q"}, "2010-03-04"),  # the later row of a day counts
        (None, {"type": "z"}, "2010-03-04"),
        ("c", None, None),
        ("d", {"valid_from": "2015", "type": "x", "valid_to": "2014"}, "2015-01-01"),  # an end before the start is none
    ]
    want = [("a", "2010-01-01", "2012-01-01"), ("a", "2012-01-01", "2012-06-01"), ("a", "2013-01-01", "9999-12-31"), ("b", "2010-03-04", "9999-12-31"), ("d", "2015-01-01", "9999-12-31")]
    raw = snaps(spark, rows)
    assert chains(history.build_chains(raw)) == want
    assert chains(history.versions_with_late_updates(raw, 0.5)) == want
    assert chains(history.build_chains(raw.union(raw))) == want  # repeated rows
    assert chains(history.versions_with_late_updates(raw.limit(0))) == []


def test_affected_chains_equal_a_whole_rebuild(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(9)}", {k: v for k, v in (("type", rng.choice("abc")), ("valid_from", rng.choice(["2010", "2011-03-01", "2012", None])), ("valid_to", rng.choice(["2011-09-09", "null", None]))) if rng.random() < 0.8}, f"20{rng.randrange(10, 14)}-0{rng.randrange(1, 9)}-01") for _ in range(120)]
    raw = snaps(spark, rows)
    old, late = raw.filter("snap_id < 80"), raw.filter("snap_id >= 80")
    table = history.chain_table(spark, f"file://{tmp_path}/chains")
    table.replace(history.build_chains(old))
    history.rebuild_affected(table, raw, late)
    assert chains(table.read()) == chains(history.build_chains(raw))


def test_one_late_row_rewrites_one_bucket(spark, tmp_path):
    raw = snaps(spark, [(f"e{i}", {"type": "x", "valid_from": "2010"}, "2010-01-01") for i in range(200)] + [("e7", {"type": "y", "valid_from": "2009"}, "2011-01-01")])
    folder = f"{tmp_path}/chains"
    table = history.chain_table(spark, f"file://{folder}")
    table.replace(history.build_chains(raw.filter("snap_id < 200")))
    before, files = table.generations(), set(glob.glob(f"{folder}/gen=*/bucket_no=*/*.parquet"))
    shown = table.read()  # a reader that began before the switch
    history.rebuild_affected(table, raw, raw.filter("snap_id = 200"))
    after = table.generations()
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert len(set(glob.glob(f"{folder}/gen=*/bucket_no=*/*.parquet")) - files) == 1
    assert shown.count() == 200 and chains(table.read()) == chains(history.build_chains(raw))
    history.rebuild_affected(table, raw, raw.filter("snap_id = 200"))  # the replacement after removes what was stale
    assert files - set(glob.glob(f"{folder}/gen=*/bucket_no=*/*.parquet"))
    history.rebuild_affected(table, raw, raw.limit(0))  # nothing touched, nothing written
    assert table.generations().keys() == before.keys()


def test_tables_are_replaced_at_once(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/table", ["id"], 4)
    assert table.read() is None
    for n in (3, 5, 0):
        table.replace(spark.range(n))
        assert sorted(r.id for r in BucketedTable(spark, f"file://{tmp_path}/table", ["id"]).read().collect()) == list(range(n))


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first()[0]
    assert one(t.normalize_name, "Công ty Cổ phần MÔI TRƢỜNG Đất Việt") == "moi truong dat viet"
    assert one(t.normalize_name, None) is None and one(t.normalize_name, "") == ""
    assert one(t.merge_wrapped_lines, "một dòng \n nối\nxong.\nmới\n5 số") == "một dòng nối xong.\nmới\n5 số"
    assert one(t.clean_page, "a­b  c\n\n\n\nphát-\ntriển ") == "ab c\n\npháttriển"
    assert [one(t.normalize_date, d) for d in ("2020-01-02T03", "3/4/2021", "2020-05", "x", None)] == ["2020-01-02", "2021-04-03", "2020-05-01", "x", None]
    assert one(t.domain, "https://WWW.a.example:8/x#y") == "a.example:8" and one(t.canonical_url, "http://a/b//#c") == "http://a/b"
    assert one(t.recover_json, 'x ```json\n{"a": "http://b", // c\n "d": [1,],}\n``` y').replace(" ", "").replace("\n", "") == '{"a":"http://b","d":[1]}'
    assert one(t.safe_name, "Đơn vị 1") == "Đơn_vị_1"
    assert one(readers.unwrap_redirect, "https://d.example/l/?uddg=https%3A%2F%2Fa.example%2Fx&r=1") == "https://a.example/x"
    assert one(readers.unwrap_redirect, "https://b.example/ck/a?u=a1aHR0cHM6Ly9hLmV4YW1wbGU&n=1") == "https://a.example"


def test_ontology():
    assert len(ontology.IDENTITY_KEYS) == 27 and len(ontology.rules()) == 63 and len({r[0] for r in ontology.rules()}) == 44 and len(ontology.versioned_classes()) == 9


def test_validation(spark):
    life = {"valid_from": "2020", "valid_to": None, "is_current": "true"}
    times = {"valid_from": "2020", "valid_to": None, "recorded_at": "2021"}
    rows = [
        (1, "Organization", life, "claims", "SustainabilityClaim", life, times),
        (2, "SustainabilityClaim", life, "claims", "Organization", life, times),  # reversed
        (3, "Organization", {}, "knows", "Nobody", None, {"valid_from": "2020"}),
        (4, None, None, None, None, None, None),
    ]
    m = "map<string,string>"
    df = spark.createDataFrame(rows, f"seq bigint, s_class string, s_props {m}, predicate string, o_class string, o_props {m}, temporal {m}")
    got = {r.seq: r for r in tr.validate(df).collect()}
    assert got[1].errors == [] and not got[1].fixed and got[2].errors == [] and got[2].fixed and got[2].s_class == "Organization"
    assert got[3].errors == ["subject: valid_from missing", "subject: valid_to missing", "subject: is_current missing", "object: unknown class Nobody", "object: properties missing", "unknown predicate knows", "times: valid_to missing", "times: recorded_at missing"]
    assert got[4].errors == ["subject: class missing", "subject: properties missing", "object: class missing", "object: properties missing", "predicate missing", "times missing"]
    assert tr.validate(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_components(spark, parts):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 3), (9, 9), (None, 4), (3, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "a bigint, b bigint").repartition(parts)).collect()))
    assert {got[i] for i in range(100, 141)} == {100} and got[7] == got[3] == 3 and got[9] == 9 and 4 not in got
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_pairs(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 5)).astype("float32")
    df = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(40)], "vec_id bigint, label int, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 == j % 3 and float(u[i].astype(float) @ u[j]) >= 0.3}
    for block in (500, 3):
        rows = resolve.similar_pairs(df, 0.3, block).collect()
        assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_consolidate_prefers_the_fullest(spark):
    rows = [("a", {"name": "An", "valid_from": "2010"}, "2010-01-01"), ("a", {"name": "An Phat", "type": "x", "k": ""}, "2011-01-01"), ("a", {"k": "v", "type": "y"}, "2012-01-01"), ("b", None, None)]
    assert [tuple(r) for r in resolve.consolidate(snaps(spark, rows)).collect()] == [("a", "k=v;name=An Phat;type=x")]


def test_web_functions(spark):
    page = '<html><head><title>T</title><meta property="og:title" content="Tựa đề của bài báo"><script>x()</script><script type="application/ld+json">{"datePublished": "2020-03-04T05:06"}</script></head><body><h1>H</h1><p>a&nbsp;b &amp;</p><div>c</div>d</body></html>'
    row = spark.createDataFrame([(page, "https://www.a.example/2021/x")], "p string, u string")
    m = row.select(web.page_metadata(F.col("p"), F.col("u")).alias("m")).first().m
    assert (m.title, m.date, m.author, m.site) == ("Tựa đề của bài báo", "2020-03-04", "", "a.example")
    assert row.select(web.html_text(F.col("p")).alias("x")).first().x.startswith("T H\na b &\nc\n")
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first()[0]
    assert one(web.repair_zip_name, "Báo cáo.pdf".encode().decode("cp437")) == "Báo cáo.pdf" and one(web.repair_zip_name, None) is None
    assert one(web.clean_text, " a&eacute;\x07b ") == "aéb"
    assert [one(web.year_text, y) for y in ("2020.0", None, "nan", "20/21")] == ["2020", "NA", "NA", "20_21"]
    assert [one(web.wanted_link, u) for u in ("https://a/b", "https://youtube.com/x", "ftp://a", None)] == [True, False, False, False]
    assert one(web.annual_report_link, "/files/Bao-cao-thuong-nien-2020.pdf") and not one(web.annual_report_link, "/tin")
    assert one(lambda c: web.context(c, "neo", 2, 3), "abcneodefgh") == "bcneodef"
    assert tuple(one(lambda c: web.year_bounds(c.cast("int")), "1970")) == (0, 365 * 86400 - 1)
    mirrors = spark.createDataFrame([("k", 1, 404, "x", "a"), ("k", 2, 200, "no", "b"), ("k", 3, 200, "the needle", "c"), ("k", 4, 200, "needle", "d")], "key string, priority int, status int, body string, url string")
    assert web.first_mirror(mirrors, "key", "needle").first().url == "c"


def test_resolve_graph(spark):
    org = lambda n: {"name": n}
    kpi = lambda title: {"kpi_type": "e", "source_id": "s", "year": "2020", "title": title}
    nodes = [(1, "Organization", org("Công ty ABC")), (2, "Organization", org("công ty abc")), (3, "Organization", org("Công ty Ábc")), (4, "Organization", org("Vân Giáp")), (5, "Organization", org("VAN GIAP JSC")),
             (6, "KPIObservation", kpi("A")), (7, "KPIObservation", kpi("B")), (8, "KPIObservation", kpi("a")), (9, "Organization", org("none")), (10, "Organization", org(None)), (11, "Person", org("Vân Giáp"))]
    edges = [(1, 1, "owns", 2, "2018", None), (2, 1, "owns", 4, "2018-01-01", None), (3, 2, "owns", 5, "in 2018", None), (4, 3, "owns", 5, None, "2021-02-02"), (5, 9, "owns", 10, None, None)]
    n, e = resolve.resolve_graph(
        spark.createDataFrame(nodes, "node bigint, class string, props map<string,string>"), spark.createDataFrame(edges, "seq bigint, src bigint, predicate string, dst bigint, valid_from string, recorded_at string"),
        spark.createDataFrame([("Vân Giáp", "VG"), ("Van Giap", "VG")], "name string, ticker string"), spark.createDataFrame([(11, 9), (4, 1)], "a bigint, b bigint"),
    )
    got = {r.node: (r.members, r.ticker) for r in n.collect()}
    assert got == {1: (3, None), 4: (2, "VG"), 6: (2, None), 7: (1, None), 9: (2, None), 10: (1, None)}  # an issuer isn't merged by a confirmed pair
    assert sorted(map(tuple, e.collect())) == [(2, 1, "owns", 4, "2018"), (4, 1, "owns", 4, "2021"), (5, 9, "owns", 10, "")]


def test_models(spark):
    df = spark.createDataFrame([(1, "nước thải"), (2, None)], "key bigint, text string")
    scores = {r.key: r.s for r in df.select("key", models.classify(F.col("text"), models.keyword_logits).alias("s")).collect()}
    assert scores[1]["Environmental"] > 0.5 > scores[1]["Neutral"] and scores[2]["Neutral"] > 0.5

    def extractor(text):
        if not text:
            raise ValueError("empty")
        return [{"n": len(text)}]

    got = {r.key: (r.n, r.error) for r in models.extract(df, extractor, "n int").collect()}
    assert got[1][0] == 9 and got[2][1] == "empty"
    assert models.adjudicate([(0.9, 1, 2), (0.8, 2, 3), (0.7, 1, 3), (0.6, 4, 5)], lambda a, b: True, 3) == [(1, 2), (2, 3), (4, 5)]
    assert len(df.select(models.embed(F.col("text")).alias("e")).first().e) == 64


def test_files(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    (src / "a.jsonl").write_text('{"source_pdf": "x.pdf", "page": 2, "text": null, "esg": true, "scores": {"Neutral": 0.2}, "labels": ["Social"]}\n\n{"text": "b"}\n')
    rows = sorted(map(tuple, readers.labeled_sentences(spark, str(tmp_path / "in")).select("source_pdf", "page", "sentence_index", "text", "esg").collect()))
    assert rows == [("unknown.pdf", 0, 0, "b", False), ("x.pdf", 2, 0, "", True)]
    out = str(tmp_path / "out")
    sinks.write_sentences(readers.labeled_sentences(spark, str(tmp_path / "in")), out)
    assert spark.read.option("header", True).csv(f"{out}/csv").filter("labels = 'Social'").first()["score_Neutral"] == "0.2"
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page_7_kpis.json").write_text('[{"kpi_type": "e", "observations": [{"value": "15%"}]}]')
    assert readers.page_kpis(spark, str(pages)).first().page == 7
    (pages / "page_1.json").write_text('{"nodes": [], "edges": []}')
    (pages / "page_2.json").write_text("[1]")
    (pages / "page_3.json").write_text("{oops")
    (pages / "page_4_fixed.json").write_text("{}")
    got = dict(readers.input_pages(readers.page_graphs(spark, str(pages))).select("file", "format").collect())
    assert got == {"page_1.json": "graph", "page_2.json": "triple_array", "page_3.json": "error", "page_7_kpis.json": "triple_array"}
    assert spark.createDataFrame([(b"\xc3\xa9",), (b"\xe9",)], "b binary").select(readers.decode_bytes(F.col("b")).alias("s")).distinct().count() == 1


def test_streaming_upsert(spark, tmp_path):
    src, table, check = (f"{tmp_path}/{x}" for x in ("src", "table", "check"))
    schema = "id bigint, v string, at bigint"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).write.parquet(src)
    stream = ingest.files(spark, src, schema)
    ingest.upsert_available(stream, f"file://{table}", check, ["id"], "at")
    spark.createDataFrame([(2, "d", 0), (3, "e", 5)], schema).write.mode("append").parquet(src)
    ingest.upsert_available(ingest.files(spark, src, schema), f"file://{table}", check, ["id"], "at")
    assert sorted((r.id, r.v) for r in BucketedTable(spark, f"file://{table}", ["id"]).read().collect()) == [(1, "c"), (2, "b"), (3, "e")]


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    df = catalog.queries()[name](spark, data)
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(_plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(_plain(x[c]) for c in sorted(columns)) for x in df.collect()), key=repr) == want
