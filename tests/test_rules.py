"""Rules of names, dates, figures, links and definitions against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import definitions, text as t, web
from lamina.operators import models, triples as tr
from lamina.plans import issuers
from lamina.sources import readers
from lamina.streaming import ingest


@pytest.fixture(scope="module")
def one(spark):
    def run(f, *values):
        names = [f"v{k}" for k in range(len(values))]
        return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first()[0]

    return run


@pytest.mark.parametrize("given, want", [
    ("CÔNG TY TNHH MÔI TRƢỜNG Đất Việt", "moi truong dat viet"), ("Tổng Công ty Cổ phần An Phát", "tong an phat"), ("Công ty Trách nhiệm hữu hạn Một", "mot"), ("An Phat Bioplastics Joint Stock Company", "an phat bioplastics"),
    ("Green Plastics Corporation", "xanh plastic"), ("AAA J.S.C.", "aaa"), ("Foo Co., Ltd", "foo"), ("Tập đoàn X Inc", "x"), ("", ""), (None, None), ("!!", ""), ("Công ty", ""),
])
def test_normal_form(one, given, want):
    assert one(t.normalize_name, given) == want


def test_tokens_of_names(one):
    assert sorted(one(t.core_tokens, "CTCP Nhựa An Phát Xanh Việt Nam")) == ["an", "phat", "xanh"]
    assert one(t.core_tokens, "Công ty Xây dựng") == [] and one(t.core_tokens, None) is None


@pytest.mark.parametrize("given, want", [
    ("Tổng Công ty cổ phần Bia Sài Gòn - CTCP", "Bia Sài Gòn"), ("Tổng công ty Khí", "Khí"), ("CTCP - Tổng Công ty Một", "Một"), ("CTCP Tập đoàn Hòa Phát", "Hòa Phát"), ("CTCP Số 5", "Số 5"), ("Công ty cổ phần FPT", "FPT"),
    ("Ngân hàng TMCP Á Châu", "Ngân hàng Á Châu"), ("Tập đoàn Bảo Việt CTCP", "Bảo Việt"), ("Vinamilk", "Vinamilk"), (None, None),
])
def test_short_names(one, given, want):
    assert one(t.short_name, given) == want


@pytest.mark.parametrize("name, vague", [("47", True), ("Số 5", False), ("Miền Đông", False), ("FPT", True), ("1 - 2", True), ("Bitexco", False), ("Idico", True)])
def test_vague_names(one, name, vague):
    assert one(t.vague_name, name) is vague


@pytest.mark.parametrize("given, want", [
    ("2020-01-02T03:04", "2020-01-02"), ("Thứ hai, 3-4-2021, 07:15", "2021-04-03"), ("13/12/2019", "2019-12-13"), (" 2020-05 ", "2020-05-01"), ("hôm qua", "hôm qua"), ("", ""), (None, None),
])
def test_dates(one, given, want):
    assert one(t.normalize_date, given) == want


@pytest.mark.parametrize("date, url, want", [
    ("3/4/2021", "x", "2021"), ("", "https://a/b-20190412093000123.htm", "2019"), ("", "https://a/b-19990412093000123.htm", "1999x"), (None, "https://a/b-185180921104500.htm", "2018"), ("?", "https://a/2016/b", "2016"), ("", "https://a/b", "1999x"), ("1998-01-01", "x", "1999x"),
])
def test_years_of_articles(one, date, url, want):
    assert one(lambda d, u: t.article_year(d, u, F.lit("1999x")), date, url) == want


@pytest.mark.parametrize("value, unit, want", [
    ("12.5%", None, (12.5, None, "%")), ("12%", "ratio", (12.0, None, "ratio")), ("12%", "", (12.0, None, "%")), ("n/a", None, (None, "n/a", None)), ("about 5%", None, (None, "about 5%", "%")), ("1e3", "kg", (1000.0, None, "kg")), ("1,5", "kg", (None, "1,5", "kg")), (None, None, (None, None, None)),
])
def test_figures(one, value, unit, want):
    assert tuple(one(t.kpi_value, value, unit)) == want


def test_years_of_figures(one):
    assert one(t.year_value, "2024") == 2024 and one(t.year_value, "FY24") is None and one(t.year_value, None) is None


@pytest.mark.parametrize("url, want", [("https://www.youtube.com/x", False), ("https://a.vn/tag/x", False), ("https://a.vn/x.PDF", False), ("https://studocu.vn/x", False), ("ftp://a.vn", False), ("https://a.vn/tin/x.html", True), (None, False)])
def test_wanted_links(one, url, want):
    assert one(web.wanted_link, url) is want


def test_sources_and_authors(one):
    assert [one(web.source_of, u) for u in ("https://TuoiTre.vn/a", "https://vnexpress.net/thanhnien", "https://a.vn")] == ["Tuổi Trẻ", "VnExpress", "Unknown"]
    assert [one(web.author_name, a) for a in (" TuoiTre.vn ", "Mai", None)] == ["", "Mai", ""]


def test_metadata_by_the_first_place_that_states_it(one):
    meta = one(web.page_metadata, '<meta property="og:title" content="Short"><h1 class="title-detail">A heading <b>here</b></h1><meta name="author" content="VnExpress"><script type="application/ld+json">{"headline": "", "datePublished": "2021-05-06T01", "author": {"@type": "Person", "name": "Mai"}}</script>', "https://www.a.vn/x")
    assert tuple(meta) == ("A heading here", "2021-05-06", "Mai", "a.vn")
    assert tuple(one(web.page_metadata, "<p>x</p>", "https://a.vn/b-20190412093000123.htm")) == ("", "2019-04-12", "", "a.vn")
    assert one(web.page_metadata, '<time datetime="2020-02-03">x</time>', "https://a.vn").date == "2020-02-03"


def test_primary_names(spark):
    rows = [({"name": "", "term": "a"},), ({"title": "b"},), ({"claim_id": "c", "name": None},), ({},), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "p map<string,string>").select(t.primary_name(F.col("p"))).collect()] == ["a", "b", "c", "", ""]


def test_classification_of_names(spark):
    names = spark.createDataFrame(
        [("An Phát Xanh", 3), ("AAA Group", 1), ("An Phát Holdings", 80), ("An Phát Bao bì", 2), ("An Phát", 50), ("An Phát", 1), ("Phát An Co", 1), ("An Phát Xanh Yên Bái", 5), ("Khác", 9), (None, 1), ("Công ty", 4), (" ", 1)], "name string, edges int"
    )
    issuer = spark.createDataFrame([("AAA", "CTCP Nhựa An Phát Xanh")], "ticker string, full_name string")
    got = {r.name: (r.kind, r.suggest, r.edges, r.place) for r in issuers.classify(names, issuer, issuers.SEEDS, issuers.QUALIFIERS).collect()}
    assert got == {
        "An Phát Xanh": ("alias", None, 3, 1), "AAA Group": ("alias", None, 1, 2), "An Phát Holdings": ("exclude", None, 80, 1), "An Phát": ("review", "include", 51, 1),
        "An Phát Xanh Yên Bái": ("review", "exclude", 5, 2), "An Phát Bao bì": ("review", "exclude", 2, 3), "Phát An Co": ("review", "exclude", 1, 4),
    }
    reason = {r.name: r.reason for r in issuers.classify(names, issuer, issuers.SEEDS, issuers.QUALIFIERS).collect()}
    assert reason["An Phát"] == "shares issuer core ['an', 'phat'] and is subject of 51 report edges → likely an issuer shorthand"
    assert reason["An Phát Bao bì"] == "shares issuer core ['an', 'phat'] but qualifier ['bao', 'bi'] → likely related-but-separate entity"
    assert issuers.classify(names.limit(0), issuer, issuers.SEEDS, issuers.QUALIFIERS).count() == 0


def test_definitions(one):
    body = "6. 1 . Môi trường: a) Tổng lượng phát thải / Total emissions ; b) Nước sử dụng. / Water\n6.2. Quản lý: Nguyên liệu tái chế / Recycled"
    got = one(definitions.sections, "x " + body)
    assert [r.code for r in got] == ["6.1", "6.2"] and got[1].body.strip() == "Nguyên liệu tái chế / Recycled"
    assert one(definitions.vietnamese_indicators, got[0].body) == ["Tổng lượng phát thải", "Nước sử dụng"]
    assert one(definitions.vietnamese_indicators, "Chỉ tiêu (a) / (GRI) ngắn hạn / Số / x") == ["Chỉ tiêu (a)", "ngắn hạn"]
    assert one(lambda c: definitions.between(c, "Mục 6", r"Lưu ý", r"\nIII\."), "a MỤC 6 b\nIII. c") == "MỤC 6 b" and one(lambda c: definitions.between(c, "Mục 7"), "a") is None
    table = one(lambda c: definitions.two_columns(c, "Tiết kiệm", "Thông tin", ("Môi trường", "Xã hội")), "x\nMôi trường\nTiết kiệm\nLao động\n\nNước\nXã hội\nCộng đồng\nThông tin y")
    assert (table.left, table.right) == (["Tiết kiệm", "Nước"], ["Lao động", "Cộng đồng"])
    assert one(definitions.label_name, "Báo cáo liên quan đến điện") == "Điện" and one(definitions.label_name, "Nước") == "Nước"
    assert one(definitions.fixed, " Chính sách lao độngnhằm x ") == "Chính sách lao động nhằm x" and one(definitions.squash, " .a \n b;") == "a b"


def test_answers_and_bookkeeping(spark, one):
    assert [one(tr.accepted, f) for f in ("STOP", "MAX_TOKENS", "", None, "SAFETY")] == [True, True, True, True, False]
    assert spark.createDataFrame([({"_batch": "1", "a": "2"},)], "p map<string,string>").select(tr.without_bookkeeping(F.col("p"))).first()[0] == {"a": "2"}


def test_keys_of_entities(spark):
    rows = [("Location", {"name": " Huế ", "country": None}), ("Location", {"name": "Huế"}), ("Emission", {"category": "CO2", "scope": "1", "valid_from": "2020"}), ("Nope", {"name": "x"})]
    df = spark.createDataFrame(rows, "c string, p map<string,string>").select(tr.stable_id(F.col("c"), F.col("p")).alias("e"), tr.version_key(F.col("c"), F.col("p")).alias("v"))
    got = [tuple(r) for r in df.collect()]
    assert [e for e, _ in got[:3]] == ["Location|huế|None", "Location|huế|", "Emission|co2|1|2020"] and got[0][1] == "Location|huế|None||" and "category=CO2" in got[2][1]


def test_a_failing_judge_says_no_and_failing_embedders_give_zeros(spark):
    def judge(a, b):
        if a == 2:
            raise ValueError
        return True

    pairs = [(0.9, 1, 3), (0.95, 2, 3), (0.8, 1, 4)]
    assert models.adjudicate(pairs, judge, 3) == [(1, 3), (1, 4)] and models.adjudicate(pairs, judge, 2) == [(1, 3)]
    table = spark.createDataFrame([(a, b, c) for c, a, b in pairs], "a int, b int, cosine double")
    assert models.adjudicate_pairs(table, judge, 3) == [(1, 3), (1, 4)]
    calls = []
    assert models.attempts(lambda x: calls.append(1) or (x if len(calls) > 1 else 1 / 0), 7, 2) == 7

    def broken(texts, size):
        raise OSError

    got = spark.createDataFrame([("a",), (None,)], "t string").select(models.embed(F.col("t"), 4, broken)).collect()
    assert [list(r[0]) for r in got] == [[0.0] * 4] * 2


def test_broken_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text('{"text": "x"}\n{oops\n{"text": "y", "page": 3}\n')
    got = readers.labeled_sentences(spark, str(tmp_path)).collect()
    assert sorted((r.source_pdf, r.page, r.text, r.source_file) for r in got) == [("unknown.pdf", 0, "x", "sub/a.jsonl"), ("unknown.pdf", 3, "y", "sub/a.jsonl")]
    assert [tuple(r) for r in readers.broken_lines(spark, str(tmp_path)).collect()] == [("sub/a.jsonl", "{oops")]


def test_pages_manifest_and_triples(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("một-\ntrang\f \fhai".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = readers.pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert sorted((r.source_pdf, r.page, r.text) for r in got) == [("a.pdf", 1, "mộttrang"), ("a.pdf", 3, "hai")]
    assert {(r.file, r.bytes) for r in readers.manifest(spark, str(tmp_path), "*.pdf").collect()} == {("a.pdf", len("một-\ntrang\f \fhai".encode())), ("b.pdf", 1)}
    (tmp_path / "t.json").write_text('[{"subject": {"class": "A", "properties": {"name": "x"}}, "predicate": "p", "object": {"class": "B", "properties": {}}}]')
    r = readers.validated_triples(spark, str(tmp_path / "t.json")).first()
    assert (r.subject["class"], r.predicate, r.object.properties) == ("A", "p", {})


def test_spacing_and_recency(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 9.0), ("b", 0.1)], "host string, at double")
    assert sorted((r.host, round(r.goes_at, 3)) for r in ingest.spaced(rows, "host", "at", 2.0).collect()) == [("a", 0.0), ("a", 2.0), ("a", 9.0), ("b", 0.1)]
    times = spark.createDataFrame([("2020-01-01",), ("2023-01-01",), (None,)], "d string").withColumn("d", F.to_timestamp("d"))
    assert ingest.recent(times, "d", 5, "2026-06-01").count() == 2
