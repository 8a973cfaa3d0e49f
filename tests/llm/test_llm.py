"""The text operators against brute force, round trips and the cases that break programs."""

import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamina.llm import boilerplate, garbled, lookalike, names, neardup, packing, pii, queries, sentences, tokens

TABLES = ("sentences", "page_texts", "articles", "issuer_registry", "issuer_aliases", "documents", "pack_specs")
#: Names that operators use inside.
CLASHING = ("key", "uid", "slot", "n", "rep", "pos", "chunk", "label", "band", "fill", "part", "word", "ticker2")


def schema_of(data, name):
    return pq.read_schema(f"{data}/{name}.parquet")


def write(folder, name, rows, schema, extra=True):
    table = pa.Table.from_pylist(rows, schema)
    if extra:
        for c in CLASHING:
            table = table.append_column(c, pa.array(["x"] * len(rows), pa.string()))
    pq.write_table(table, f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def hard(data, tmp_path_factory):
    """Tables of null rows, empty and blank texts, one very long text, ties and repeated rows."""
    folder = tmp_path_factory.mktemp("hard")
    long = "Đội vận hành vừa gia cố trạm biến áp. " * 4000
    texts = [None, "", "  \n\t", "a", "́", "\U0001f33e", "�", long, "Một câu. Hai câu.", "Một câu. Hai câu.", "x" * 5000, "\0", "日本" * 3000]
    for name in TABLES:
        schema = schema_of(data, name)
        key = schema.names[0] if name != "sentences" else "seq"
        column = {"issuer_aliases": "alias_name", "issuer_registry": "canonical_name", "pack_specs": "purpose"}.get(name, "text")
        rows = []
        for i, t in enumerate(texts):
            row = dict.fromkeys(schema.names)
            row[key] = (f"T{i}" if name == "issuer_registry" else i + 1)
            row[column] = t
            if name == "pack_specs":
                row["capacity_tokens"] = [None, 0, 64, 2048][i % 4]
            rows.append(row)
        write(folder, name, rows, schema)
    return str(folder)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        write(folder, name, [], schema_of(data, name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_hard_rows(spark, hard, name):
    queries.queries()[name](spark, hard).collect()


def test_hard_results(spark, hard):
    q = {n: [tuple(r) for r in f(spark, hard).collect()] for n, f in queries.queries().items() if n in ("p1_found", "p4_found", "p5_found", "p6_found", "p8_ids", "p10_redacted", "p3_normalized")}
    assert set(q["p1_found"]) == {("sentences", 7), ("page_texts", 7)}
    assert (9, 10) in q["p4_found"] and all(a < b for a, b in q["p4_found"]) and not {a for p in q["p4_found"] for a in p} & {1, 2, 3}
    assert q["p5_found"] == [(11, "T10")]  # the one name that the registry has as a single word
    assert {r for r in q["p6_found"] if r[1] == 9} == {("sentences", 9, 9), ("articles", 9, 9)} and sum(r[:2] == ("sentences", 8) for r in q["p6_found"]) == 3999
    ids = dict(q["p8_ids"])
    assert ids[1] is None and ids[2] == [] and ids[9] == ids[10]
    assert dict(q["p10_redacted"])[1] is None and dict(q["p10_redacted"])[2] == ""
    assert dict((r[:2], r[2]) for r in q["p3_normalized"])[("sentences", 1)] is None


# 1 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(data):
    texts = [t for n in ("sentences", "page_texts") for t in pq.read_table(f"{data.replace('0.001', '0.01')}/{n}.parquet", columns=["text"]).column(0).to_pylist() if t]
    got = next(garbled._count([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    return garbled.PairModel(got.column(0).to_numpy(), got.column(1).to_numpy())


CLEAN = "Hội đồng quản trị vừa rà soát hệ thống lọc bụi quanh khu công nghiệp để giảm chi phí."


@pytest.mark.parametrize("charset", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_wrong_readings_are_found_and_undone(model, charset):
    wrong = CLEAN.encode()
    by = {b: c for c, b in garbled._bytes_of(charset).items()}
    text = "".join(chr(b) if b < 0x80 else by.get(b, "�") for b in wrong)
    fixed, bad = garbled.restore_text(model, text)
    assert bad and (fixed == CLEAN or "�" in text)
    assert garbled.suspicious(model, [text])[0]


def test_single_letter_charsets(model):
    back = {v: k for k, v in garbled.TCVN3.items()}
    assert garbled.restore_text(model, "".join(back.get(c, c) for c in CLEAN)) == (CLEAN, True)
    assert garbled.undo_vni("Hoäi ñoàng quaûn trò nöôùc") == "Hội đồng quản trị nước"
    for fine in (CLEAN, "Завод «Ñandú» ΔT = 2,5 °C ±5 µm № 7 © 2021", "环保部门去年关闭了员工宿舍。", "L’été a déjà coûté."):
        assert not garbled.restore_text(model, fine)[1], fine


# 3 ---------------------------------------------------------------------------------------


def test_one_form(spark):
    cases = {
        "ＡＢ１２": ("AB12", True), unicodedata.normalize("NFD", "Nguyễn Ướt ế"): ("Nguyễn Ướt ế", True), "so​ng": ("song", True), "a b": ("a b", True), "сао cao": ("cao cao".replace("c", "c", 1), True),
        "thƣờng Ɖội": ("thường Đội", True), "Завод Рудник": ("Завод Рудник", False), "Ελαία ΔT": ("Ελαία ΔT", False), "👩‍🌾 x² H₂O ！": ("👩‍🌾 x² H₂O ！", False), "q̣x": ("q̣x", False), "CΟ₂ νa": ("CO₂ va", True), "": ("", False),
        "ａ\U0001d401c": ("aBc", True), "x \U0001d465 y": ("x \U0001d465 y", False), unicodedata.normalize("NFD", "한국 공장"): ("한국 공장", True), "か\u3099ん": ("がん", True), "5 \u212a": ("5 K", True),
        "a\u202eb": ("ab", True), "\U00020000ａ": ("\U00020000a", True), "\u2126": ("\u2126", False), "한국": ("한국", False),
    }
    rows = spark.createDataFrame([((("articles", i), t)) for i, t in enumerate(cases)] + [(("articles", 99), None)], "key struct<source_table:string,row_id:int>, text string")
    found = {r.key.row_id for r in lookalike.unusual_rows(rows).collect()}
    fixed = {r.key.row_id: r.text for r in lookalike.normalized(rows).collect()}
    for i, (t, (want, case)) in enumerate(cases.items()):
        assert (fixed[i], i in found) == (want, case), t
    assert fixed[99] is None and 99 not in found


# 4 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, bits", [(256, 86), (2, 86), (256, None)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, bits):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(2, 80))]
        for _ in range(4):
            copy = base[:]
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0]]
    sets = [neardup.word_sets(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "ALIKE_BITS", bits)
    members, pairs = neardup.near_classes(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"))
    rep = {r.id: r.rep for r in members.collect()}
    alike = {(r.a, r.b) for r in pairs.collect()}
    got = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if rep[i] == rep[j] or (min(rep[i], rep[j]), max(rep[i], rep[j])) in alike}
    assert not got - want and len(want - got) <= 0.01 * len(want)


# 5 ---------------------------------------------------------------------------------------


REGISTRY = "ticker string, canonical_name string, core_tokens array<string>, aliases array<string>, exclusions array<struct<name:string,reason:string>>"


def test_names(spark):
    cores = ["Vân Giáp", "Lục Nguyệt", "Sương Tằm", "Trạch Nhiễu", "Cẩm Rộc", "Phù Đước", "Mạc Khê", "Nghi Kiều", "Hạc Bằng", "Thước Lũy", "Oanh Trà", "Dạ Viễn"]
    trades = [("Điện lực", "Power"), ("Cấp nước", "Water Supply"), ("Giấy", "Paper"), ("Mía đường", "Sugar")]
    registry, harvest = [], []
    for k, core in enumerate(cores):
        (vn, en), plain = trades[k // 3], lookalike.unicodedata.normalize("NFD", core.replace("Đ", "D").replace("đ", "d")).encode("ascii", "ignore").decode()
        far = k % 3 == 0  # some issuers carry a quality beside their trade
        aliases = [f"{vn} {core}", f"Công ty CP {vn} {core}"] + (["Vangiamex", "Công ty Cổ phần Đin lực Vân Giáp"] if k == 0 else [])
        tokens = plain.lower().split() + (["quoc", "te"] if far else [])
        registry.append((f"T{chr(65 + k)}XZ", f"Công ty Cổ phần {vn} {'Quốc tế ' if far else ''}{core}", tokens, aliases, [("Vân Giáp Logistics", "other")] if k == 0 else None))
        harvest += [f"{plain} {en} JSC", f"{vn} {core}", core, f"CTCP {core}", f"{core} Land", f"Quỹ {core}", f"Sở Tài nguyên {core}", f"{core} Holdings"] + ([f"{plain} International {en} Corp.", f"{vn} Quốc tế {core}"] if far else [])
    good = ("Van Giap International Power JSC", "CTCP Điện lực Vân Gipá", "Đ. Vân Giáp", "HOSE: TAXZ", "TAXZ_Baocaothuongnien", "Vangiammex VN", "Ddieenj luwcj Vaan Giaps", "Vân Giáp", "POWER  INTERNATIONAL VAN GIAP CO., LTD", "Điện 1ực Vân Giáp (*)", "Van Giap Powre")
    bad = ("Vân Giáp Land", "Bao bì Trạch Nhiễu", "Sở Tài nguyên tỉnh Vân Giáp", "Công ty", "", "!!", "Vân Giáp Holdings", "khách hàng", "Van Giap Sugar", "Vân Giáp Logistics", None)
    rows = [(n,) for n in (*harvest, *good, *bad)]
    got = {r.alias_name: r.ticker for r in names.attribute_names(spark.createDataFrame(rows, "alias_name string"), spark.createDataFrame(registry, REGISTRY)).collect()}
    assert {n: got.get(n) for n in good} == dict.fromkeys(good, "TAXZ")
    assert {n: got.get(n) for n in bad} == dict.fromkeys(bad)
    book = names.Registry([r[0] for r in registry], [[r[1], *r[3]] for r in registry], [r[2] for r in registry])
    first = names.Issuer(book, 0, names.Counter(), {})
    assert first.core == ("van", "giap") and first.brands == {"vangiamex"}


def test_mistyped_names_whatever_the_size_and_skew(spark):
    registry = spark.createDataFrame([("VGDW", "Công ty Cổ phần Điện lực Vân Giáp", ["van", "giap"], None, None)], REGISTRY)
    few = [("Điện lực Vân Giáp",), ("CTCP Điện lực Vân Gipá",)]  # an issuer seen once, and a typo of it
    hot = [("Vân Giáp Điện lực",)] * 60 + [("Điện lực Vân Gipá",)] * 40  # a misspelling as a hot key
    for rows in (few, hot):
        got = {r.alias_name: r.ticker for r in names.attribute_names(spark.createDataFrame(rows, "alias_name string"), registry).collect()}
        assert got == {r[0]: "VGDW" for r in rows}


# 6 ---------------------------------------------------------------------------------------


def test_sentence_breaks():
    def parts(t):
        at = [0, *sentences.breaks(t), len(t)]
        return [t[a:b].strip() for a, b in zip(at, at[1:])]

    whole = (
        "Đội vận hành đến TP. Huế lúc 7.30 sáng, gồm lò hơi, v.v. theo P. 5, Q. 9.", "“Công ty đóng cửa!” Bà Mai nói.", '"Our board audited it," Ms. Ilse said.', "«Ban vừa đến…» ông Tạ kể.", "“当地供应商登记了冷却塔。”一名股东说。",
        "III. TỦ SƠ CỨU", "Mục lục .............. 14", "Trang chủ | Video | Podcast", "the U.S. buyer", "See Fig. 6 and No. 3.", "a\nB. c", "",
    )
    for t in whole:
        assert sentences.breaks(t) == [], t
    assert parts("Một. Hai! Ba? 15 hộ dân… “Bốn.” Bà Tạ nói. Năm.Sáu") == ["Một.", "Hai!", "Ba?", "15 hộ dân…", "“Bốn.” Bà Tạ nói.", "Năm.", "Sáu"]
    assert parts("工厂去年关闭。项目组！同社は。") == ["工厂去年关闭。", "项目组！", "同社は。"]
    assert parts("โรงงานขาย สหภาพย้าย | บริษัท") == ["โรงงานขาย", "สหภาพย้าย | บริษัท"]
    assert parts("회사는 옮겼다. 공장은 미뤘다!") == ["회사는 옮겼다.", "공장은 미뤘다!"]
    assert parts('Xong! "Hai," ông A nói.') == ["Xong!", '"Hai," ông A nói.']


@pytest.mark.parametrize("text", ["यह बंद है। वह खुला है।", "هل أغلق المصنع؟ نعم أغلق.", "یہ بند ہے۔ وہ کھلا ہے۔", "Փակ է։ Բաց է։", "ተዘጋ። ተከፈተ።", "បិទ។ បើក។", "ပိတ်။ ဖွင့်။", "Đóng cửa‼ Mở lại.", "Đóng cửa⁇ Mở lại.", "Ｄóng cửa． Mở lại."])
def test_terminators_of_all_scripts(text):
    assert sentences.breaks(text) == [text.index(" ", 1 + next(i for i, c in enumerate(text) if c in "।؟۔։።។။‼⁇．")) + 1]


# 7 ---------------------------------------------------------------------------------------


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    told = boilerplate.fit_trees(x[:1500], y[:1500], rounds=30)
    told["features"] = None
    assert ((boilerplate.Trees(told).logits(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_blocks_decide_together():
    chars = np.full(5, 30.0)
    one = [1] * 5
    assert boilerplate.decode(np.array([3, 3, -0.3, 3, 3.0]), [0] * 5, one, chars).all()  # one weak line follows its block
    assert boilerplate.decode(np.array([3, 3, -6, 3, 3.0]), [0] * 5, one, chars).tolist() == [True, True, False, True, True]
    assert boilerplate.decode(np.array([3, 3, -0.1, 3, 3.0]), [0, 0, 1, 2, 2], one, chars).all()  # a weak block follows its zone
    assert boilerplate.decode(np.array([-3, -3, 0.1, -3, -3.0]), [0, 1, 2, 3, 4], [0, 0, 1, 2, 2], chars).tolist() == [False] * 5
    assert boilerplate.decode(np.array([-3, -3, 4, -3, -3.0]), [0, 1, 2, 3, 4], [0, 0, 1, 2, 2], chars).tolist() == [False, False, True, False, False]
    assert boilerplate.decode(np.zeros(0), [], [], np.zeros(0)).tolist() == []


def test_every_line_has_all_features(data):
    notice = "Trang này dùng cookie để cải thiện trải nghiệm và đo lượng truy cập; khi tiếp tục đọc, bạn đồng ý với chính sách cookie của chúng tôi và của các đối tác quảng cáo đã nêu trong phần lựa chọn dưới đây."
    assert len(notice) > 181
    x, _, _ = boilerplate.page_features(notice + "\n" + notice * 40, None, None, np.zeros(1 << boilerplate.SLOT_BITS, np.float32))
    cookie = boilerplate.FEATURES.index("cookie")
    assert x[0, cookie] == 2 and x[1, cookie] == 80 and boilerplate.fold("ﬁ Đội ｃookie") == "fi doi cookie"


def test_furniture(data):
    text = "Trang chủ | Video | Pháp luật\nChia sẻ bài viết này\n" + (CLEAN + " ") * 3 + "\nCookie không phải là thứ duy nhất bị thu thập: camera cổng cũng lưu mặt công nhân.\n" + (CLEAN + " ") * 2 + "\nTin liên quan\nNhà máy đóng cửa lò hơi quanh hồ để tiết kiệm điện\n© 2021 Báo X. Giữ bản quyền nội dung."
    x, blocks, zones = boilerplate.page_features(text, "Báo X", "baox.example", np.zeros(1 << boilerplate.SLOT_BITS, np.float32))
    assert (np.flatnonzero(boilerplate.decode(boilerplate.trees().logits(x), blocks, zones, x[:, 0])) + 1).tolist() == [1, 2, 6, 7, 8]


# 8, 9 ------------------------------------------------------------------------------------


def test_chunked_encoding_is_exact():
    encode = tokens.encoder(tokens.vocabulary())
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "a", "bc", "'s", "1", "22", "!", "…", "é", "ế", "ไ", "์", "日", "👩‍🌾", " ", "\t", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits[: rng.randint(2, 20)]) for _ in range(rng.randint(100, 3000))) for _ in range(150)] + ["a" * 9000, " " * 9000, "日本" * 5000, "\n \n" * 3000]
    for t in texts:
        chunks = tokens.cut_chunks(t)
        assert "".join(chunks) == t
        assert tokens.join_all([tokens.encoded(c, encode) for c in chunks], encode).tolist() == encode(t)


def test_shared_chunks(spark, monkeypatch):
    encode = tokens.encoder(tokens.vocabulary())
    base = " ".join(f"từ{i}" for i in range(900))
    docs = [(1, base), (2, base + " thêm"), (3, "khác " + base), (4, None), (5, ""), (6, base), (6, base)]
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted(((i, None if t is None else encode(t)) for i, t in docs), key=repr)


def test_packing():
    rng = random.Random(4)
    for n in (0, 1, 400):
        sizes = [min(100, max(1, int(rng.expovariate(1 / 25)))) for _ in range(n)]
        bins = packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= -(-sum(sizes) // 100) + 1
    assert len(packing.pack([60, 60, 40, 40, 30, 30, 40], 100)) == 3


def test_two_for_one_in_containers_of_many_items():
    # Only giving a 2 and a 3 (or the like) for the other container's 6 fills the first one; it holds 60 items.
    sizes = [2] * 30 + [3] * 30 + [6] + [50]
    bins = [list(range(60)), [60, 61]]
    packing.improve(bins, sizes, 151)
    assert sum(sizes[i] for i in bins[0]) == 151 and sorted(i for b in bins for i in b) == list(range(62))


def test_documents_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CONTAINERS", 5)
    rows = packing.pack_documents(spark.createDataFrame([(None, 40)] * 100 + [(7, 60)] * 100, "doc_id bigint, n_tokens int"), spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int")).collect()
    assert len(rows) == 200 and len({r.container_id.split("-")[2] for r in rows}) > 5


def test_packing_splits_only_what_must_be(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CONTAINERS", 3)
    sizes = [(i, (i * 37) % 90 + 1) for i in range(1, 200)] + [(500, 345), (501, 200), (502, None), (503, 0)]
    rows = packing.pack_documents(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), spark.createDataFrame([(1, 100), (2, None)], "spec_id int, capacity_tokens int")).collect()
    fill, parts = {}, {}
    for r in rows:
        parts[r.doc_id] = parts.get(r.doc_id, 0) + r.n_tokens
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert parts == {i: n or 0 for i, n in sizes} and max(fill.values()) <= 100
    assert {r.doc_id for r in rows if r.part} == {500, 501} and {r.doc_id for r in rows if r.container_id is None} == {502, 503}
    assert sum(fill.values()) / (100 * len(fill)) > 0.97


# 10 --------------------------------------------------------------------------------------


def test_mentions():
    text = "Người khiếu nại là bà Ngô Văn Rộc Uyển, CCCD số 024 611 562, thường trú tại số 262/37 Vân Đài, xã Mạc Gạo, huyện Lục Bằng. Liên hệ Doãn Quyến Phác, điện thoại 0543 401294, thư điện tử vu-nhieu60[@]mail-lam.example để nhận hồ sơ gốc. Mã số thuế 0311018874 của doanh nghiệp được công khai. Quỹ Nguyễn Khoáng tài trợ."
    (got,) = pii.mentions_of([text])
    assert [(k, text[a:b]) for k, a, b in got] == [
        ("name", "Ngô Văn Rộc Uyển"), ("id", "024 611 562"), ("address", "262/37 Vân Đài, xã Mạc Gạo, huyện Lục Bằng"), ("name", "Doãn Quyến Phác"), ("phone", "0543 401294"), ("email", "vu-nhieu60[@]mail-lam.example"),
    ]
    assert pii.mentions_of(["", "x", "7" * 3000]) == [[], [], []]


@pytest.mark.parametrize("sign", ["lien.he＠congty.example", "lien.he [AT] congty.example", "lien.he at congty chấm com", "lien.he at congty [dot] com", "lien.he (At) congty.example", pytest.param("lien.he a còng congty dot com", marks=pytest.mark.xfail(reason="the network doesn't know this mixture of languages before a short ending")), "lien.he a còng congty chấm com", "lien.he a còng congty [dot] com"])
def test_disguised_addresses(sign):
    text = f"Mọi góp ý xin gửi về {sign}, trước thứ sáu."
    assert [(k, text[a:b]) for k, a, b in pii.mentions_of([text])[0]] == [("email", sign)]


def test_no_mention_is_cut():
    email = ".".join(["phong-tiep-nhan", "ho-so-khieu-nai", "van-phong-dai-dien", "cum-cong-nghiep", "xa-mac-gao", "huyen-luc-bang"]) + "@congty.example"
    address = "262/37 Vân Đài, " + ", ".join(["xã Mạc Gạo", "huyện Lục Bằng", "tỉnh Vọng Sậy"] * 8)
    for kind, said, ahead in (("email", email, "Mọi góp ý xin gửi về "), ("address", address, "Bà Ngô Văn Rộc thường trú tại số ")):
        text = "Đoàn thanh tra đã rà soát trạm cân. " * 5 + ahead + said + "\nHồ sơ gốc lưu tại xã."
        assert len(said) > 100 and (kind, said) in [(k, text[a:b]) for k, a, b in pii.mentions_of([text])[0]]


@pytest.mark.parametrize("text, name", [("Hôm đó the auditor José García signed the minutes.", "José García"), ("Kiểm toán viên Hứa Quyến ký biên bản sáng nay.", "Hứa Quyến"), ("That day our engineer Ann Lee measured it again.", "Ann Lee"), ("Kế toán Đàm Phương Uyển gửi hồ sơ.", "Đàm Phương Uyển")])
def test_names_after_roles(text, name):
    assert ("name", name) in [(k, text[a:b]) for k, a, b in pii.mentions_of([text])[0]]


def test_windows_agree_with_the_whole_text():
    text = "Người khiếu nại là bà Ngô Văn Rộc Uyển, điện thoại 0543 401294. " * 40
    (got,) = pii.mentions_of([text])
    assert [k for k, _, _ in got] == ["name", "phone"] * 40


def test_names_beside_the_listed_surnames(data):
    from lamina.llm import train_pii

    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist() if t and any(s[0] == "name" for s in train_pii.spans(t))]
    hit = missed = 0
    for name in ("Hứa Quyến", "Đàm Uyển", "José García", "Ann Lee"):
        for t in texts:
            a, b = next(s[1:] for s in train_pii.spans(t) if s[0] == "name")
            got = pii.mentions_of([t[:a] + name + t[b:]])[0]
            found = ("name", a, a + len(name)) in got
            hit, missed = hit + found, missed + (not found)
    assert hit and missed / (hit + missed) < 0.03, (hit, missed)


def test_held_out_accuracy(data):
    from lamina.llm import train_pii

    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    hit = missed = extra = 0
    for t, got in zip(texts, pii.mentions_of(texts)):
        want = set(train_pii.spans(t))
        hit, missed, extra = hit + len(want & set(got)), missed + len(want - set(got)), extra + len(set(got) - want)
    assert hit and (missed + extra) / hit < 0.05


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(3)
    e, moves = rng.normal(size=(4, 4, pii.TAGS)).astype(np.float32), np.where(pii.allowed(), 0.0, -1e4)
    lengths = np.array([4, 3, 1, 4])
    got = pii.viterbi(e, lengths, moves)
    for n in range(4):
        best = max(itertools.product(range(pii.TAGS), repeat=int(lengths[n])), key=lambda p: sum(e[n, t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) - 1e4 * (p[0] % 2 == 0 and p[0] > 0))
        assert tuple(got[n, : lengths[n]]) == best


def test_only_windows_that_may_hold_a_mention_are_decoded(data, monkeypatch):
    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    texts += ["Đoàn thanh tra đã rà soát trạm cân. " * 200, "7" * 3000, "a.b" * 700 + "@congty.example", "Bà Ngô Văn Rộc Uyển " * 100, "\0" * 600]
    decoded, viterbi = [0], pii.viterbi

    def counted(emissions, lengths, moves):
        decoded[0] += len(emissions)
        return viterbi(emissions, lengths, moves)

    monkeypatch.setattr(pii, "viterbi", counted)
    got, some = pii.mentions_of(texts), decoded[0]
    windows = len(pii.lay_out(texts)[0]) // pii.STRIDE
    assert any(got) and some < 0.6 * windows
    monkeypatch.setattr(pii, "coverable", lambda core, moves: np.ones(core.shape[2], bool))
    assert pii.mentions_of(texts) == got and decoded[0] - some >= windows


@pytest.mark.parametrize("seed", range(12))
def test_windows_left_undecoded_have_no_mention_on_the_best_path(seed):
    rng = np.random.default_rng(seed)
    moves = np.where(pii.allowed(), rng.normal(-1, 1, (pii.TAGS, pii.TAGS)), -1e4).astype(np.float32)
    moves[0, 0] = 0
    core = rng.normal(0, 1, (pii.STRIDE, pii.TAGS, 40)).astype(np.float32)
    core[:, 0] += rng.uniform(2, 9, 40)  # some windows nearer to having mentions than others
    e = np.tile(np.array([0.0] + [-30.0] * (pii.TAGS - 1), np.float32), (1, 40 * pii.STRIDE + 2, 1))  # O before and after
    e[0, 1:-1] = core.transpose(2, 0, 1).reshape(-1, pii.TAGS)
    (tags,) = pii.viterbi(e, np.array([e.shape[1]]), moves)
    held = (tags[1:-1] > 0).reshape(40, -1).any(1)
    may = pii.coverable(core, moves)
    assert may[held].all() and held.any() and not may.all()


def test_gradients():
    from lamina.llm import train_pii

    rng = np.random.default_rng(5)
    e, y, moves = rng.normal(size=(2, 5, pii.TAGS)).astype(np.float32), rng.integers(0, pii.TAGS, (2, 5)), rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    _, de, dm = train_pii.crf(e, y, moves)
    for k in range(6):
        d = np.zeros_like(e)
        d[k % 2, k % 5, k] = 0.05
        assert abs((train_pii.crf(e + d, y, moves)[0] - train_pii.crf(e - d, y, moves)[0]) / 0.1 - de[k % 2, k % 5, k]) < 2e-2
