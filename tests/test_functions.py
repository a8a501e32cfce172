"""Column functions against literal cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions import folds, geometry, text, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_tokens(spark):
    c = text.tokens("t")
    assert one(spark, c, t=("string", "KO8G 取消结转 a_b-c 项")) == ["ko8g", "a_b-c", "取消", "消结", "结转", "项"]
    assert one(spark, c, t=("string", None)) == []


def test_clean_lines(spark):
    r = one(spark, text.clean_lines("t"), t=("string", "大集中 ERP 项目\n第 10 页 共 152 页\n步骤 4：\n选择 C700，不能选择2100\n01 不填写过账日期"))
    assert len(r["removed"]) == 2
    assert r["text"] == "步骤 4：\n选择 C700，不能选择2100\n01 不填写过账日期"
    r = one(spark, text.clean_lines("t"), t=("string", "2100\n01"))
    assert (r["text"], r["removed"]) == ("2100\n01", [])


def test_xml_text(spark):
    assert one(spark, text.xml_text("t"), t=("string", "不得\x00冲销\nCJ88\t01")) == "不得\ufffd冲销\nCJ88\t01"


def test_parse_pages(spark):
    c = text.parse_pages(F.col("s"), F.col("n"))
    assert one(spark, c, s=("string", "3-5,5,8"), n=("int", 10)) == [3, 4, 5, 8]
    for bad in ("0", "8-11", "9-2"):
        with pytest.raises(PySparkException):
            one(spark, c, s=("string", bad), n=("int", 10))


def test_faq_fields(spark):
    got = one(spark, text.faq_fields("t"), t=("string", "核算常见问题\n解决办法：选择01不输入过账日期；选择02必须输入。 问题描述：凭证冲销"))
    assert got == {"解决办法": "选择01不输入过账日期；选择02必须输入。", "问题描述": "凭证冲销"}
    got = one(spark, text.faq_fields("t"), t=("string", "问题描述：一\n二。\n三\n1、四 问题描述：五"))
    assert got == {"问题描述": "五"}


@pytest.mark.parametrize(
    ("name", "topic"),
    [("0.财务月结操作手册.pdf", "财务月结操作手册"), ("1.原油生产入库.pdf", "原油生产入库"), ("MDG.4.1-物料_V1.2终.pdf", "物料"), ("DJZ_MDG_用户操作手册-公司 (2).pdf", "公司"), (None, "")],
)
def test_filename_topic(spark, name, topic):
    assert one(spark, text.filename_topic("n"), n=("string", name)) == topic


def test_names(spark):
    got = one(spark, text.aliases(F.array(F.lit("财务月结业务流程")), F.lit("财务月结操作手册")))
    assert got == ["财务月结业务流程", "财务月结操作手册", "财务月结"]


def test_page_label(spark):
    assert one(spark, text.page_label(F.col("p")), p=("array<int>", [5, 1, 2, 3, 2])) == "1–3、5"


def test_headings(spark):
    assert one(spark, text.heading_number(F.lit("1.2.3 标题"))) == "1.2.3"
    assert one(spark, text.heading_number(F.lit("标题"))) == ""
    assert one(spark, text.ignored_heading(F.lit(" 目 录 "))) and one(spark, text.ignored_heading(F.lit("12.3 ——")))
    assert not one(spark, text.ignored_heading(F.lit("漢字")))


@pytest.mark.parametrize(("n", "offsets"), [(0, [0]), (300, [0]), (301, [0, 240]), (541, [0, 240, 480])])
def test_windows(spark, n, offsets):
    assert one(spark, text.window_offsets(F.lit(n))) == offsets


def test_window_bounds():
    with pytest.raises(ValueError):
        text.window_offsets(F.lit(1), 400, 60)


def test_paths(spark):
    safe = lambda p: one(spark, text.safe_relative(F.col("p")), p=("string", p))
    assert safe("a\\b.PDF") == "a/b.PDF"
    assert [safe(p) for p in ("/a.pdf", "../a.pdf", "a.txt", "C:\\a.pdf")] == [None] * 4
    assert one(spark, text.source_identity(F.lit("X\\Y.pdf"), F.lit(None).cast("string"), F.lit(""))) == "x/y.pdf"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vectors.normalized(a)) == pytest.approx([0.6, 0.8])
    for bad in ([], [0.0, 0.0], [float("nan")], [float("inf")], [None], None):
        assert one(spark, vectors.is_valid(F.col("v")), v=("array<double>", bad)) is False


def test_boxes(spark):
    clamp = lambda *x: one(spark, geometry.clamp_box(*[F.lit(float(v)) for v in x], F.lit(100.0), F.lit(200.0)))
    assert clamp(-1, 2, 101, 210) == [0, 2, 100, 200]
    assert clamp(5, 5, 5, 9) is None
    assert one(spark, geometry.polygon_box(F.col("p")), p=("array<array<double>>", [[1.0, 5.0], [3.0, 2.0]])) == [1, 2, 3, 5]
    boxes = [[0.0, 0.0, 1.0, 1.0], [1.0, 1.0, 2.0, 2.0], [9.0, 9.0, 9.0, 9.0]]
    assert one(spark, geometry.distinct_boxes(F.col("b")), b=("array<array<double>>", boxes)) == [boxes[0], boxes[2]]


def test_folds(spark):
    items = [(4, 1), (7, 1), (3, 1), (20, 1), (1, 1)]
    assert one(spark, folds.pack_groups(F.col("i"), 10, 2), i=("array<struct<size:bigint,count:bigint>>", items)) == [1, 2, 2, 3, 4]
    assert one(spark, folds.within_budget(F.col("s"), 10), s=("array<bigint>", [6, 5, 4, 1])) == [True, False, True, False]


def test_token_count(spark):
    for t in ("KO8G 取消结转 a_b-c 项", "", None, "a--b _c", "漢"):
        assert one(spark, text.token_count("t"), t=("string", t)) == len(one(spark, text.tokens("t"), t=("string", t)))
