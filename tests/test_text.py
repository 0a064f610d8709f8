import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as t

GOLDEN = [
    ("lib_core.core_rms_norm 2.10.0+cpu 中文字符", "lib_core.core_rms_norm lib_core lib core core_rms_norm rms norm 2.10.0+cpu cpu 中文 文字 字符"),
    ("DataCopyPad", "datacopypad data copy pad"),
    ("XMLGraph HTTPServer2", "xmlgraph xml graph httpserver2 http server"),
    ("laneSynchronizeStream", "lanesynchronizestream lane synchronize stream"),
    ("Part910B4_lane", "part910b4_lane part910b4 part 910b4 lane"),
    ("_x__y_ 3d host-7:80", "_x__y_ 3d host-7:80 host"),
    ("plain word2 单", "plain word2 单"),
    ("", ""),
]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def test_terms_by_golden_pairs(spark):
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(GOLDEN)], "n int, text string, want string")
    for r in df.select("text", "want", t.terms("text").alias("got")).collect():
        assert r["got"] == r["want"].split(), r["text"]
    assert one(spark, t.terms("text"), None) is None
    name = "space." + "a" * 20_000
    assert one(spark, t.terms("text"), name) == [name, "space", "a" * 20_000]


@pytest.mark.parametrize("text", ["héllo wörld 中文" * 30, " \x85\u0085é" * 40, "🤖" * 100, "", "abc"])
@pytest.mark.parametrize("budget", [1, 3, 16])
def test_byte_excerpt(spark, text, budget):
    assert one(spark, t.byte_excerpt("text", budget), text) == text.encode()[: 4 * budget].decode("utf-8", "ignore")


@pytest.mark.parametrize("boundary", ["\n\n", "\n"])
def test_lossless_pieces(spark, boundary):
    text = ("中文 and words.\n\n" * 40 + "x" * 700 + "🤖" * 90 + "\n") * 3
    got = one(spark, t.lossless_pieces("text", 256, boundary), text)
    assert "".join(got) == text and max(len(p.encode()) for p in got) <= 256
    assert got[0].endswith(boundary)


def test_small_functions(spark):
    row = spark.createDataFrame([("85%", "qx/a@0f1:b/c.md", "E12 Bad-Token!", 4)], "c string, l string, g string, n int").select(
        t.share_of("c"), t.locator("l"), t.normal_trigger("g"), t.delay("n", 30.0, 100.0), t.token_estimate("c")
    )
    share, place, trigger, wait, tokens = row.first()
    assert (share, tuple(place), trigger, wait, tokens) == (0.85, ("qx/a", "0f1", "b/c.md"), "e12 bad token", 100.0, 1)
    for text, want in [("85", 0.85), ("0.4", 0.4), ("high", None), ("900", None), (None, None)]:
        assert one(spark, t.share_of("text"), text) == want


def test_term_window(spark):
    text = "x" * 300 + " Because " + "y" * 2000
    got = one(spark, t.term_window("text", F.lit("because")), text)
    assert got.startswith("…") and "Because" in got and len(got) == 1201
