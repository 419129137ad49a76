"""Hand-made cases for the scalar text functions (FIXTURES §3)."""

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.sources import corpus as C


def one(spark, col, *vals, schema="t string"):
    df = spark.createDataFrame([(v,) for v in vals], schema)
    return [r[0] for r in df.select(col(F.col("t"))).collect()]


def test_paragraph_scan(spark):
    df = spark.createDataFrame([(1, "en", "a\n\n\nb"), (2, "en", "a\nb"), (3, "en", " \n ")], "doc_id long, lang string, text string")
    got = sorted((r.doc_id, r.text) for r in C.paragraph_scan(df).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_escapes_and_markers(spark):
    assert one(spark, T.remove_escapes, "x\\xe9y", "a\\nb", "\\xab1z", "q�r") == ["xy", "ab", "z", "qr"]
    assert one(spark, T.remove_markers, "a_NEWLINE_b", "_START_ARTICLE_x") == ["ab", "x"]


def test_cjk_filter(spark):
    assert one(spark, lambda t: T.cjk_filter(t, "ja"), "abc、日本!") == ["abc日本"]
    assert one(spark, lambda t: T.cjk_filter(t, "de"), "a!") == ["a!"]


def test_keep_text(spark):
    got = one(spark, T.keep_text, "abcdefghi", "abcdefghij", "1234567890", None)
    assert got == [False, True, False, False]


def test_strip_is_python_strip(spark):
    s = "　\x1c a b  \x85"
    assert one(spark, T.py_strip, s) == [s.strip()]


def test_script_tag(spark):
    got = one(spark, T.script_tag, "Hello 안", "日本", "日本の", "Привет", "é")
    assert got == ["ko", "zh", "ja", "cyr", "other"]


def test_language_label(spark):
    df = spark.createDataFrame([("日本", "ja", "xx"), ("hello ж", "ru", "en"), ("Привет", "de", "xx"), ("  ", "de", "en"),
                                ("hello world", "de", "en"), ("hallo welt", "de", "de")], "t string, tgt string, det string")
    got = []
    for r in df.collect():
        d1 = spark.createDataFrame([(r.t, r.det)], "t string, det string")
        got.append(d1.select(T.language_label(F.col("t"), r.tgt, F.col("det"))).first()[0])
    assert got == ["unknown", "ru", "unknown", "unknown", "en", "de"]


def test_mixture_name_and_ratio(spark):
    names = ["mix_isolated_zh-cn_95_5.txt", "mix_slavic_ru_99.9_0.1.txt", "demo.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    p = T.parse_mixture_name(F.col("p"))
    got = [tuple(r) for r in df.select(p["group"], p["target_lang"], p["ratio"]).collect()]
    assert got == [("isolated", "zh-cn", "95_5"), ("slavic", "ru", "99.9_0.1"), ("unknown", "custom", "unknown")]
    got = one(spark, T.ratio_target_percent, "99.9_0.1", "90_10", "unknown", "a_b")
    assert got == [0.1, 10.0, None, None]


def test_language_group(spark):
    assert one(spark, T.language_group, "de", "ru", "ja", "fr") == ["germanic", "slavic", "isolated", "custom"]


def test_repair(spark):
    df = spark.createDataFrame([("cafÃ©",), ("&lt;b&gt; ﬁne ＡＢ ‘x’",), ("<p>&amp;</p>",)], "text string")
    got = [r[0] for r in T.repair_text_frame(df).collect()]
    assert got == ["café", "<b> fine AB 'x'", "<p>&amp;</p>"]


def test_force_decode(spark):
    got = one(spark, T.force_decode, "b'caf\\xc3\\xa9'", "plain")
    assert got == ["café", "plain"]


def test_word_count(spark):
    assert one(spark, T.word_count, " a  b　c ", "", "x") == [3, 0, 1]
