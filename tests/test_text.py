from pyspark.sql import functions as F

from boscograph.functions import cleaning as X
from boscograph.functions.text import fold, is_stated, n_tokens


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean_and_width(spark):
    c = F.col("t")
    got = values(spark, [(" a\r\nb\rc\n\n\n\nd\x07 ",), (None,), ("",)], "t string", X.clean(c))
    assert got == [("a\nb\nc\n\nd",), (None,), ("",)]
    assert values(spark, [("ＡＢ（１）　。",)], "t string", X.half_width(c)) == [("AB(1) 。",)]
    assert values(spark, [(" a\t\n b  ★",)], "t string", X.normalise(c), X.normalise(c, True)) == [("a b ★", "a b")]


def test_fold_and_stated(spark):
    rows = [("  Pinus   Sp ",), ("N/A",), ("?",), ("  ",), (None,), ("未知",), ("\ta",)]
    got = values(spark, rows, "t string", fold(F.col("t")), is_stated(F.col("t")), n_tokens(F.col("t")))
    assert got[0] == ("pinus sp", True, 13)
    assert [g[1] for g in got] == [True, False, False, False, False, False, True]
    assert got[4][2] == 0 and got[5][2] == 6


def test_windows(spark):
    text = "x" * 6000
    got = values(spark, [(text,), ("",), (None,), ("y" * 50,), ("z" * 51,)], "t string", F.transform(X.windows(F.col("t")), lambda w: F.length(w.text)))
    assert got == [([3000, 3000, 600],), ([],), (None,), ([],), ([51],)] or got == [([3000, 3000, 600],), ([],), ([],), ([],), ([51],)]


def test_sentences_headers_references(spark):
    assert values(spark, [("First one here. Second! 三。  四五六七八。 ok.",)], "t string", X.sentences(F.col("t"))) == [(["First one here.", "Second!", "四五六七八。"],)]
    lines = ["第 3 页", "Page 12/30", "林业学报", "some text of a paper", "3 / 9x", "=====", "Abstract of it"]
    got = values(spark, [(x,) for x in lines], "t string", X.is_header(F.col("t")))
    assert [g[0] for g in got] == [True, True, False, False, False, True, True]  # "林业学报" is shorter than 5
    text = "\n".join(["a"] * 9 + ["References", "[1] x"])
    early = "\n".join(["References"] + ["a"] * 9)
    got = values(spark, [(text,), (early,)], "t string", F.size(X.cut_references(X.lines(F.col("t")))))
    assert got == [(9,), (10,)]


def test_sections_and_tables(spark):
    md = "intro\n# One\na [link](u)\n\n## Two\nb ![p](q) $x$ c\n# References\n[1] z"
    got = values(spark, [(md,)], "t string", X.sections(F.col("t")), X.assemble(X.sections(F.col("t"))))[0]
    assert [(s.level, s.title, s.content) for s in got[0]] == [(0, "", ["intro"]), (1, "One", ["a link"]), (2, "Two", ["b !p  c"]), (1, "References", ["[1] z"])]
    assert got[1] == "intro\n\n# One\n\na link\n\n## Two\n\nb !p  c"
    head, rows = F.array(F.lit("h"), F.lit("k")), F.array(F.array(F.lit("1"), F.lit("")), F.array(F.lit(""), F.lit("")))
    assert values(spark, [(1,)], "i int", X.table_sentences(head, rows)) == [(["h为1。"],)]


def test_snippets(spark):
    got = values(spark, [("ab cat cd cat", "cat"), ("none", "cat"), ("a.c abc", "a.c")], "t string, e string", X.snippets(F.col("t"), F.col("e"), 2))
    assert got == [(["b cat c", "d cat"],), ([],), (["a.c a"],)]


def test_table_text(spark):
    rows = [("温度为20；湿度为高。",), ("只有一个为例。",), ("| a | b |\n表格内容： x",), (None,)]
    assert values(spark, rows, "t string", X.rewrite_table_text(F.col("t"))) == [("温度是20，湿度是高。",), ("只有一个为例。",), ("\nx",), (None,)]
