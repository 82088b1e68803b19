"""Work that grows with the length of a text, not with its square."""

import re
import time

from pyspark.sql import functions as F

from spotflow.llm import line_dedup, main_text, secrets

MANY = 100_000


def test_line_dedup_of_very_many_lines(spark):
    body = "\n".join(f"line number {i}" for i in range(MANY))
    rows = [(1, body), (2, "start\n" + body + "\nend"), (3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, seams=True).collect()}
    assert time.time() - before < 60
    assert got[1].n_removed == 0 and got[1].kept_text == body
    assert got[2].kept_text == "start\nend" and got[2].n_removed == MANY
    assert got[3].kept_text == "a\nb"


def test_spans_of_very_many_matches(spark):
    text = " ".join(f"é token=abc{i:06d} x" for i in range(MANY))
    docs = spark.createDataFrame([(1, text), (2, "token=abcdef"), (3, None), (4, "no match")], "doc_id long, text string")
    before = time.time()
    spans = secrets.base_spans(F.coalesce("text", F.lit("")))
    got = {r.doc_id: r.s for r in docs.select("doc_id", spans.alias("s")).collect()}
    assert time.time() - before < 30
    assert [(x.start, x.end) for x in got[1]] == [m.span() for m in re.finditer("token=[a-z0-9]+", text)]
    assert [(x.start, x.end) for x in got[2]] == [(0, 12)] and got[3] == [] and got[4] == []


def test_tokens_beside_very_many_base_spans(spark):
    words = [f"token=abc{i:06d} Qz7Kp9Xv2Lm4Rt6Wy8{i:06d}" for i in range(20_000)]
    text = " ".join(words)
    base = secrets.base_spans(F.col("text"))
    tokens = secrets._spans(F.col("text"), "random", secrets.TOKEN, lambda v: v.rlike("[0-9]"))
    docs = spark.createDataFrame([(text,), ("token=abcdefabcdefabcdefabcdef1",), ("none",)], "text string")
    before = time.time()
    found = docs.select("text", base.alias("base"), tokens.alias("tokens"))
    free = [r.f for r in found.select(secrets._free(F.col("tokens"), F.col("base")).alias("f")).collect()]
    assert time.time() - before < 60
    assert [(x.start, x.end) for x in free[0]] == [m.span() for m in re.finditer("Qz[A-Za-z0-9]+", text)]
    assert free[1] == [] and free[2] == []


def test_very_many_open_tags():
    page = "<article>" + "<b>" * MANY + "word " + "</i></b>" * MANY + "<figure><figcaption>seen</figcaption></figure></article>"
    before = time.time()
    names = [n for n, _, _ in main_text.tokens(page)]
    assert time.time() - before < 30
    assert names.count("/b") == MANY


def test_captions_of_an_article_stay():
    page = "<nav>menu here</nav><article><p>one two three</p><figure><figcaption>a caption</figcaption></figure><p>four five six</p></article>"
    weights = main_text.Weights(1.0, {"nav": -2.0}, -0.1)
    assert main_text.extract(page, weights) == "one two three\n\na caption\n\nfour five six"
