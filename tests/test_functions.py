from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from leafline.functions import images, markdown, similarity, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


@pytest.mark.parametrize("t, want", [("hello big world", "en"), ("中文 文字 內容", "zh"), ("a 中", "mixed"), ("123", "unknown"), ("", "unknown"), (None, "unknown")])
def test_language(spark, t, want):
    assert one(spark, text.detect_language(F.col("t")), t) == want


def brute_chunks(t, size, overlap):
    if len(t) <= size:
        return [t] if t else []
    out, held = [], ""
    for s in [s.strip() for s in re.split(r"[.!?;]", t) if s.strip()]:
        joined = f"{held} {s}" if held else s
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        held = s
        if len(s) > size:
            out += [s[i : i + size] for i in range(0, len(s), size - overlap)]
            held = ""
    return out + [held] if held else out


@pytest.mark.parametrize("t", ["", "short.", "One two. " * 30, "x" * 95 + ". tail here. " + "y" * 15, "a. " * 50])
def test_sentence_chunks(spark, t):
    assert one(spark, text.sentence_chunks(F.col("t"), 40, 10), t) == brute_chunks(t, 40, 10)


def test_fixed_chunks(spark):
    assert one(spark, text.chunks(F.col("t"), 4, 1), "abcdefghij") == ["abcd", "defg", "ghij", "j"]
    assert one(spark, text.chunks(F.col("t"), 4, 1), "") == [] and one(spark, text.chunks(F.col("t"), 4, 1), None) is None
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 4, 4)


def test_keywords_break_ties_by_first_place(spark):
    df = spark.createDataFrame([(1, "beta alpha beta the alpha gamma x"), (2, None), (3, "")], "k int, t string")
    assert [(r["word"], r["n"], r["rank"]) for r in text.keywords(df, "k", "t").orderBy("k", "rank").collect()] == [("beta", 2, 1), ("alpha", 2, 2), ("gamma", 1, 3)]


@pytest.mark.parametrize("name, want", [('a<b>:"c.txt', "a_b_c.txt"), ("___", "untitled"), ("", "untitled"), (None, "untitled"), ("a-0x1f.md", "a-0x1f.md"), ("n" * 300 + ".pdf", "n" * 251 + ".pdf")])
def test_file_names(spark, name, want):
    assert one(spark, text.sanitize_filename(F.col("t")), name) == want


@pytest.mark.parametrize("t, want", [("a@b.org", True), ("a@b", False), (f"{'a' * 65}@b.org", False), (f"a@{'b' * 64}.org", False), ("a b@c.org", False), (None, False)])
def test_addresses(spark, t, want):
    assert one(spark, text.is_email(F.col("t")), t) is want


def test_urls_and_sanitising(spark):
    assert one(spark, text.urls(F.col("t")), "see https://a.org/x?y=1 and http:// or ftp://b") == ["https://a.org/x?y=1"]
    assert one(spark, text.sanitize(F.col("t")), "a\x00<b>c</b>  d\n e") == "ac d e"
    assert one(spark, similarity.clean_text("t"), "<p>ﬁne &amp; Ａ</p> x") == "fine & A x"
    assert one(spark, similarity.clean_text("t"), None) is None


def test_markdown(spark):
    md = "# T\n\n**b** *i* [l](u) ![alt](p)"
    assert one(spark, markdown.to_text(F.col("t")), md) == "T\n\nb i l !alt"
    assert one(spark, markdown.tidy(F.col("t")), "a  \r\n\r\n\r\n\r\nb\n\n") == "a\n\nb\n"
    assert one(spark, markdown.slug(F.col("t")), "A  b: c_d") == "a-b-c-d"
    rows = spark.range(1).select(markdown.table_markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1"), F.lit(None).cast("string"))))).first()[0]
    assert rows == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_comments_round_trip(spark):
    df = spark.sql("select array(named_struct('text_block_id', 't1', 'image_id', 'i1', 'final_score', 0.5D, 'association_type', 'caption'), named_struct('text_block_id', 't2', 'image_id', 'i2', 'final_score', 0.25D, 'association_type', 'spatial')) a")
    assert df.select(markdown.parse_comments(markdown.association_comments(F.col("a")))).first()[0] == df.first()[0]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [[None if x is None else round(x, 6) for x in r] for r in df.select(similarity.cosine(F.col("a"), F.col("b")), similarity.scaled_cosine(F.col("a"), F.col("b"))).collect()] == [[0.0, 0.5], [1.0, 1.0], [None, 0.0]]


def test_image_facts(spark):
    row = spark.sql("select 2400 w, 600 h, X'FFD8FF' j, X'89504E470D' p").select(images.fit(F.col("w"), F.col("h")), images.image_format(F.col("j")), images.image_format(F.col("p"))).first()
    assert (tuple(row[0]), row[1], row[2]) == ((1200, 300), "jpeg", "png")
