import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.functions.vectorised import SPLIT, fnv1a

#: Fixed: hashes that every implementation of the format must give.
GOLDEN = {
    "hello": 1335831723, "world": 933488787, "the": 3020861980, "__label__en": 3409607150, "</s>": 3617362777, "<hello>": 2645112597,
    "<world>": 1733137405, "": 2166136261, "a": 3826002220, "test": 2949673445, "language": 3119462523, "identification": 2989260379, "<": 957132539, ">": 990687777,
    "en": 1092248970, "fr": 1461901041, "de": 1545391778, "<he": 1133188580, "<hel": 3690128664, "hel": 179613742, "hell": 477198310, "ell": 1585992344, "ello": 3348798165,
    "llo": 928617342, "llo>": 1644350912, "lo>": 2253504790, "café": 1970454601,
}


def test_golden_hashes(spark):
    rows = spark.createDataFrame([(w,) for w in GOLDEN], "w string").select("w", C.fnv1a(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == GOLDEN
    assert {w: fnv1a(w.encode()) for w in GOLDEN} == GOLDEN


def test_bytes_are_sign_extended():
    assert fnv1a(b"\x80") == (2166136261 ^ 0xFFFFFF80) * 16777619 % 2**32


def test_ngrams_by_start_then_length(spark):
    row = spark.createDataFrame([("hello",)], "w string").select(C.char_ngrams(F.col("w"), 3, 4).alias("g"), C.char_ngrams(F.col("w"), 1, 1).alias("one")).first()
    assert row.g == ["<he", "<hel", "hel", "hell", "ell", "ello", "llo", "llo>", "lo>"]
    assert row.one == list("hello")


def test_white_space_is_unicodes(spark):
    space = "\t\n\x0b\x0c\r \x85\xa0               　"
    other = "\x00\x1c\x1d\x1e\x1f᠎​⁠﻿"
    texts = [f"a{c}b" for c in space + other] + ["", "  ", " a "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.tokens(F.col("t")).alias("t")).orderBy("i").collect()
    assert [len(r.t) for r in rows] == [3] * len(space) + [2] * len(other) + [1, 1, 2]
    assert [r.t[:-1] for r in rows] == [SPLIT.findall(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**32 - 1)] * 3), min_size=20, max_size=40), st.integers(1, 2**31 - 1))
def test_ngram_limbs_equal_big_integers(spark, rows, bucket):
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", C.ngram_bucket([F.col("a"), F.col("b"), F.col("c")], bucket).alias("h")).collect()
    for r in got:
        assert r.h == (((r.a * 116049371 + r.b) % 2**64 * 116049371 + r.c) % 2**64) % bucket


def test_sigmoid_and_log(spark):
    rows = spark.createDataFrame([(x,) for x in (-9.0, -8.0, 0.0, 8.0, 9.0)], "x double").select(C.sigmoid(F.col("x")).alias("s"), C.std_log(F.abs("x")).alias("l")).collect()
    assert rows[0].s == 0 and rows[4].s == 1 and abs(rows[2].s - 0.5) < 1e-12 and 0 < rows[1].s < 1
    assert abs(rows[2].l - np.log(1e-5)) < 1e-12
