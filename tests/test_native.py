import math

import pytest
from pyspark.sql import functions as F

from palimpsest.config import CALIBRATED
from palimpsest.functions import kernels, native


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_hashes_equal_the_kernels(spark):
    words = ["decomposition", "a", "it's", "2024", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(native.token_hash("w"), native.fnv1a32("w")).collect()
    assert [r[0] for r in got] == [kernels.word_value(w) for w in words]

    def fnv(w):
        h = 2166136261
        for c in w:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    assert [r[1] for r in got] == [fnv(w) for w in words]


def test_tidy_and_text(spark):
    assert one(spark, native.tidy("t"), t="  a\r\nb\t\tc \r d\n\n\n\ne  ") == "a\nb c \n d\n\ne"
    assert one(spark, native.html_to_text("t"), t="<script>x\ny</script><p>hi</p>") == "  hi "
    assert one(spark, native.strip_jats("t"), t="<jats:p>a &amp; b</jats:p>\n c") == "a & b c"
    assert one(spark, native.dehyphenate("t"), t="know-\n  ledge up-\nTown") == "knowledge up-\nTown"
    assert one(spark, native.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, native.tokens("t"), t="It's 2 o'clock, straße") == ["it's", "2", "o'clock", "stra", "e"]


@pytest.mark.parametrize("starts,offset,page", [([0, 10, 20], 0, 1), ([0, 10, 20], 10, 2), ([0, 10, 20], 99, 3), ([], 5, 1), (None, 5, 1), ([5], 1, 1)])
def test_page_of(spark, starts, offset, page):
    df = spark.createDataFrame([(starts, offset)], "s array<int>, o int")
    assert df.select(native.page_of("s", "o")).first()[0] == page


def test_locate(spark):
    df = spark.createDataFrame([([0, 10, 20], 5, 10), ([0, 10, 20], 5, 21), (None, 3, 3)], "p array<int>, a int, b int")
    assert [tuple(r[0])[:2] for r in df.select(native.locate("p", "a", "b")).collect()] == [(1, 1), (1, 3), (1, 1)]


def test_jaccards(spark):
    j = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [1, 2])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in j.select(native.exact_jaccard("a", "b")).collect()] == [0.5, 0.0, 0.5]
    assert [round(r[0], 3) for r in j.select(native.estimate_jaccard("a", "b")).collect()] == [0.0, 0.0, 0.0]


def test_bands_priorities_and_steps(spark):
    s = spark.createDataFrame([(0.1,), (0.2,), (0.75,), (0.9,), (None,)], "s double")
    assert [r[0] for r in s.select(native.band_for("s")).collect()] == ["human", "unclear", "likely-ai", "very-likely-ai", None]
    p = spark.createDataFrame([(0.3, 0.0, "human"), (0.1, 0.8, "likely-ai"), (0.15, 0.1, "human"), (0.0, 0.75, "likely-ai"), (0.0, 0.5, "unclear")], "s double, a double, b string")
    assert [r[0] for r in p.select(native.review_priority("s", "a", "b")).collect()] == ["read-first", "read-first", "worth-a-look", "worth-a-look", "no-flags"]
    steps = native.isotonic("s", CALIBRATED.breakpoints, CALIBRATED.values)
    assert [r[0] for r in s.select(steps).collect()] == [0.092105, 0.149701, 0.792453, 0.921296, None]
    assert one(spark, native.isotonic("s", (), ()), s=0.3) == 0.3


def test_language_model_arithmetic(spark):
    row = one(spark, native.log_softmax("r"), r=[1000.0, 1001.0])
    assert sum(map(math.exp, row)) == pytest.approx(1)
    assert one(spark, native.rank_of("r", F.lit(0)), r=[2.0, 3.0, 2.0]) == 2
    df = spark.createDataFrame([([[0.0, 1.0], [1.0, 0.0]], [1, 7], ["b", "x"])], "r array<array<double>>, t array<int>, n array<string>")
    t = df.select(native.triples("r", "t", "n")).first()[0]
    assert len(t) == 1 and t[0]["token"] == "b" and t[0]["logr"] == 0.0
