import re

import pytest
from pyspark.sql import functions as F

from forumlens.functions import predicates as P
from forumlens.functions import scalars as S
from forumlens.functions import text as X


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.select(column(F.col("c")).alias("o"), "i").orderBy("i").collect()]


def python_cleaner(text, passes):
    for pattern, to in passes:
        text = re.sub(pattern.replace("(?i)", ""), to.replace("$1", r"\1"), text, flags=re.I | re.A if "(?i)" in pattern else re.A)
    return text.strip(" ")


TEXTS = ["[Help me] see https://www.a.com/x_y and **bold** text", "![img](https://x.org/a 'title') rest", "a &amp; b   c\n\n\n\nd", "", "id 1234567 or 0123456789abcdef01234567", "über | straße -- 日本語", "x" * 3000]


@pytest.mark.parametrize("name", sorted(X.PASSES))
def test_cleaners_agree_with_python(spark, name):
    got = one(spark, lambda c: X.cleaned(c, X.PASSES[name]), *TEXTS)
    assert got == [python_cleaner(t, X.PASSES[name]) for t in TEXTS]
    assert one(spark, lambda c: X.cleaned(c, X.PASSES[name]), None) == [None]


def test_description_of_null_is_empty(spark):
    assert one(spark, X.clean_description, None, "a") == ["", "a"]


@pytest.mark.parametrize("name, text, want", [
    ("words", "I'll can't", ["ll", "can"]), ("words_acronyms", "the U.S.A now", ["the", "U.S.A", "now"]), ("words_emoji", "hi 🙂", ["hi", "🙂"]),
    ("words", "über ok", ["über", "ok"]), ("split", " a  b\n", ["a", "b"]), ("words", "", []),
])
def test_tokenizers(spark, name, text, want):
    assert one(spark, lambda c: X.tokens(c, name, lower=False), text) == [want]


def test_ngrams(spark):
    grams = lambda c: X.ngrams(X.normalised_words(c))
    assert one(spark, grams, "A b, c", "", "one") == [["a", "b", "c", "a b", "b c", "a b c"], [], ["one"]]


def test_links(spark):
    domain = lambda c: X.url_domain(c, ["i.media.example"])
    assert one(spark, domain, "https://www.site.com/watch?v=1", "https://i.media.example/x.jpg", None, "no link") == ["site.com", None, None, None]
    assert one(spark, X.url_path_words, "https://a.com/big-news/of_day.html?x=1", None) == [" big news of day".strip(), None]


def test_long_bodies_keep_head_and_tail(spark):
    text = "h" * 720 + "m" * 100 + "t" * 290
    got = one(spark, X.head_and_tail, text, "short", None)
    assert got == ["h" * 720 + ".\n\n" + "t" * 290, "short", ""]


def test_guards(spark):
    df = spark.createDataFrame([(0, 0), (1, 19), (1, 20), (None, 0), (1, None)], "removed int, votes int")
    assert [r[0] for r in df.select(P.not_soft_removed("removed", "votes", 20)).collect()] == [True, False, True, True, False]


def test_scores(spark):
    z = lambda c: S.combined_score(F.lit(0.5), c)
    assert one(spark, z, -1.0, 0.0, 5.0, 6.0, kind="double") == pytest.approx([0.4, 0.4, 0.6, 0.6])
    constant = lambda c: S.z_score(F.lit(1.0), F.lit(1.0), c, 0.5)
    assert one(spark, constant, None, 0.0, 2.0, kind="double") == [0.5, 0.5, 0.0]
    assert one(spark, lambda c: S.bins(c, [1, 20, 40]), None, 0, 1, 40, kind="int") == [None, 0, 1, 3]
    months = lambda c: S.months_between_calendar(F.to_date(c), F.to_date(F.lit("2024-01-31")))
    assert one(spark, months, "2024-02-01", "2023-12-31") == [1, -1]
    assert one(spark, lambda c: S.greatest_strict(c, F.lit(1)), None, 5, kind="int") == [None, 5]
    assert one(spark, lambda c: S.safe_divide(F.lit(1.0), c), 0.0, None, 2.0, kind="double") == [None, None, 0.5]
