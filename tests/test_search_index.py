import random
import re

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.operators import search_index as S

WORDS = ["the", "thin", "other", "Kelvin", "\u212aelvin", "STRASSE", "\u017ftra\u017fse", "naïve", "a\nb", "\u0130stanbul", "\u0131nput",
         "漢字文", "xyz.abc", "foobar", "foofoobar", ""]
PATTERNS = [
    "th(e|in)\\s+[aeiou]", "kelvin", "strasse", "漢字文", "foo(bar|baz)", "(foo)+bar", "fo{2,}bar", "^the.*other$", "xyz\\.abc",
    "input|istanbul", "naïve", "[kx]elvin", "(?:thin|the) (?:kel|foo)", "colou?r|foob.r", "a.b", "th", "", "(?=foo)foo", "[a-z]+bar", "foo\\b",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for _ in range(300)] + [None, None, "", "ab"]
    texts.append("y" * 200_000 + "foobar" + "y" * 70_000)
    texts.append("y" * (S.PIECE - 3) + "foobar")  # lies across the end of a piece
    folder = str(tmp_path_factory.mktemp("search"))
    data = [(None if i % 50 == 0 else f"k{i % 40}", t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "key string, text string, no long")
    df.repartition(6, "no").write.parquet(f"{folder}/table")
    index = S.TextIndex(f"{folder}/index", f"{folder}/table", "text")
    assert index.refresh(spark) > 1 and index.refresh(spark) == 0
    return index


@pytest.mark.parametrize("pattern", PATTERNS)
def test_index_finds_what_a_scan_finds(spark, stored, pattern):
    table = spark.read.parquet(stored.table)
    want = table.filter(X.matches(F.col("text"), pattern)) if pattern else table
    assert rows(stored.search(spark, pattern), "no", "key") == rows(want, "no", "key")


def test_new_and_gone_files(spark, tmp_path):
    table = f"{tmp_path}/table"
    spark.createDataFrame([(1, "the foobar"), (2, "none")], "no int, text string").coalesce(1).write.parquet(table)
    index = S.TextIndex(f"{tmp_path}/index", table, "text")
    assert rows(index.search(spark, "foobar"), "no") == [(1,)]  # nothing indexed yet
    index.refresh(spark)
    spark.createDataFrame([(3, "FOOBAR"), (4, None)], "no int, text string").coalesce(1).write.mode("append").parquet(table)
    assert rows(index.search(spark, "foobar"), "no") == [(1,), (3,)]
    assert index.refresh(spark) == 1
    assert rows(index.search(spark, "foobar"), "no") == [(1,), (3,)]
    gone = f"{tmp_path}/empty"
    spark.createDataFrame([], "no int, text string").write.parquet(gone)
    assert S.TextIndex(f"{tmp_path}/index2", gone, "text").search(spark, "foobar").count() == 0


def test_only_files_with_candidates_are_read(spark, stored):
    assert len(stored.search(spark, "y{9}foobar").inputFiles()) < len(spark.read.parquet(stored.table).inputFiles())


def test_what_patterns_require():
    need = lambda p: [{"".join(sorted(c)) for c in clause} for clause in S.required_trigrams(p)]
    assert need("foo") == [{"foo"}] and need("FOO") == [{"foo"}]
    assert need("fo(o|x)") == [{"foo", "fox"}]
    for nothing in ("fo", "a?b?", "(foo)?", "[^a]{3}", "(?i)foo", "foo\\1", "[a&&b]foo", "foo|a", "\\Qfoo\\E", "f(o", "foo)", ".*", "ïïï"):
        assert S.required_trigrams(nothing) == [], nothing
    assert need("foo.*bar") == [{"foo"}, {"bar"}]
    assert need("ab+cd") == [{"bcd"}]


ATOMS = st.sampled_from(["a", "b", "ab", "[ab]", "[^a]", ".", "(?:ab|b)", "(?:a|ba|abb)", "(?:a.|bb)", "\\b"])
PIECES = st.tuples(ATOMS, st.sampled_from(["", "", "", "+", "*", "?", "{2}", "{1,2}"])).map(
    lambda p: p[0] if p[0] in ("ab", "\\b") else p[0] + p[1]
)


@given(st.lists(PIECES, min_size=1, max_size=6), st.text("ab ", max_size=14))
@settings(max_examples=1500, deadline=None)
def test_matching_texts_meet_the_requirement(parts, text):
    pattern = "".join(parts)
    if re.search(pattern, text):
        have = S._trigrams(text)
        assert all(any(choice <= have for choice in clause) for clause in S.required_trigrams(pattern))
