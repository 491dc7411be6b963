import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.operators import scope


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, title",
    [
        (None, "New Chat"), ("", "New Chat"), (" \n\t ", "New Chat"), ("x" * 40, "x" * 40), ("x" * 41, "x" * 40),
        ("  hi  ", "hi"), ("😀" * 41, "😀" * 40), ("\x1fa b\x1c", "a b"),
    ],
)
def test_titles(spark, raw, title):
    assert value(spark, X.title_from_text(F.lit(raw).cast("string"))) == title


def test_message_text(spark):
    df = spark.createDataFrame(
        [
            (1, "plain", None), (2, None, [("text", "a", None), ("image_url", None, "u"), ("text", "b", None)]),
            (3, None, [("image_url", None, "u")]), (4, None, [("text", "", None)]), (5, "", None), (6, None, []),
        ],
        "id int, content string, blocks array<struct<type: string, text: string, image_url: string>>",
    )
    got = {r["id"]: r["t"] for r in df.select("id", X.message_text(F.col("content"), F.col("blocks")).alias("t")).collect()}
    assert got == {1: "plain", 2: "a\nb", 3: "[image]", 4: "", 5: "", 6: "[image]"}


def test_image_note(spark):
    noted = X.with_image_note(F.lit("look"), F.lit("a cat"))
    assert value(spark, noted) == "look\n\n[Attached image - vision analysis: a cat]"
    assert value(spark, X.with_image_note(F.lit("look"), F.lit(None).cast("string"))) == "look"
    assert value(spark, X.has_image_note(noted))
    assert value(spark, X.has_image_note(F.lit("I typed [Attached image myself")))


def test_usernames_and_digest(spark):
    assert value(spark, X.normalize_username(F.lit("  Ann \n"))) == "ann"
    assert value(spark, X.normalize_username(F.lit(" \t"))) is None
    want = hashlib.sha256(b"s:ann").hexdigest()
    assert value(spark, X.salted_digest(F.lit("s"), F.lit(" ANN "))) == want
    assert value(spark, X.salted_digest(F.lit("s"), F.lit(None).cast("string"))) is None


def test_tokens_take_the_floor_of_the_sum(spark):
    df = spark.createDataFrame([("abc",), ("abc",), (None,)], "content string")
    total = df.agg(X.tokens_from_chars(F.sum(X.content_length(F.col("content")))).alias("v")).first()["v"]
    assert total == 1


def test_search(spark):
    df = spark.createDataFrame([("a", "Über Paris"), ("b", None), ("c", "rome")], "thread_id string, title string")
    find = lambda p: sorted(r["thread_id"] for r in scope.search_titles(df, p).collect())
    assert find("") == ["a", "b", "c"]
    assert find("ÜBER|ROME") == ["a", "c"] and find("^paris") == []


def test_store_documents(spark):
    notes = spark.createDataFrame(
        [("p1", "k1", None, None, None), ("p1", "k2", "t", "2024", "7"), ("p2", "k3", "u", "2023", None)],
        "profile_id string, note_id string, text string, created_at string, source_thread_id string",
    )
    store = scope.store_rows(notes)
    back = {r["note_id"]: (r["text"], r["created_at"], r["source_thread_id"]) for r in scope.notes_from_store(store).collect()}
    assert back["k1"] == ("", "", None) and back["k2"] == ("t", "2024", "7")
    other = store.select(F.array(F.lit("p1"), F.lit("files")).alias("namespace"), "key", "value")
    both = store.unionByName(other)
    assert scope.notes_in_namespace(both, ["p1", "notes"]).count() == 2
    assert scope.notes_from_store(both).count() == 3
    gone = spark.createDataFrame([("p1",)], "profile_id string")
    assert [r["key"] for r in scope.drop_profile_namespace(both, gone).collect()] == ["k3"]


def test_wall_micros_ignore_the_zone(spark):
    stamp = F.expr("timestamp_ntz'2262-02-03 04:05:06.700001'")
    want = (datetime(2262, 2, 3, 4, 5, 6, 700001) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert value(spark, X.wall_micros(stamp)) == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_iso_and_roles(spark):
    stamp = F.expr("timestamp_ntz'2024-02-03 04:05:06.7'")
    assert value(spark, X.iso_utc(stamp)) == "2024-02-03T04:05:06.700000+00:00"
    assert [value(spark, X.display_role(F.lit(k))) for k in ("human", "ai", "tool", "system")] == ["user"] + ["assistant"] * 3


def test_iso_utc_of_instants_and_zoneless_times(spark):
    from pyspark.sql import functions as F

    from chatterloom.functions.text import iso_utc

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("SELECT timestamp'2024-01-01 00:00:00Z' AS a, timestamp_ntz'2024-01-01 00:00:00' AS b")
        assert set(row.select(iso_utc(F.col("a")), iso_utc(F.col("b"))).first()) == {"2024-01-01T00:00:00.000000+00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
