import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatterloom.llm import chat
from chatterloom.llm.queries import op1_prefix_examples

HARD = ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[\\/INST]", "<|end|>", "<|turn|>", "<\\|says|>", "<", "[", "\\", "<<SYS>>", "é\n", "$1", ""]


@settings(max_examples=8, deadline=None)
@given(data=st.lists(st.lists(st.sampled_from(HARD), max_size=6), min_size=40, max_size=60))
def test_escape_round_trip(spark, data):
    texts = ["".join(x) for x in data]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(mark in r.e for mark in ("</s>", "[INST]", "[/INST]", "<|end|>", "<|turn|>", "<SYS>"))


def test_examples(spark):
    rows = [
        (1, 0, "system", "be <|end|> good"), (1, 1, "user", None), (1, 2, "assistant", "a</s>b"), (1, 3, "user", "q"),
        (1, 4, "assistant", ""), (1, 4, "assistant", "tie"), (1, 5, "user", "open end"), (2, 0, None, "x"),
        (None, 7, "assistant", "no id"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r"),
    ]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")
    made = chat.prefix_examples(turns)
    got = made.select("*", chat.read_turns(F.col("text")).alias("back"), chat.trained_text(made).alias("loss")).collect()
    for key in (1, 2, 3, None):
        mine = sorted((r for r in got if r.conv_id == key), key=lambda r: r.position)
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        assert [tuple(x) for x in mine[-1].back] == want and mine[-1].last
        for r in mine:
            assert [tuple(x) for x in r.back] == want[: r.position]
            assert r.trainable == (want[r.position - 1][0] == "assistant")
            assert r.loss == (want[r.position - 1][1] if r.trainable else "")
        assert [r.position for r in mine] == sorted({i + 1 for i, w in enumerate(want) if w[0] == "assistant"} | {len(want)})
    assert chat.prefix_examples(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    turns = spark.range(401).selectExpr("1L conv_id", "id turn", "if(id % 2 = 1, 'assistant', 'user') role", "repeat('w ', 300) text")
    made = chat.prefix_examples(turns)
    assert made.count() == 201 and made.filter("trainable").count() == 200


def test_probe_conversation(spark):
    row = op1_prefix_examples(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
