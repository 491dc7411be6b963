"""Calls of user functions: the answer store, and executors that start elsewhere."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatterloom.functions.model import apply_text_function, stored_answers

REPO = Path(__file__).resolve().parents[1]


def recorder(folder, broken=()):
    """A function that notes what it is asked, and dies on a call that holds a broken prompt."""

    def ask(prompts: pd.Series) -> pd.Series:
        import uuid

        if prompts.isin(broken).any():
            raise RuntimeError("the model went away")
        Path(folder, uuid.uuid4().hex).write_text("\n".join(prompts))
        return prompts.str.upper()

    return ask


def asked(folder):
    return sorted(line for f in Path(folder).iterdir() for line in f.read_text().splitlines())


def test_a_run_that_died_is_taken_up_where_it_was(spark, tmp_path):
    (tmp_path / "log").mkdir()
    texts = [f"prompt {i}" for i in range(60)]
    data = [(i, t, True) for i, t in enumerate(texts)] + [(90, "prompt 3", True), (91, "not due", False), (92, None, False)]
    df = spark.createDataFrame(data, "id long, text string, due boolean").repartition(3)
    store = f"{tmp_path}/answers"
    with pytest.raises(Exception, match="the model went away"):
        apply_text_function(df, recorder(tmp_path / "log", ["prompt 7"]), answers=store, call_rows=4).collect()
    first = asked(tmp_path / "log")
    assert 0 < len(first) < 60 and "prompt 7" not in first
    kept = rows(stored_answers(df, store), "answer")
    out = apply_text_function(df, recorder(tmp_path / "log"), answers=store, call_rows=4)
    want = sorted(((i, t.upper() if due else t, due) for i, t, due in data), key=repr)
    assert rows(out) == want
    every = asked(tmp_path / "log")
    done = {a for (a,) in kept}
    assert [t for t in every if t.upper() in done] == sorted(t for t in texts if t.upper() in done), "kept answers are not asked again"
    again = apply_text_function(df, recorder(tmp_path / "log", texts), answers=store)
    assert rows(again) == want and asked(tmp_path / "log") == every
    other = apply_text_function(df, recorder(tmp_path / "log"), answers=store, model="other")
    assert rows(other) == want and len(asked(tmp_path / "log")) == len(every) + 60


def test_no_prompt_is_asked_twice_when_calls_before_the_broken_one_were_done(spark, tmp_path):
    (tmp_path / "log").mkdir()
    df = spark.createDataFrame([(f"prompt {i}", True) for i in range(40)], "text string, due boolean")
    for broken in ([f"prompt {i}" for i in range(20, 40)], [f"prompt {i}" for i in range(30, 40)], []):
        some = df if not broken else df.filter(~F.col("text").isin(broken)).unionByName(df.filter(F.col("text") == broken[0]))
        ask = recorder(tmp_path / "log", broken)
        if broken:
            with pytest.raises(Exception, match="went away"):  # one task: the broken call comes after others were done
                apply_text_function(some.filter(F.col("text") != broken[0]), ask, answers=f"{tmp_path}/a").collect()
                apply_text_function(some, ask, answers=f"{tmp_path}/a").collect()
        else:
            apply_text_function(some, ask, answers=f"{tmp_path}/a").collect()
    assert asked(tmp_path / "log") == sorted(f"prompt {i}" for i in range(40))


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from chatterloom import CompactionConfig
from chatterloom.plans import compaction as P
from chatterloom.schemas import TABLES
from chatterloom.session import local_session
spark = local_session(2, "elsewhere")
data = [("t", i, "t-%d" % i, "ai" if i % 2 else "human", "x" * 50, None, None, None) for i in range(60)]
m = spark.createDataFrame(data, TABLES["message"])
cfg = CompactionConfig(30, 6, 2)
"""

CASES = {
    "summaries": """
due = spark.createDataFrame([("t", 0, 1, 10, "p")], "thread_id string, page int, pages int, summarized_count int, prompt string")
assert P.apply_summaries(due, lambda s: s.str.upper()).first().summary == "P"
""",
    "boundaries": """
assert P.compaction_boundaries(m, cfg, width=10).count() > 3
""",
    "stream": """
from chatterloom.streaming import compaction as C, events as S
rows = m.select("*", F.col("position").alias("seq"), F.lit("append").alias("op")).withColumn(
    "ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' SECOND * position"))
rows.coalesce(1).write.parquet("in")
folds = C.compaction(spark.readStream.schema(rows.schema).parquet("in"), cfg, 5)
S.write_batches(folds, "out", "ck", "append", keyed_state=True).awaitTermination()
assert spark.read.parquet("out").count() > 3
""",
}


@pytest.mark.parametrize("case", CASES)
def test_runs_alone_from_a_foreign_folder(tmp_path, case):
    """Executors find the package, whatever else ran before and wherever the driver was started."""
    script = ALONE.format(repo=str(REPO)) + CASES[case]
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
