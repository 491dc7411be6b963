import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatterloom import session
from chatterloom.operators import reports
from chatterloom.schemas import TABLES
from chatterloom.session import shared_folder
from chatterloom.sources import tables as io


def test_old_tables_get_their_columns(spark, tmp_path):
    old = spark.createDataFrame([("t1", "Hello"), ("t2", None)], "thread_id string, title string")
    io.write_table(old, f"{tmp_path}/session")
    found = io.load_tables(spark, str(tmp_path))
    assert list(found) == ["session"] and found["session"].schema.names == TABLES["session"].names
    assert rows(found["session"], "thread_id", "title", "message_count", "username") == [
        ("t1", "Hello", 0, "default_user"), ("t2", "New Chat", 0, "default_user"),
    ]
    assert spark.table("session").count() == 2
    with pytest.raises(Exception):
        io.load_tables(spark, str(tmp_path), ["profile"])
    with pytest.raises(Exception):
        io.write_table(old, f"{tmp_path}/session")


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    kept = session.written(spark.range(3), "outer")
    with session.scratch(spark):
        first = session.written(spark.range(5), "one")
        with session.scratch(spark):
            session.written(first, "two")
        assert len(list(tmp_path.glob("*"))) == 2 and first.count() == 5
    assert len(list(tmp_path.glob("*"))) == 1 and kept.count() == 3


def test_append_adds_days_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", 30)], "text string, h int").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' HOUR * h")
    )
    for _ in range(2):
        io.append_log(df, f"{tmp_path}/log", id_column="note_id")
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == 4 and back.select("note_id").distinct().count() == 4
    assert back.select("dt").distinct().count() == 2
    pruned = back.filter(F.col("dt") == F.lit("2024-01-01").cast("date"))
    assert pruned.count() == 2 and len(pruned.inputFiles()) >= 1


def test_compacted_log(spark, tmp_path):
    log = spark.createDataFrame([("k", "put", 1), ("k", "put", 2), ("g", "put", 1), ("g", "delete", 2)], "id string, op string, seq long")
    io.compact_log(log, ["id"], f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [("k", "put", 2)]


def test_console_only_reads(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert io.run_readonly_sql(spark, "  SELECT * FROM numbers;  ").count() == 3
    assert io.run_readonly_sql(spark, "with x as (select 1 as a) select * from x").count() == 1
    assert io.run_readonly_sql(spark, "explain select * from numbers").count() == 1
    insert = "with q as (select 1 as a) insert overwrite directory '/tmp/never-written' using parquet select * from q"
    into = "with q as (select 1 as a) insert into numbers select * from q"
    for bad in ("DROP VIEW numbers", "insert into numbers values (1)", "", insert, into, "explain " + insert, "EXPLAIN extended " + into,
                "select 1; drop view numbers"):
        with pytest.raises(PermissionError):
            io.run_readonly_sql(spark, bad)


READING = [
    "select count(*), max(id) over () from numbers group by id having count(*) > 0",
    "with a as (select id from numbers), b as (select * from a) select * from b where id in (select id from a) order by 1 limit 2 offset 1",
    "select * from numbers lateral view explode(array(1, 2)) x as y",
    "select * from range(3) join (values ('b'), (upper('a'))) v(z) on true",
    "select filter(array(id), x -> x > 1), (select max(id) from numbers), case when exists (select 1) then 1 end from numbers",
    "select id, sum(id) over w from numbers window w as (partition by id) union all select 1, 2 except select 3, 4 intersect select 1, 2",
    "select /*+ broadcast(numbers) */ distinct id from numbers distribute by id",
    "select * from numbers, lateral (select numbers.id + 1)",
    "select * from numbers pivot (max(id) for id in (1, 2))",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 4) select * from r",
    "show tables", "show views", "show functions like 'a*'", "explain formatted select * from numbers", "select 1 -- insert into numbers",
]

ACTING = [
    "select transform(id) using 'tee {made}' as (y) from numbers",
    "select reflect('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')",
    "select java_method('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')",
    "select try_reflect('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')",
    "select Reflect('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes') from range(1)",
    "select system.builtin.reflect('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')",
    "select `identifier`('x'), identifier('reflect')('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')",
    "select * from identifier('numbers')",
    "select * from (values (reflect('java.lang.System', 'setProperty', 'chatterloom.ran', 'yes')))",
    "select * from text.`/etc/passwd`",
    "select * from numbers lateral view my_function(id) x as y",
    "select my_function(id) from numbers",
]


@pytest.mark.parametrize("text", READING)
def test_console_runs_reading_statements(spark, text):
    spark.range(3).createOrReplaceTempView("numbers")
    io.run_readonly_sql(spark, text).collect()


FORMS = [
    "{0}", "explain {0}", "explain codegen {0}", "with q as ({0}) select * from q", "select * from ({0}) q", "select 1 where exists ({0})",
    "select * from numbers where id in (select 1 from ({0}) q)", "select 1 union all (select 2 from ({0}) q)",
    "select (select max(1) from ({0}) q)", "select transform(array(1), x -> (select 1 from ({0}) q))",
]


@pytest.mark.parametrize("form", FORMS)
def test_console_refuses_what_acts_at_any_depth(spark, tmp_path, form):
    spark.range(3).createOrReplaceTempView("numbers")
    spark.udf.register("my_function", lambda x: x)
    made, system = tmp_path / "made", spark._jvm.java.lang.System
    for text in ACTING:
        with pytest.raises(PermissionError):
            io.run_readonly_sql(spark, form.format(text.format(made=made)))
    assert not made.exists() and system.getProperty("chatterloom.ran") is None


def test_console_write_mode_runs_anything(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert io.run_readonly_sql(spark, "select reflect('java.lang.Math', 'abs', -1) as x", write_mode=True).first().x == "1"


def test_table_report(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/small")
    spark.range(100_000).repartition(3).write.parquet(f"{tmp_path}/large")
    report = reports.storage_by_size(reports.table_report(spark, {"small": f"{tmp_path}/small", "large": f"{tmp_path}/large"})).collect()
    assert [(r["table_name"], r["rows"]) for r in report] == [("large", 100_000), ("small", 10)]
    size = sum(f.stat().st_size for f in (tmp_path / "large").glob("*.parquet"))
    assert report[0]["bytes"] == size and abs(sum(r["share"] for r in report) - 1) < 1e-5


def test_table_report_counts_empty_files_and_tables(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/mixed/day=1")
    spark.range(0).coalesce(1).write.parquet(f"{tmp_path}/mixed/day=2")
    spark.range(0).coalesce(1).write.parquet(f"{tmp_path}/empty")
    report = {r.table_name: r for r in reports.table_report(spark, {n: f"{tmp_path}/{n}" for n in ("mixed", "empty")}).collect()}
    for name, count in (("mixed", 10), ("empty", 0)):
        files = list((tmp_path / name).rglob("*.parquet"))
        assert report[name].rows == count and report[name].bytes == sum(f.stat().st_size for f in files) > 0
    assert len(list((tmp_path / "mixed" / "day=2").glob("*.parquet"))) == 1


def test_shared_folder_follows_the_session():
    class Conf:
        value = "hdfs://shared/ck/"

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.value

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})

    assert shared_folder(Cluster(), "x").startswith("hdfs://shared/ck/chatterloom/x-")
    Conf.value = None
    with pytest.raises(ValueError):
        shared_folder(Cluster(), "x")
    Cluster.sparkContext.master = "local[2]"
    assert shared_folder(Cluster(), "x").endswith("/x")
