from __future__ import annotations

from pyspark.sql import functions as F

from quernlake import cli
from quernlake.operators import relational
from quernlake.plans.engine import Engine
from quernlake.sources import files
from quernlake.streaming import windows

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def stream(spark, tmp_path):
    e = files.read(spark, f"{SF}/events.parquet")
    files.write(e.repartition(4), f"{tmp_path}/in")
    return e, windows.read_files(spark, f"{tmp_path}/in", e.schema, files_per_batch=2)


def test_candles_agree_with_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    run(windows.candles(s, "6h", "ts", "value", late="8760h", tie="event_id"), "candles", "complete")
    want = relational.candles(e, "6h", "ts", "value", tie="event_id")
    assert sorted(map(tuple, spark.table("candles").collect())) == sorted(map(tuple, want.collect()))


def test_sliding_and_sessions(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    run(windows.tumbling(s, "1h", "ts", [F.count("*").alias("n")], late="8760h", slide="30m"), "sliding", "complete")
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 2 * e.count()
    run(windows.sessions(s, "10m", "ts", [F.count("*").alias("n")], ["user_id"], late="8760h"), "sessions", "complete")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == e.count()


def test_stream_into_versioned_table(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    db = Engine(spark)
    db.execute("CREATE TABLE last (user_id INTEGER PRIMARY KEY, n INTEGER)")
    totals = s.groupBy("user_id").agg(F.count("*").alias("n"))
    q = windows.into_table(totals, db, "last", f"{tmp_path}/ck", key="user_id").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, db.sql("SELECT user_id, n FROM last").collect()))
    assert got == sorted(map(tuple, e.groupBy("user_id").count().collect()))


def test_command_line(spark, capsys):
    db = Engine(spark)
    cli.run(db, "CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2); SELECT a FROM t ORDER BY a", False, 1)
    out = capsys.readouterr().out
    assert "2 rows affected" in out and "more not shown" in out
    cli.run(db, "SELECT a FROM t ORDER BY a", True, 0)
    assert '"rows": [[1], [2]]' in capsys.readouterr().out
