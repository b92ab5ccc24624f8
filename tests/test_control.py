"""Control tables, DDL states, stateful lifecycles and tasks."""

import pytest

from tidelog.plans.ddl import SchemaRegistry
from tidelog.plans.ddl_state import DDLRecord, DDLStatus, ddl_gate
from tidelog.streaming.control import ControlStore
from tidelog.streaming.manager import TaskManager


def test_control_store(spark, tmp_path):
    store = ControlStore(spark, f"file://{tmp_path}/control")
    assert store.load("task_position").count() == 0
    store.save("task_position", [{"task": "a", "position": "1"}, {"task": "b", "position": "5"}])
    store.save("task_position", [{"task": "a", "position": "2"}])
    assert sorted((r.task, r.position) for r in store.load("task_position").collect()) == [("a", "2"), ("b", "5")]
    store.delete("task_position", task="b")
    assert [r.task for r in store.load("task_position").collect()] == ["a"] and store.load("task_position", task="b").count() == 0


def test_ddl_records():
    registry = SchemaRegistry()
    good = DDLRecord("db", "CREATE TABLE t (id INT)", "mysql", 1).run(registry)
    assert good.status == DDLStatus.COMPLETED and registry.count() == 1
    bad = DDLRecord("db", "ALTER TABLE unknown ADD COLUMN x INT", "mysql", 2).run(registry)
    assert bad.status == DDLStatus.FAILED and bad.retryable and registry.count() == 1
    for _ in range(3):
        bad = bad.run(registry)
    assert bad.retries == 3 and not bad.retryable and bad.to(DDLStatus.SKIPPED).status == "skipped"
    with pytest.raises(ValueError):
        good.to(DDLStatus.APPLYING)


def test_ddl_gate(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "seq int, table_id string")
    states = spark.createDataFrame([("a", "applying", 0), ("b", "failed", 1), ("c", "completed", 0), ("b", "completed", 0)], "table_id string, status string, retries int")
    assert {r.table_id: r.ddl_gate for r in ddl_gate(events, states).collect()} == {"a": "block", "b": "retry", "c": "pass", "d": "pass"}


def test_lifecycle_stream(spark, tmp_path):
    from tidelog.streaming.stateful import lifecycle_stream

    rows = [("t1", 1, "snapshotting"), ("t1", 2, "catching_up"), ("t1", 3, "pending"), ("t2", 1, "streaming")]
    spark.createDataFrame(rows, "table_id string, seq bigint, to_state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table_id string, seq bigint, to_state string").parquet(str(tmp_path / "in"))
    query = lifecycle_stream(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.table_id, r.seq, r.to_state, r.ok) for r in spark.table("moves").collect())
    assert got == [("t1", 1, "snapshotting", True), ("t1", 2, "catching_up", True), ("t1", 3, "catching_up", False), ("t2", 1, "pending", False)]


def test_tasks():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    tasks = TaskManager()
    task = tasks.create("t", Query)
    task.start()
    with pytest.raises(ValueError):
        tasks.delete("t")
    task.pause()
    assert tasks.list() == [("t", "paused")]
    task.resume()
    task.stop()
    tasks.delete("t")
    with pytest.raises(ValueError):
        tasks.create("x", Query).pause()
