"""Redo text, DDL, spills, the stream source and stream apply."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.plans import ddl
from tidelog.sources import redo
from tidelog.sources.spill import SpillStore


def test_redo_statements():
    c = redo.parse_redo("""insert into "HR"."EMP"("ID","NAME","SALARY") values (1,'John',5000);""")
    assert (c.op, c.schema, c.table, c.new) == ("insert", "HR", "EMP", {"ID": "1", "NAME": "'John'", "SALARY": "5000"})
    c = redo.parse_redo("""update "HR"."EMP" set "NAME" = 'Jane' where "ID" = 1 and "NAME" = 'John';""")
    assert c.new == {"NAME": "'Jane'"} and c.old == {"ID": "1", "NAME": "'John'"}
    c = redo.parse_redo("""delete from "S"."T" where "A" = 1 and "B" IS NULL;""")
    assert c.old == {"A": "1", "B": None}
    c = redo.parse_redo("""insert into "S"."T"("A","B","C","D") values ('O''Brien','hello, world',TO_DATE('2020-01-01', 'YYYY-MM-DD'),Unsupported Type)""")
    assert c.new == {"A": "'O''Brien'", "B": "'hello, world'", "C": "TO_DATE('2020-01-01', 'YYYY-MM-DD')"}
    assert redo.parse_redo("""insert into "T"("A") values ('abc' || 'def')""").new == {"A": "'abc' || 'def'"}
    for bad in ("", "select 1", """insert into "T"("A","B") values (1)""", """delete from "T" where "A" = """):
        with pytest.raises(redo.RedoError):
            redo.parse_redo(bad)


def test_redo_log(spark):
    log = spark.createDataFrame([(1, """update "S"."T" set "A" = 'x' where "ID" = 1"""), (2, "nonsense")], "scn bigint, sql_redo string")
    rows = redo.parse_redo_log(log).orderBy("scn").collect()
    assert rows[0].after == {"ID": "1", "A": "x"} and rows[0].before == {"ID": "1"} and rows[1].op is None and rows[1].error


def test_ddl_mysql():
    t = ddl.apply_ddl(None, "CREATE TABLE users (id INT NOT NULL AUTO_INCREMENT, name VARCHAR(100) NOT NULL, email VARCHAR(255) DEFAULT 'none', age INT, PRIMARY KEY (id))", "mysql", "db")
    assert [(c.name, c.type, c.length, c.nullable, c.default) for c in t.columns] == [("id", "INT", 0, False, None), ("name", "VARCHAR", 100, False, None), ("email", "VARCHAR", 255, True, "none"), ("age", "INT", 0, True, None)] and t.primary_key == ("id",)
    t = ddl.apply_ddl(t, "ALTER TABLE users DROP COLUMN age, ADD COLUMN balance DECIMAL(10,2) NOT NULL")
    assert [c.name for c in t.columns] == ["id", "name", "email", "balance"] and t.column("balance").scale == 2
    t = ddl.apply_ddl(t, "ALTER TABLE users MODIFY COLUMN name TEXT; ALTER TABLE users CHANGE COLUMN email mail VARCHAR(50)")
    assert t.column("name").type == "TEXT" and t.column("mail").length == 50 and t.spark_schema()["balance"].dataType.simpleString() == "decimal(10,2)"
    assert ddl.Table.from_json(t.to_json()) == t and ddl.apply_ddl(t, "DROP TABLE users") is None
    with pytest.raises(ddl.DDLError):
        ddl.apply_ddl(None, "ALTER TABLE users ADD COLUMN x INT")


def test_ddl_other_dialects():
    t = ddl.apply_ddl(None, 'CREATE TABLE public.users (id BIGINT PRIMARY KEY, "Name" VARCHAR(20) NOT NULL, n INT)', "postgres", "db")
    t = ddl.apply_ddl(t, 'ALTER TABLE public.users ALTER COLUMN "Name" DROP NOT NULL, ALTER COLUMN n TYPE BIGINT, RENAME COLUMN n TO m', "postgres")
    assert t.column("Name").nullable and t.column("m").type == "BIGINT" and t.column("m").nullable
    t = ddl.apply_ddl(t, "ALTER TABLE public.users ALTER COLUMN m SET NOT NULL", "postgres")
    assert not t.column("m").nullable
    o = ddl.apply_ddl(None, "CREATE TABLE users (id NUMBER PRIMARY KEY, name VARCHAR2(100), age NUMBER(3))", "oracle")
    o = ddl.apply_ddl(o, "ALTER TABLE users ADD (email VARCHAR2(255))", "oracle")
    assert [c.name for c in o.columns] == ["id", "name", "age", "email"] and o.column("age").length == 3
    o = ddl.apply_ddl(o, "ALTER TABLE users MODIFY (name VARCHAR2(200))", "oracle")
    assert o.column("name").length == 200
    s = ddl.apply_ddl(None, "CREATE TABLE [dbo].[t] ([id] INT NOT NULL, [v] NVARCHAR(10))", "sqlserver")
    s = ddl.apply_ddl(s, "ALTER TABLE dbo.t ALTER COLUMN v NVARCHAR(50) NOT NULL; ALTER TABLE dbo.t ADD w INT, x INT", "sqlserver")
    assert s.column("v").length == 50 and not s.column("v").nullable and [c.name for c in s.columns] == ["id", "v", "w", "x"]
    assert [c.kind for c in ddl.parse("CREATE INDEX i ON t (a); DROP VIEW v; TRUNCATE TABLE t; CREATE DATABASE d; GRANT x")] == ["create_index", "drop_view", "truncate_table", "create_database", "unknown"]


def test_registry():
    r = ddl.SchemaRegistry()
    r.apply("CREATE TABLE t (id INT)", "mysql", "db", 10)
    r.apply("ALTER TABLE t ADD COLUMN v INT", "mysql", "db", 20)
    r.apply("DROP TABLE t", "mysql", "db", 30)
    assert r.at(5).count() == 0 and len(r.at(10).get("db", "t").columns) == 1 and len(r.at(25).get("db", "t").columns) == 2 and r.at(30).count() == 0 == r.count()


def test_spill(spark, tmp_path):
    store = SpillStore(spark, f"file://{tmp_path}/spill")
    assert store.bytes() == 0 and store.read("db.t").count() == 0
    rows = [("db.t", "mysql", "{}", tx, s, k, False, False, f"p{k}") for k, (tx, s) in enumerate([("a", 0), ("a", 1), ("b", 0), ("c", 0)])]
    store.append(spark.createDataFrame(rows, "table_id string, source_type string, position string, tx_id string, seq bigint, place bigint, is_begin boolean, is_commit boolean, payload string").withColumn("ts", F.lit("2020-01-01").cast("timestamp")))
    places = lambda *a: sorted(r.place for r in store.read("db.t", *a).collect())
    assert places() == [0, 1, 2, 3] and places("a", 1) == [1, 2, 3] and places("x") == [] and store.bytes() > 0
    store.delete("db.t")
    assert places() == []


def changes(folder, files):
    folder.mkdir(exist_ok=True)
    for k, rows in files.items():
        (folder / f"{k:03d}.json").write_text("".join(json.dumps({"seq": s, "op": op, "database": "db", "table": "t", "pk": pk, "before": None, "after": {"v": v} if v else None, "ts": "2020-01-01 00:00:00"}) + "\n" for s, op, pk, v in rows))


def test_stream_apply_and_restart(spark, tmp_path):
    from tidelog.sources.stream_source import ChangeLogSource
    from tidelog.streaming.runner import VersionedTable, apply_stream

    spark.dataSource.register(ChangeLogSource)
    changes(tmp_path / "log", {0: [(1, "insert", "a", "1"), (2, "insert", "b", "1")], 1: [(3, "update", "a", "2"), (4, "heartbeat", "", None)]})
    table = VersionedTable(spark, f"file://{tmp_path}/table", "pk string, v string")
    seen = []

    def run():
        stream = spark.readStream.format("tidelog").option("path", str(tmp_path / "log")).load().withColumn("v", F.element_at("after", "v"))
        query = apply_stream(stream, table, f"{tmp_path}/checkpoint", ["pk"], ["seq"], ["v"], on_ddl=lambda row, _: seen.append(row.count()))
        query.awaitTermination()

    run()
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("b", "1")]
    changes(tmp_path / "log", {2: [(5, "delete", "b", None), (6, "ddl", "", None), (7, "insert", "c", "9")]})
    run()
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("c", "9")] and seen == [1]
    batch = spark.read.format("tidelog").option("path", str(tmp_path / "log")).option("databases", "other").load()
    assert batch.count() == 0


def test_guards():
    from tidelog.streaming.runner import Backpressure, CircuitBreaker, RateLimit, retry

    calls, pauses = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")
        return "ok"

    assert retry(fails, 3, 0.1, sleep=pauses.append) == "ok" and pauses == [0.1, 0.2]
    now = [0.0]
    breaker = CircuitBreaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        breaker.call(lambda: 1)
    now[0] = 11
    assert breaker.call(lambda: 1) == 1 and breaker.state == "closed"
    b = Backpressure()
    assert [b.observe(x) for x in (10, 55, 85, 60, 50, 20)] == ["running", "warning", "paused", "paused", "running", "running"]
    r = RateLimit(10, 5, lambda: now[0])
    assert r.wait(5) == 0 and r.wait(10) == 1.0
