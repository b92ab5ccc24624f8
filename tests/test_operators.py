"""Filters, transforms, routing, apply, encodings and lifecycles."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelog.operators import apply, encode, filters, lifecycle, metrics, routing, transforms
from tidelog.sources import snapshot


def images(spark, rows):
    return spark.createDataFrame(rows, "before map<string,string>, after map<string,string>")


def matches(spark, expression, **after):
    df = spark.createDataFrame([({k: v for k, v in after.items()},)], "after map<string,string>").select(F.lit("users").alias("table"), F.lit("db1").alias("database"), "after")
    test = filters.Expression(expression, {"table": F.col("table"), "database": F.col("database"), "op": F.lit("insert")}, after=lambda n: F.element_at("after", n))
    return df.select(test.column()).first()[0]


@pytest.mark.parametrize("expression,after,expected", [
    ("table == 'users'", {}, True), ("table == 'orders'", {}, False), ("after.age > 18", {"age": "25"}, True), ("after.status == 'active'", {"status": "active"}, True),
    ("after.email =~ '.*@example.com'", {"email": "user@example.com"}, True), ("after.x == null", {}, True), ("after.x =~ 'nil'", {}, True), ("after.x > 1", {"x": "word"}, False),
    ("after.a == 1 || after.a == 2 && after.b == 3", {"a": "1", "b": "4"}, False), ("", {}, True), ("status != 'x'", {"status": "y"}, True),
])
def test_expressions(spark, expression, after, expected):
    assert matches(spark, expression, **after) is expected


def test_expression_errors(spark):
    with pytest.raises(ValueError):
        filters.Expression("nothing").column()
    with pytest.raises(ValueError):
        filters.portable_regex(r"(?=x)")
    strict = filters.Expression("after.x > 1", after=lambda n: F.element_at("after", n), strict=True)
    with pytest.raises(PySparkException):
        spark.createDataFrame([({"x": "word"},)], "after map<string,string>").select(strict.column()).collect()


def test_scopes(spark):
    rows = spark.createDataFrame([("db1", "users"), ("db2", "users"), ("db1", "orders")], "d string, t string")
    found = lambda s: [tuple(r) for r in rows.filter(s.column(F.col("d"), F.col("t"))).collect()]
    assert len(found(filters.DatabaseScope())) == 3
    assert found(filters.DatabaseScope(("db1",), (r"db1\..*",), (r"db1\.users",))) == [("db1", "orders")]
    assert found(filters.DatabaseScope(("*", "db1"))) == [("db1", "users"), ("db1", "orders")]
    assert found(filters.DatabaseScope(("*",), ("(",))) == []
    assert found(filters.TableScope(("db2.users",))) == [("db2", "users")]
    assert filters.parse_scope(["a.b.c"]) == [("a", "b.c")]
    with pytest.raises(ValueError):
        filters.parse_scope(["a"])


def test_transforms(spark):
    df = images(spark, [(None, {"id": "1", "old_name": "test", "keep": "value"}), ({"old_name": "x"}, None), ({}, {})])
    out = df.transform(transforms.mapped({"old_name": "new_name", "id": "user_id"}, static={"src": "s"})).collect()
    assert out[0].after == {"user_id": "1", "new_name": "test", "keep": "value", "src": "s"} and out[1].before == {"new_name": "x"} and out[1].after is None and out[2].after == {}
    failing = transforms.mapped({"id": "n"}, {"id": lambda v: v.try_cast("int").cast("string")})
    assert images(spark, [(None, {"id": "x"}), (None, {"id": "7"})]).transform(failing).collect() == [(None, {"id": "x"}), (None, {"n": "7"})]
    clash = images(spark, [(None, {"a": "1", "b": "2"})]).transform(transforms.rename_field("a", "b")).first()
    assert clash.after == {"b": "1"}
    with pytest.raises(ValueError):
        transforms.mapped({"a": "c", "b": "c"})
    with pytest.raises(NotImplementedError):
        transforms.custom("lua")
    registry = transforms.TransformRegistry()
    registry.register("drop", transforms.remove_field("keep"))
    assert "keep" not in df.transform(registry.get("drop")).first().after and registry.names() == ["drop"]


def test_routing(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"))
    out = [tuple(r) for r in routing.round_robin(df.repartition(7), ["seq"], 3).select("seq", "sink").collect()]
    assert sorted(out) == [(k, k % 3) for k in range(1000)]
    with pytest.raises(ValueError):
        routing.partition(F.lit("x"), 0)
    assert routing.broadcast(df.limit(2), ["a", "b"]).count() == 4


def test_apply(spark):
    log = spark.createDataFrame([(1, 1, "insert", "a"), (1, 2, "update", "b"), (2, 1, "insert", "c"), (2, 2, "delete", None), (3, 1, "update", "z")], "pk int, seq int, op string, v string")
    assert sorted(map(tuple, apply.current_state(log, ["pk"], ["seq"]).select("pk", "v").collect())) == [(1, "b"), (3, "z")]
    target = spark.createDataFrame([(2, "old"), (3, "old"), (9, "old")], "pk int, v string")
    result = lambda s: sorted(map(tuple, apply.merged_into(target, log, ["pk"], ["seq"], ["v"], strategy=s).collect()))
    assert result("upsert") == [(1, "b"), (3, "z"), (9, "old")]
    assert result("insert") == [(1, "b"), (2, "old"), (3, "old"), (9, "old")]
    assert result("update") == [(3, "z"), (9, "old")]
    moved = spark.createDataFrame([("update", "1", "2"), ("update", "1", "1"), ("delete", "3", None)], "op string, bk string, ak string")
    assert sorted(map(tuple, apply.moved_keys(moved, "bk", "ak").select("op", "key").collect())) == [("delete", "1"), ("delete", "3"), ("insert", "2"), ("update", "1")]


def test_change_table_pairs(spark):
    from tidelog.sources import convert

    rows = spark.createDataFrame([("i", "01", 1, 3, {"a": "1", "__$op": "3"}), ("i", "01", 1, 4, {"a": "2"}), ("i", "02", 1, 2, {"a": "5"}), ("i", "03", 1, 1, {"a": "5"})], "instance string, lsn string, seqval int, operation int, image map<string,string>")
    out = sorted((r.lsn, r.op, r.before, r.after) for r in convert.change_table_events(rows).collect())
    assert out == [("01", "update", {"a": "1"}, {"a": "2"}), ("02", "insert", None, {"a": "5"}), ("03", "delete", {"a": "5"}, None)]


def test_binlog_rows_and_tuples(spark):
    from tidelog.sources import convert

    rows = spark.createDataFrame([("f", 1, "update", ["id", "v"], [["1", "a"], ["1", "b"], ["2", "x"]]), ("f", 2, "insert", ["id", "v", "w"], [["3", "c"]])], "file string, pos bigint, kind string, columns array<string>, rows array<array<string>>")
    out = sorted(((r.pos, r.op, r.before, r.after) for r in convert.binlog_events(rows).collect()), key=str)
    assert out == [(1, "update", {"id": "1", "v": "a"}, {"id": "1", "v": "b"}), (2, "insert", None, {"id": "3", "v": "c"})]
    import struct

    cells = [("b", 700, struct.pack(">f", 1.5)), ("b", 701, struct.pack(">d", -2.25)), ("b", 23, struct.pack(">i", -7)), ("b", 20, struct.pack(">q", -1)), ("b", 21, struct.pack(">h", 300)), ("b", 16, b"\x01"), ("n", 23, None)]
    df = spark.createDataFrame(cells, "kind string, oid int, raw binary")
    assert [r[0] for r in df.select(convert.tuple_value(F.col("kind"), F.lit(None).cast("string"), F.col("oid"), F.col("raw"))).collect()] == ["1.5", "-2.25", "-7", "-1", "300", "true", None]


def test_encodings(spark):
    row = spark.createDataFrame([("update", {"id": "42"}, {"id": "42", "name": "O'B", "nil": None})], "op string, before map<string,string>, after map<string,string>")
    c = F.col
    got = row.select(
        encode.message_key("id", F.lit("d"), F.lit("t"), c("before"), c("after"), "json"), encode.joined_key(c("after"), ["id", "missing", "name"]),
        encode.store_key("{database}:{table}:{pk}", F.lit("mydb"), F.lit("users"), c("op"), c("before"), c("after"), []),
        encode.sql_statement("postgres", F.lit("insert"), F.lit("t"), c("before"), c("after"), ["id", "name"], ["id"]),
        encode.bulk_lines(F.lit("update"), F.lit("i"), F.lit("42"), F.struct(F.lit(1).alias("a"))), encode.document_id(F.lit(None).cast("map<string,string>"), c("before"), F.lit(None).cast("map<string,string>"), ["id"]),
    ).first()
    assert got[0] == '{"database":"d","table":"t","key":"42"}' and got[1] == "42_O'B" and got[2] == "mydb:users:"
    assert got[3] == """INSERT INTO "t" ("id", "name") VALUES ('42', 'O''B') ON CONFLICT ("id") DO UPDATE SET "name" = EXCLUDED."name\""""
    assert got[4] == '{"update":{"_index":"i","_id":"42","retry_on_conflict":3}}\n{"doc":{"a":1},"doc_as_upsert":true}\n' and got[5] == "42"


def test_lifecycle():
    s = lifecycle.Scheduler()
    s.add("db.t")
    for move in (s.start_snapshot, s.snapshot_done, s.caught_up, s.pause):
        move("db.t")
    s.resume("db.t")
    assert s.tables["db.t"].state == "streaming"
    with pytest.raises(ValueError):
        s.restart("db.t")
    s.failed("db.t", "boom")
    assert [t.last_error for t in s.errors()] == ["boom"]
    s.retry("db.t")
    assert s.tables["db.t"].retries == 1 and s.tables["db.t"].state == "pending"
    with pytest.raises(ValueError):
        s.caught_up("db.t")
    s.failed("db.t", "again")
    s.skip_error("db.t")
    assert s.tables["db.t"].state == "catching_up"


def test_snapshot_plans():
    assert snapshot.chunk_bounds(1, 10, 4) == [(1, 4), (5, 8), (9, 10)] and snapshot.chunk_bounds(None, None) == []
    assert [snapshot.should_snapshot(m, p) for m in ("never", "initial", "always", "when_needed", "x") for p in (False, True)] == [False, False, True, False, True, True, True, False, False, False]
    assert snapshot.hash_predicate("oracle", ["a", "b"], 1, 4) == "MOD(ORA_HASH(a || b), 4) = 1" and snapshot.hash_predicate("x", ["a"], 0, 2) == ""


def test_nodes(spark):
    nodes = spark.createDataFrame([("b", 3, "2020-01-01 00:00:50"), ("a", 3, "2020-01-01 00:00:55"), ("c", 10, "2020-01-01 00:00:00")], "node_id string, tasks int, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    assert metrics.alive_nodes(nodes, F.lit("2020-01-01 00:01:00").cast("timestamp")).count() == 2
    assert tuple(metrics.least_loaded(nodes).first()) == ("a", 3)
