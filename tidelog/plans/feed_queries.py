"""Registered queries of the change feed, and the same in SQL.

Queries go through the package's operators; the SQL is written independently.
Outputs are flat, counts are bigint, and every order is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing, keys, text
from ..operators import apply, encode, filters, lifecycle, metrics, model, routing, transforms
from ..sources import convert, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log over ``orders``."""
    rows = _read(spark, sf_dir, "orders")
    third, seventh = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7 == 0
    updated = {"st": F.lit("U"), "pr": F.col("o_totalprice") + 10}
    return model.change_log(rows, "o_orderkey", "o_orderdate", {"st": "o_orderstatus", "pr": "o_totalprice"}, updated, third, seventh)


_LOG = """WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS price, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
log AS (
 SELECT k*10 AS seq, 'insert' AS op, ts AS commit_ts, k AS pk, CAST(NULL AS VARCHAR) AS b_st, st AS a_st, CAST(NULL AS DOUBLE) AS b_pr, price AS a_pr FROM base
 UNION ALL
 SELECT k*10+1, 'update', ts + INTERVAL 1 DAY, k, st, 'U', price, price + 10 FROM base WHERE k % 3 = 0
 UNION ALL
 SELECT k*10+2, 'delete', ts + INTERVAL 2 DAY, k, CASE WHEN k % 3 = 0 THEN 'U' ELSE st END, NULL, CASE WHEN k % 3 = 0 THEN price + 10 ELSE price END, NULL FROM base WHERE k % 7 = 0)
"""
#: FNV-1a of an ASCII text expression in DuckDB.
_FNV = "list_reduce(list_transform(range(1,strlen({k})+1), lambda i: ascii(({k})[i])::HUGEINT), lambda h,b: (xor(h::BIGINT,b::BIGINT)::HUGEINT*16777619) % 4294967296, 2166136261::HUGEINT)::BIGINT"


def _fnv(k: str) -> str:
    return _FNV.format(k=k)


def _named(log: DataFrame) -> DataFrame:
    table = F.when(F.col("pk") % 3 == 0, "orders").when(F.col("pk") % 3 == 1, "orders_hist").otherwise("tmp_orders")
    return log.withColumn("db", F.lit("shop")).withColumn("tbl", table)


_NAMED = _LOG + ", named AS (SELECT *, 'shop' AS db, CASE WHEN pk % 3 = 0 THEN 'orders' WHEN pk % 3 = 1 THEN 'orders_hist' ELSE 'tmp_orders' END AS tbl FROM log) "


def _images(log: DataFrame) -> DataFrame:
    """The log as envelope columns, with map images."""
    row = lambda s: F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("status"), F.col(f"{s}_st"), F.lit("price"), F.col(f"{s}_pr").cast("string"))
    return log.select(
        "seq", "op", F.col("commit_ts"), "pk", F.lit("shop").alias("database"), F.lit("orders").alias("table"),
        F.when(F.col("op") != "insert", row("b")).alias("before"), F.when(F.col("op") != "delete", row("a")).alias("after"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("pk"), "ts", "event_id", kind.alias("op"), "value", "event_type", "props")


_EVENTS = "WITH e AS (SELECT user_id AS pk, ts, event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, value, event_type, props FROM events) "


@_query(_EVENTS + "SELECT pk, op AS last_op, value AS last_value, event_id AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1 AND op <> 'delete'")
def q01_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = apply.current_state(_events(spark, sf_dir).select("pk", "ts", "event_id", "op", "value"), ["pk"], ["ts", "event_id"])
    return state.select("pk", F.col("op").alias("last_op"), F.col("value").alias("last_value"), F.col("event_id").alias("last_seq"))


@_query(_LOG + "SELECT pk, a_st AS status, a_pr AS price, seq FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1 AND op <> 'delete'")
def q02_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.current_state(order_log(spark, sf_dir), ["pk"], ["commit_ts", "seq"]).select("pk", F.col("a_st").alias("status"), F.col("a_pr").alias("price"), "seq")


@_query(_NAMED + "SELECT seq, op, pk, db, tbl FROM named WHERE op <> 'delete' AND regexp_matches(db || '.' || tbl, '^shop\\.orders') AND NOT regexp_matches(db || '.' || tbl, 'tmp_')")
def q03_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = filters.RuleFilter(exclude_types=("delete",), include_tables=(r"^shop\.orders",), exclude_tables=("tmp_",))
    return _named(order_log(spark, sf_dir)).filter(rule.column(F.col("op"), F.col("db"), F.col("tbl"))).select("seq", "op", "pk", "db", "tbl")


@_query(_LOG + "SELECT seq, op, pk, a_st AS status, a_pr AS price FROM log WHERE op <> 'delete' AND a_pr > 100000 AND (a_st = 'O' OR a_st = 'U')")
def q04_expression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir).filter("op <> 'delete'")
    image = {"price": F.col("a_pr"), "status": F.col("a_st")}
    test = filters.Expression("after.price > 100000 && after.status == 'O' || after.status == 'U'", after=image.__getitem__)
    return log.filter(test.column()).select("seq", "op", "pk", F.col("a_st").alias("status"), F.col("a_pr").alias("price"))


@_query(_LOG + f"SELECT CAST({_fnv("CAST(pk AS VARCHAR) || '|'")} % 8 AS VARCHAR) AS part, count(*) AS n FROM log GROUP BY 1")
def q05_partition_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(order_log(spark, sf_dir))
    key = routing.partition_key("pk", F.col("database"), F.col("table"), F.col("before"), F.col("after"), ["id"])
    return rows.groupBy(routing.partition(key, 8).alias("part")).agg(F.count("*").alias("n"))


@_query(_NAMED + "SELECT CASE tbl WHEN 'orders' THEN 'sink_orders' WHEN 'orders_hist' THEN 'sink_hist' ELSE 'sink_default' END AS sink, count(*) AS n FROM named GROUP BY 1")
def q06_table_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = routing.table_route({"shop.orders": "sink_orders", "shop.orders_hist": "sink_hist"}, "sink_default", F.col("db"), F.col("tbl"))
    return _named(order_log(spark, sf_dir)).groupBy(sink.alias("sink")).agg(F.count("*").alias("n"))


@_query(_LOG + "SELECT pk, seq, op, commit_ts AS valid_from, lead(commit_ts) OVER (PARTITION BY pk ORDER BY commit_ts, seq) AS valid_to FROM log")
def q07_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.versions(order_log(spark, sf_dir), ["pk"], "commit_ts", ["commit_ts", "seq"]).select("pk", "seq", "op", F.col("commit_ts").alias("valid_from"), "valid_to")


def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lifecycle row for each inserted key: its state by the key modulo 6."""
    rows = order_log(spark, sf_dir).filter("op = 'insert'")
    states = F.array(*[F.lit(s) for s in ("pending", "snapshotting", "catching_up", "streaming", "error", "paused")])
    return rows.select(
        F.col("pk").alias("table_id"), F.get(states, (F.col("pk") % 6).cast("int")).alias("state"), F.col("commit_ts").alias("snapshot_position"),
        F.when(F.col("pk") % 5 != 0, F.col("commit_ts") + F.expr("INTERVAL 3 DAYS")).alias("stream_position"),
    )


_LIFE = _LOG + """, life AS (SELECT pk AS table_id, CASE pk % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'snapshotting' WHEN 2 THEN 'catching_up' WHEN 3 THEN 'streaming' WHEN 4 THEN 'error' ELSE 'paused' END AS state,
 commit_ts AS snapshot_position, CASE WHEN pk % 5 <> 0 THEN commit_ts + INTERVAL 3 DAY END AS stream_position FROM log WHERE op = 'insert') """


@_query(_LIFE + "SELECT state, count(*) AS n FROM life GROUP BY state")
def q08_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_counts(lifecycles(spark, sf_dir))


@_query(_LIFE + "SELECT min(CASE WHEN state = 'pending' THEN NULL WHEN state IN ('error','snapshotting') THEN snapshot_position ELSE coalesce(stream_position, snapshot_position) END) AS min_position FROM life")
def q09_least_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.least_position(lifecycles(spark, sf_dir))


@_query(_LOG + ", h AS (SELECT * FROM (VALUES (1, TIMESTAMP '1992-01-01'), (2, TIMESTAMP '1995-06-01'), (3, TIMESTAMP '1997-06-01')) t(version, valid_from)) SELECT l.seq, l.pk, l.commit_ts, h.version FROM log l ASOF LEFT JOIN h ON l.commit_ts >= h.valid_from")
def q10_schema_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = spark.createDataFrame([(1, "1992-01-01"), (2, "1995-06-01"), (3, "1997-06-01")], "version int, day string").select("version", F.col("day").cast("timestamp_ntz").alias("valid_from"))
    return apply.as_of(order_log(spark, sf_dir), history, "commit_ts", "valid_from", "version").select("seq", "pk", "commit_ts", "version")


@_query("SELECT 'shop_lineitem' AS idx, CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS doc_id, CASE l_returnflag WHEN 'A' THEN 'index' WHEN 'N' THEN 'update' ELSE 'delete' END AS act, l_quantity AS quantity FROM lineitem")
def q11_search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_returnflag") == "A", "insert").when(F.col("l_returnflag") == "N", "update").otherwise("delete")
    image = model.as_image("l_orderkey", "l_linenumber")
    return rows.select(
        encode.search_index("{database}_{table}", F.lit("SHOP"), F.lit("lineitem")).alias("idx"), encode.joined_key(image, ["l_orderkey", "l_linenumber"]).alias("doc_id"),
        encode.search_action(op).alias("act"), F.col("l_quantity").alias("quantity"),
    )


@_query(_LOG + "SELECT seq, 'cdc.orders' AS topic, CAST(pk AS VARCHAR) AS msg_key, op FROM log")
def q12_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _images(order_log(spark, sf_dir)), F.col
    return rows.select("seq", encode.message_topic("cdc", "table", c("database"), c("table")).alias("topic"), encode.message_key("id", c("database"), c("table"), c("before"), c("after")).alias("msg_key"), "op")


@_query(_LOG + "SELECT 'shop:orders:' || CAST(pk AS VARCHAR) AS store_key, CASE WHEN op = 'delete' THEN 'DEL' ELSE 'HSET' END AS command, count(*) AS n FROM log GROUP BY 1, 2")
def q13_store_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _images(order_log(spark, sf_dir)), F.col
    key = encode.store_key("{database}:{table}:{pk}", c("database"), c("table"), c("op"), c("before"), c("after"), ["id"])
    return rows.groupBy(key.alias("store_key"), encode.store_command(c("op")).alias("command")).agg(F.count("*").alias("n"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, upper(c_name) AS full_name, c_mktsegment AS segment, 'crm' AS origin, 5 AS fields FROM customer")
def q14_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.lit("insert").alias("op"), model.as_image("c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("after"), F.lit(None).cast(model.IMAGE).alias("before"))
    change = transforms.chained(
        transforms.mapped({"c_custkey": "user_id", "c_name": "full_name"}, {"c_name": F.upper}, {"origin": "crm"}),
        transforms.remove_field("c_nationkey"), transforms.rename_field("c_mktsegment", "segment"), transforms.add_field("kind", "customer"),
    )
    out = rows.transform(change)
    return out.select(*[F.col("after")[n].alias(n) for n in ("user_id", "full_name", "segment", "origin")], F.size("after").alias("fields"))


@_query("WITH m AS (SELECT min(o_orderkey) AS lo FROM orders) SELECT CAST(floor((o_orderkey - lo) / 1000) AS BIGINT) AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders, m GROUP BY 1")
def q15_range_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.range_chunks(_read(spark, sf_dir, "orders"), "o_orderkey", 1000)


@_query(_LOG + "SELECT count(*) AS events, count(DISTINCT nullif(CASE WHEN pk % 10 = 0 THEN '' ELSE CAST(pk AS VARCHAR) END, '')) AS transactions, min(commit_ts) AS first_ts, max(commit_ts) AS last_ts FROM log")
def q16_spill_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir).withColumn("tx_id", F.when(F.col("pk") % 10 == 0, "").otherwise(F.col("pk").cast("string")))
    return metrics.spill_stat(log, "tx_id", "commit_ts")


@_query(_LOG + """, snap AS (SELECT k AS pk, st AS status FROM base WHERE k % 2 = 0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC, seq DESC) AS rn FROM log WHERE op <> 'insert') WHERE rn = 1)
SELECT coalesce(l.pk, s.pk) AS pk, CASE WHEN l.pk IS NOT NULL THEN l.a_st ELSE s.status END AS status, CASE WHEN l.pk IS NOT NULL THEN 'log' ELSE 'snapshot' END AS origin
FROM snap s FULL JOIN last l ON s.pk = l.pk WHERE l.pk IS NULL OR l.op <> 'delete'""")  # fmt: skip
def q17_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("pk"), F.col("o_orderstatus").alias("status"))
    log = order_log(spark, sf_dir).filter("op <> 'insert'").withColumn("status", F.col("a_st"))
    return apply.snapshot_and_log(snap, log, ["pk"], ["commit_ts", "seq"], ["status"])


@_query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1, 2")
def q18_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,2)").alias("total"))


@_query("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, 'Customer#.*1.')")
def q19_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").filter(text.wildcard("Customer#*1?", F.col("c_name"))).select("c_custkey", "c_name")


@_query(_LOG + "SELECT CAST((row_number() OVER (ORDER BY seq) - 1) % 3 AS BIGINT) AS sink, seq FROM log")
def q20_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.round_robin(order_log(spark, sf_dir).select("seq"), ["seq"], 3).select(F.col("sink").cast("bigint").alias("sink"), "seq")


@_query(f"SELECT {_fnv('CAST(' + _fnv('o_orderstatus') + ' AS VARCHAR)')} % 3 AS sink, count(*) AS n FROM orders GROUP BY 1")
def q21_hash_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy(routing.hash_dispatch(F.col("o_orderstatus"), F.lit("orders"), 3).alias("sink")).agg(F.count("*").alias("n"))


@_query(f"SELECT o_orderkey, 'shop.orders:o_orderkey=' || CAST(o_orderkey AS VARCHAR) AS hash_key, {_fnv("'public.shop.orders:o_orderkey=' || CAST(o_orderkey AS VARCHAR)")} % 8 AS worker FROM orders")
def q22_row_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").withColumn("after", model.as_image("o_orderkey", "o_orderstatus")).withColumn("before", F.lit(None).cast(model.IMAGE))
    named = keys.row_identifier(F.array(F.lit("o_orderkey")), F.array().cast("array<string>"), F.col("before"), F.col("after"))
    full = keys.hash_key(F.lit("public"), F.lit("shop"), F.lit("orders"), named)
    return rows.select("o_orderkey", F.concat(F.lit("shop.orders:"), named).alias("hash_key"), routing.writer(full, F.lit(True), F.lit(""), 8).alias("worker"))


@_query("SELECT c_custkey, 4 + 3 + 8 + 64 + 9 + length(CAST(c_custkey AS VARCHAR)) + 6 + length(c_name) AS bytes FROM customer")
def q23_event_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name"))
    return rows.select("c_custkey", keys.event_size(F.lit("shop"), F.lit("crm"), F.lit("customer"), F.lit(None).cast(model.IMAGE), model.as_image("c_custkey", "c_name")).cast("bigint").alias("bytes"))


@_query("SELECT event_id, 'mysql:shop:' || strftime(ts, '%Y%m%d%H%M%S.%g') || ':' || CAST(event_id AS VARCHAR) AS id FROM events")
def q24_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", keys.event_id(F.lit("mysql"), F.lit("shop"), F.col("ts"), F.col("event_id")).alias("id"))


@_query(_LOG + "SELECT CAST(pk AS VARCHAR) AS txn, seq, row_number() OVER (PARTITION BY pk ORDER BY seq) - 1 AS txn_idx, count(*) OVER (PARTITION BY pk) AS txn_total, row_number() OVER (PARTITION BY pk ORDER BY seq) = 1 AS txn_begin, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) = 1 AS txn_end FROM log")
def q25_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir).select(F.col("pk").cast("string").alias("txn"), "seq")
    return apply.transaction_places(log, "txn", ["seq"])


@_query("SELECT l_orderkey, pair, before, after FROM (SELECT l_orderkey, (l_linenumber - 1) // 2 AS pair, l_quantity AS before, lead(l_quantity) OVER (PARTITION BY l_orderkey, (l_linenumber - 1) // 2 ORDER BY l_linenumber) AS after, (l_linenumber - 1) % 2 AS half FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_linenumber FROM lineitem)) WHERE half = 0 AND after IS NOT NULL")
def q26_paired_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.row_number().over(w) - 1).alias("place"))
    return apply.paired_rows(rows, ["l_orderkey"], "place", "l_quantity").select("l_orderkey", F.col("pair").cast("bigint").alias("pair"), "before", "after")


@_query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM events")
def q27_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("file"))
    return apply.forward_filled(rows, "file", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "file")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR event_type IS DISTINCT FROM p")
def q28_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.changed(_read(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@_query("SELECT n_name, 'db' || CAST(n_regionkey AS VARCHAR) AS db FROM nation WHERE n_regionkey IN (1, 2) AND NOT regexp_matches('db' || CAST(n_regionkey AS VARCHAR) || '.' || n_name, 'A$') AND regexp_matches('db' || CAST(n_regionkey AS VARCHAR) || '.' || n_name, '[A-Z]')")
def q29_capture_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").withColumn("db", F.concat(F.lit("db"), F.col("n_regionkey").cast("string")))
    scope = filters.DatabaseScope(("db1", "db2"), ("[A-Z]",), ("A$",))
    return rows.filter(scope.column(F.col("db"), F.col("n_name"))).select("n_name", "db")


@_query(_LOG + ", c AS (SELECT *, CASE pk % 4 WHEN 0 THEN 'snapshotting' WHEN 1 THEN 'streaming' WHEN 2 THEN 'paused' END AS state FROM log) SELECT seq, CASE WHEN state = 'snapshotting' THEN 'spill' WHEN state = 'streaming' THEN 'sink' ELSE 'discard' END AS action FROM c")
def q30_lifecycle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame([(0, "snapshotting"), (1, "streaming"), (2, "paused")], "table_id bigint, state string")
    return lifecycle.gated(order_log(spark, sf_dir).withColumn("table_id", F.col("pk") % 4), states).select("seq", "action")


@_query(_LOG + "SELECT seq, pk FROM log WHERE pk % 6 NOT IN (2, 4)")
def q31_ddl_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(2,), (4,)], "table_id bigint")
    return apply.unblocked(order_log(spark, sf_dir).withColumn("table_id", F.col("pk") % 6), blocked, ["table_id"]).select("seq", "pk")


@_query(_LOG + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC, seq DESC) AS rn FROM log WHERE op <> 'insert') WHERE rn = 1)
SELECT k AS pk, st FROM base WHERE k NOT IN (SELECT pk FROM last) UNION ALL SELECT pk, a_st FROM last WHERE op <> 'delete'""")  # fmt: skip
def q32_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a snapshot, and all that the log changes in it."""
    target = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), F.col("o_orderstatus").alias("st"))
    changes = order_log(spark, sf_dir).filter("op <> 'insert'").withColumn("st", F.col("a_st"))
    return apply.merged_into(target, changes, ["pk"], ["commit_ts", "seq"], ["st"])


@_query("SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 7) || '...' ELSE p_name END AS short, regexp_replace(p_type, '[^a-zA-Z0-9_]', '_', 'g') AS file, coalesce(nullif(p_brand, ''), 'none') AS brand FROM part")
def q33_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _read(spark, sf_dir, "part").select("p_partkey", text.truncated(c("p_name"), 10).alias("short"), text.file_name(c("p_type")).alias("file"), text.default_text(c("p_brand"), "none").alias("brand"))


@_query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'full' WHEN o_totalprice / 300000.0 >= 0.9 THEN 'pause_scheduling' WHEN o_totalprice / 300000.0 >= 0.8 THEN 'warning' ELSE 'normal' END AS level FROM orders")
def q34_cache_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.cache_level(F.col("o_totalprice"), F.lit(300000.0)).alias("level"))


@_query("SELECT t.oid, t.name FROM (VALUES (16,'bool'),(20,'int8'),(23,'int4'),(25,'text'),(701,'float8'),(1043,'varchar'),(1700,'numeric'),(3802,'jsonb'),(9,'unknown')) t(oid, name), region WHERE r_regionkey = 0")
def q35_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    oids = spark.createDataFrame([(x,) for x in (16, 20, 23, 25, 701, 1043, 1700, 3802, 9)], "oid int")
    return oids.select("oid", text.postgres_type(F.col("oid")).alias("name"))


@_query("SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), ('inf'::DOUBLE)) b(le) WHERE value IS NOT NULL GROUP BY 1, 2")
def q36_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_read(spark, sf_dir, "events"), "value", [10.0, 50.0, 100.0], ["event_type"]).select("event_type", "le", "n")


@_query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events FROM events GROUP BY 1, 2, 3")
def q37_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.windowed_counts(_read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@_query("SELECT s_suppkey, s_nationkey, CASE s_nationkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CASE s_nationkey % 3 WHEN 0 THEN 'REPLACE INTO `supplier` (`s_suppkey`, `s_name`) VALUES (''' || CAST(s_suppkey AS VARCHAR) || ''', ''' || s_name || ''')' WHEN 1 THEN 'UPDATE `supplier` SET `s_suppkey` = ''' || CAST(s_suppkey AS VARCHAR) || ''', `s_name` = ''' || s_name || ''' WHERE `s_suppkey` = ''' || CAST(s_suppkey AS VARCHAR) || '''' ELSE 'DELETE FROM `supplier` WHERE `s_suppkey` = ''' || CAST(s_suppkey AS VARCHAR) || '''' END AS statement FROM supplier")
def q38_sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("s_nationkey") % 3 == 0, "insert").when(F.col("s_nationkey") % 3 == 1, "update").otherwise("delete")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", op.alias("op"), model.as_image("s_suppkey", "s_name").alias("image"))
    return rows.select("s_suppkey", "s_nationkey", "op", encode.sql_statement("mysql", F.col("op"), F.lit("supplier"), F.col("image"), F.col("image"), ["s_suppkey", "s_name"], ["s_suppkey"], "replace").alias("statement"))


@_query("SELECT CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1")
def q39_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(F.element_at(convert.document_fields(F.col("props")), "k").alias("k")).agg(F.count("*").alias("n"))


@_query(f"SELECT {_fnv("CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus")} % 16 AS chunk, count(*) AS n FROM orders GROUP BY 1")
def q40_hash_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy(snapshot.hash_chunk([F.col("o_orderkey"), F.col("o_orderstatus")], 16).alias("chunk")).agg(F.count("*").alias("n"))


@_query("SELECT user_id, event_id, valid_to FROM (SELECT e.user_id, e.event_id, (SELECT max(h.event_id) FROM events h WHERE h.user_id = e.user_id AND h.event_type = 'signup' AND h.event_id <= e.event_id) AS valid_to FROM events e WHERE e.event_type = 'purchase')")
def q41_as_of_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    history = rows.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("from_id"), F.col("event_id").alias("valid_to"))
    return apply.as_of(rows.filter("event_type = 'purchase'").select("user_id", "event_id"), history, "event_id", "from_id", "valid_to", by=["user_id"])


@_query("SELECT c_name, CAST(CAST(c_custkey AS HUGEINT) * 10 AS VARCHAR) AS lsn, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS kind FROM customer WHERE c_acctbal < 0 OR NOT regexp_matches(c_mktsegment, 'BUILD')")
def q42_expression_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    test = filters.Expression("after.c_acctbal < 0 || after.c_mktsegment !~ 'BUILD'", after=lambda n: F.col(n))
    return rows.filter(test.column()).select("c_name", (F.col("c_custkey").cast("decimal(20,0)") * 10).cast("decimal(20,0)").cast("string").alias("lsn"), F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos").alias("kind"))


@_query("SELECT c_custkey, " + _fnv("c_name") + " AS hash FROM customer")
def q43_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", hashing.fnv32(F.col("c_name")).alias("hash"))
