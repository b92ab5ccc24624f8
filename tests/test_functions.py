"""Column functions against plain values."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing, keys, positions, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def fnv(data: bytes, bits: int) -> int:
    h, p = (2166136261, 16777619) if bits == 32 else (14695981039346656037, 1099511628211)
    for b in data:
        h = (h ^ b) * p % (1 << bits)
    return h


def test_hashes(spark):
    words = ["", "a", "foobar", "testdb.users", "é漢🙂", None]
    got = values(spark, [(w,) for w in words], "s string", hashing.fnv32(F.col("s")), hashing.fnv64(F.col("s")), hashing.record_crc32(F.col("s")))
    for w, (a, b, c) in zip(words, got):
        if w is None:
            assert (a, b, c) == (None, None, None)
        else:
            assert a == fnv(w.encode(), 32) == hashing.fnv32_of(w.encode()) and b == str(fnv(w.encode(), 64)) and c == zlib.crc32(w.encode())
    assert hashing.fnv32_of(b"a") == 3826002220


def test_row_identifiers(spark):
    rows = [(["id"], [], None, {"id": "42", "name": "A"}), ([], ["u"], {"u": "1"}, None), ([], [], None, {"b": "2", "a": None}), (["x"], [], {}, {"id": "1"})]
    schema = "p array<string>, u array<string>, before map<string,string>, after map<string,string>"
    c = F.col
    got = values(spark, rows, schema, keys.row_identifier(c("p"), c("u"), c("before"), c("after")), keys.identifier_kind(c("p"), c("u")))
    assert got == [("id=42", "pk"), ("u=1", "uk"), ("a=<nil>,b=2", "fullrow"), ("x=<nil>", "pk")]
    size = values(spark, rows, schema, keys.event_size(F.lit("ab"), F.lit("cd"), F.lit("t"), c("before"), c("after")))
    assert [s for (s,) in size] == [69 + 2 + 2 + 4 + 1, 69 + 2, 69 + 1 + 1 + 1, 69 + 3]


def test_positions(spark):
    schema = f"a {positions.POSITION}, b {positions.POSITION}"
    p = lambda **k: tuple(k.get(n) for n in "binlog_file binlog_pos lsn scn gtid ts seq resume_token change_lsn seq_val commit_time tx_id seq_no total".split())
    from decimal import Decimal

    files = [(p(binlog_file="b.999", binlog_pos=4), p(binlog_file="b.1000", binlog_pos=1)), (p(binlog_file="b.1", binlog_pos=5), p(binlog_file="b.1", binlog_pos=4)), (p(binlog_file="b.1", binlog_pos=4), p(binlog_file="b.1", binlog_pos=4))]
    assert [r for (r,) in values(spark, files, schema, positions.compare("mysql", F.col("a"), F.col("b")))] == [-1, 1, 0]
    lsn = [(p(lsn=Decimal(2**63 + 5)), p(lsn=Decimal(7)))]
    assert values(spark, lsn, schema, positions.compare("postgres", F.col("a"), F.col("b")), positions.is_zero(F.col("a"))) == [(1, False)]
    with pytest.raises(ValueError):
        positions.order_key("mongodb", F.col("a"))
    text_rows = [(p(tx_id="t1", seq_no=2, total=5), p())]
    assert values(spark, text_rows, schema, positions.position_text(F.col("a")), positions.is_zero(F.col("b"))) == [("t1:2:5", True)]
    hexes = [("00000000000000000000",), ("000000000000000000ff",), ("0000000000000000ffff",), ("f" * 20,), ("0000000000000000009f",)]
    assert [r for (r,) in values(spark, hexes, "x string", positions.lsn_next(F.col("x")))] == ["00000000000000000001", "00000000000000000100", "00000000000000010000", "0" * 20, "000000000000000000a0"]
    assert values(spark, [("16/B374D848",)], "x string", positions.postgres_lsn(F.col("x")))[0][0] == int("16B374D848", 16)


@pytest.mark.parametrize("pattern,value,expected", [("table*", "tab", False), ("*_suffix", "_suffix", True), ("db*_table", "db_table", True), ("*_*", "ab", False), ("table?", "table", False), ("*?", "", False), ("", "", True), ("a.c", "abc", False), ("*", "x\ny", True)])
def test_wildcards(pattern, value, expected):
    import re

    assert bool(re.search(text.wildcard_regex(pattern).replace(r"\z", r"\Z"), value)) == expected


def test_types_and_literals(spark):
    natives = [("DECIMAL(10,2)",), ("varchar(255)",), ("int",), ("geometry",), ("enum('date')",), ("bit(1)",), ("point",)]
    got = values(spark, natives, "t string", text.parse_type(F.col("t")), text.mysql_class(F.col("t")))
    assert tuple(got[0][0]) == ("DECIMAL", 10, 2) and tuple(got[1][0]) == ("VARCHAR", 255, 0)
    assert [c for _, c in got] == ["number", "string", "number", "geometry", "datetime", "bit", "number"]
    literals = [("NULL",), ("'O''Brien'",), ("12",), ("1.5",), ("SYSDATE",), ("''",)]
    assert values(spark, literals, "t string", text.sql_literal(F.col("t")), text.sql_literal_type(F.col("t"))) == [(None, "null"), ("O'Brien", "string"), ("12", "int"), ("1.5", "double"), ("SYSDATE", "raw"), ("", "string")]
    assert text.spark_type("decimal(10,2)") == "decimal(10,2)" and text.spark_type("bigint") == "bigint" and text.spark_type("uuid") == "string"


def test_sizes_and_names(spark):
    assert text.parse_size("80%", 1000) == 800 and text.parse_size("1.5 gb") == 1610612736 and text.parse_size("10KB") == 10240
    for bad in ("0GB", "-1MB", "5", "x", "0%", "101%"):
        with pytest.raises(ValueError):
            text.parse_size(bad, 10)
    rows = [("abcdefghij",), ("abc",), ("漢字漢字漢",)]
    assert [tuple(r) for r in values(spark, rows, "s string", text.truncated(F.col("s"), 4), text.truncated(F.col("s"), 2))] == [("a...", "ab"), ("abc", "ab"), ("漢...", "漢字")]
    assert values(spark, [("a`b",)], "s string", text.quoted(F.col("s"), "mysql"), text.quoted(F.col("s"), "sqlserver"), text.quoted(F.col("s"), "postgres")) == [("`a``b`", "[a`b]", '"a`b"')]
