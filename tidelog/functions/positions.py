"""Log positions: comparison, text forms and arithmetic.

A position is a struct of ``POSITION``; unset parts are null.  Unsigned 64-bit
numbers are decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POSITION = (
    "struct<binlog_file:string,binlog_pos:bigint,lsn:decimal(20,0),scn:decimal(20,0),gtid:string,ts:timestamp,seq:bigint,"
    "resume_token:binary,change_lsn:string,seq_val:string,commit_time:timestamp,tx_id:string,seq_no:bigint,total:bigint>"
)
#: The parts that order positions of each source kind.
ORDER = {
    "mysql": ("binlog_file", "binlog_pos"), "mariadb": ("binlog_file", "binlog_pos"), "postgres": ("lsn",), "oracle": ("scn",), "sqlserver": ("change_lsn", "seq_val"),
}


def order_key(kind: str, position: Column) -> Column:
    """A struct that sorts as positions do.

    Binlog files sort by their number, then by name, so ``.1000`` follows
    ``.999``.  Resume tokens and transaction-id positions have no order.
    """
    if kind not in ORDER:
        raise ValueError(f"positions of {kind} have no order")
    parts = [position[c] for c in ORDER[kind]]
    if "binlog_file" in ORDER[kind]:
        parts.insert(0, F.expr("1").cast("int") * F.coalesce(F.regexp_extract(parts[0], r"(\d+)$", 1).try_cast("bigint"), F.lit(0)))
    return F.struct(*[p.alias(f"o{k}") for k, p in enumerate(parts)])


def compare(kind: str, a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = order_key(kind, a), order_key(kind, b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def position_text(position: Column) -> Column:
    """``tx:seq:total`` where there is a transaction, else ``yyyyMMddHHmmss:seq``."""
    by_tx = F.concat_ws(":", position["tx_id"], F.coalesce(position["seq_no"], F.lit(0)).cast("string"), F.coalesce(position["total"], F.lit(0)).cast("string"))
    by_time = F.concat_ws(":", F.date_format(position["ts"], "yyyyMMddHHmmss"), F.coalesce(position["seq"], F.lit(0)).cast("string"))
    return F.when(F.coalesce(position["tx_id"], F.lit("")) != "", by_tx).otherwise(by_time)


def is_zero(position: Column) -> Column:
    """No part is set."""
    empty = lambda c: position[c].isNull() | (position[c].cast("string") == "")
    zero = lambda c: F.coalesce(position[c], F.lit(0)) == 0
    out = empty("binlog_file") & empty("gtid") & empty("tx_id") & empty("change_lsn") & position["ts"].isNull() & position["commit_time"].isNull() & position["resume_token"].isNull()
    for c in ("binlog_pos", "lsn", "scn", "seq"):
        out = out & zero(c)
    return out


def to_json(position: Column) -> Column:
    return F.to_json(position)


def from_json(text: Column) -> Column:
    return F.from_json(text, POSITION)


def mysql_gtid(server_id: Column, number: Column) -> Column:
    """``uuid:number`` of a 16-byte server id."""
    h = F.lower(F.hex(server_id))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat_ws(":", dashed, number.cast("string"))


def mariadb_gtid(domain: Column, server: Column, seq: Column) -> Column:
    return F.concat_ws("-", domain.cast("string"), server.cast("string"), seq.cast("string"))


def postgres_lsn(text: Column) -> Column:
    """The number of an LSN text ``high/low`` in hex."""
    parts = F.split(text, "/")
    high, low = (F.conv(parts[k], 16, 10).cast("decimal(20,0)") for k in (0, 1))
    return (high * F.lit(1 << 32).cast("decimal(11,0)") + low).cast("decimal(20,0)")


def lsn_hex(raw: Column) -> Column:
    """A ten-byte LSN as 20 hex digits."""
    return F.lower(F.hex(raw))


def lsn_next(lsn: Column) -> Column:
    """The hex LSN plus one, with carry over all its digits; the last wraps to 0."""
    width = F.length(lsn)
    trailing = F.length(F.regexp_extract(F.lower(lsn), "(f*)$", 1))
    head = F.substring(F.lower(lsn), F.lit(1), width - trailing - 1)
    digit = F.substring(F.lower(lsn), width - trailing, F.lit(1))
    raised = F.lower(F.hex((F.conv(digit, 16, 10).cast("int") + 1).cast("bigint")))
    zeros = lambda n: F.repeat(F.lit("0"), n)
    return F.when(trailing >= width, zeros(width)).otherwise(F.concat(head, raised, zeros(trailing)))
