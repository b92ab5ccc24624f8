"""Secret scan by an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  A
ledger in the shared store records which (blob, rule version) pairs were
scanned and what was found.  A run scans only the pairs that the ledger lacks,
appends them, and joins the findings back to all paths of each blob.

Defined results
    null or empty text   the blob of the empty text, no findings
    repeated rows        every row keeps its own result row
    equal texts          one blob, scanned once, reported for every path
    null path            kept, with its findings
    empty table          an empty result, the ledger gains nothing
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts

#: The rules, in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: A new value makes every blob unseen.
RULE_VERSION = "base-1"

SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Each hot blob's rows are dealt to this many join keys.
SALT = 16


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    Per kind the matches are leftmost and do not overlap; one that is too short
    is dropped after it has consumed its text.  A run of hex digits is maximal
    either way, so its least length stands in the pattern.
    """
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    found.sort()
    return [(KINDS[kind], start, end) for start, kind, end in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["blob", "spans"])


def blob_id(text):
    """The content address of a text column: SHA-256 in hex."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """Parquet rows (blob, rule_version, spans), one per scanned pair.

    Appends are Spark jobs with an atomic commit; a pair that two concurrent
    runs both appended is read once.
    """

    SCHEMA = f"blob string, rule_version string, spans {SPANS}"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def entries(self, rule_version: str) -> DataFrame:
        """What was scanned under ``rule_version``: (blob, spans)."""
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA).select("blob", "spans")
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.filter(F.col("rule_version") == rule_version).select("blob", "spans")

    def append(self, rows: DataFrame, rule_version: str) -> None:
        rows.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(self.path)


def scan_unseen(versions: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION, scanner=_scan) -> None:
    """Scans the blobs of ``versions`` (path, text) that the ledger lacks.

    The first shuffle moves addresses only and is pre-aggregated, so a blob with
    many paths is one row per task; the text of one path per unseen blob moves
    in the second.
    """
    addressed = versions.select("path", blob_id(F.col("text")).alias("blob"), "text")
    unseen = (
        addressed.groupBy("blob")
        .agg(F.min("path").alias("first_path"))
        .join(ledger.entries(rule_version).select("blob"), "blob", "left_anti")
    )
    first = addressed.alias("a").join(
        unseen.alias("u"), F.col("a.path").eqNullSafe(F.col("u.first_path")) & (F.col("a.blob") == F.col("u.blob")), "left_semi"
    )
    found = first.select("blob", "text").mapInArrow(scanner, f"blob string, spans {SPANS}")
    ledger.append(found.dropDuplicates(["blob"]), rule_version)  # rows repeated with id and text


def findings_by_path(versions: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) for every row of ``versions``; spans may be empty.

    Only blobs with findings are joined back, under salted keys, so that a blob
    of very many paths is dealt to several tasks.
    """
    paths = versions.select("path", blob_id(F.col("text")).alias("blob")).withColumn("salt", F.pmod(F.hash("path"), F.lit(SALT)))
    found = (
        ledger.entries(rule_version).filter(F.size("spans") > 0).dropDuplicates(["blob"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    return paths.join(found, ["blob", "salt"], "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def scan_secrets(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what is new in ``docs`` and returns (path, blob, spans) of all rows."""
    versions = docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text"))
    ledger = BlobLedger(docs.sparkSession, ledger_path)
    scan_unseen(versions, ledger, rule_version)
    return findings_by_path(versions, ledger, rule_version)


def spans_text(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(result: DataFrame) -> DataFrame:
    """The digest columns of a scan's (path, blob, spans)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return result.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]``.

    Rows are matched by the content address, so repeated ids are safe; the other
    columns and their order stay.  Overlapping spans are merged first.  A column
    ``n_chars`` follows the new length of the texts that change.
    """
    columns = docs.columns
    dirty = result.filter(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__blob"])
    dirty = dirty.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keyed = docs.withColumn("__blob", blob_id(F.col(text_col))).withColumn("__salt", F.pmod(F.hash(F.col(id_col)), F.lit(SALT)))
    joined = keyed.join(dirty, ["__blob", "__salt"], "left").select(*columns, "__spans")
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, spans = batch.columns
            masked = [t if s is None else mask(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(kept[at].to_pylist(), spans.to_pylist())]
            kept[at] = pa.array(masked, pa.string())
            if "n_chars" in columns:
                k = columns.index("n_chars")
                lengths = [n if s is None or t is None else len(t) for n, t, s in zip(kept[k].to_pylist(), masked, spans.to_pylist())]
                kept[k] = pa.array(lengths, kept[k].type)
            yield pa.RecordBatch.from_arrays(kept, columns)

    return joined.mapInArrow(run, docs.schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, as ``[kind]``."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """The digest of one text without ledger or shortcuts, for tests."""
    text = text or ""
    found = []
    for order, (pattern, least, group) in enumerate(((ASSIGN, ASSIGN_LEAST, 2), (ACCESS, ACCESS_LEAST, 0), (re.compile("[0-9a-f]+"), 32, 0))):
        found += [(m.start(), order, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    counts = [sum(k == x for _, k, _ in found) for x in range(3)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)
