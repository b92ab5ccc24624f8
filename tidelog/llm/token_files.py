"""Token ids in files of a frequency-ranked, byte-aligned variable-length code.

Ids are replaced by their rank of frequency over the whole corpus (ties to the
smaller id), so frequent ids are small numbers.  A rank takes as many whole
bytes as it needs, one to four, little-endian.  The lengths stand apart from the
data: two bits each, four to a control byte.  A reader turns all control bytes
of a file into lengths by one table lookup and gathers the data in numpy.

Files hold documents in ascending id order, each document ended by a mark.
Layout, little-endian: the magic text, counts of documents, tokens, control
bytes and data bytes (unsigned 64-bit each), per document a null flag (8 bits),
an id (64 bits) and a token count (64 bits), the control bytes, the data bytes.
The file ``ranks`` of a folder holds the id of every rank (unsigned 32-bit).

Defined results
    null or empty text   the end mark alone
    null ids             first in order
    repeated rows, ties  every row is a document of its own, in text order
    empty table          no file, an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import grouped, load, slices
from .common import remove, scratch

#: The start of every file, and its counts' layout.
MAGIC = b"RANKIDS1"
HEAD = np.dtype([("documents", "<u8"), ("tokens", "<u8"), ("control", "<u8"), ("data", "<u8")])
DOCUMENT = np.dtype([("null", "u1"), ("id", "<i8"), ("tokens", "<u8")])
#: Tokens after which a task begins its next file.
FILE_TOKENS = 4 << 20
#: Counts travel in blocks of this many ids.
BLOCK = 4096

#: LENGTHS[c]: the four byte lengths that the control byte c tells.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned ranks; lengths beyond the last are padding."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4)[None, :] <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks of :func:`pack`, by table lookup."""
    lengths = LENGTHS[control].reshape(-1)[:count].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((count, 4), np.uint8)
    for k in range(4):
        longer = lengths > k
        out[longer, k] = data[starts[longer] + k]
    return out.reshape(-1).view("<u4")


def frequency_ranks(ids: DataFrame, size: int) -> np.ndarray:
    """The id of every rank, from the counts of all rows of ``ids`` (binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(-(-size // BLOCK) * BLOCK, "<u8")
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                table[:size] += np.bincount(np.frombuffer(raw, "<u4"), minlength=size).astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(table) // BLOCK), pa.int32()), pa.array([x.tobytes() for x in table.reshape(-1, BLOCK)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<u8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    summed = ids.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()  # one table, of the vocabulary's size
    parts = {r["block"]: np.frombuffer(r["counts"], "<u8") for r in summed}
    counts = np.concatenate([parts[k] for k in sorted(parts)])[:size] if parts else np.zeros(size, "<u8")
    return np.argsort(-counts.astype(np.int64), kind="stable").astype("<u4")


class FileWriter:
    """Writes one file of documents; :meth:`close` returns its description."""

    def __init__(self):
        self.documents, self.parts, self.tokens = [], [], 0

    def add(self, doc_id, ranks: np.ndarray) -> None:
        self.documents.append((doc_id is None, doc_id or 0, len(ranks)))
        self.parts.append(ranks)
        self.tokens += len(ranks)

    def content(self) -> bytes:
        control, data = pack(np.concatenate(self.parts))
        head = np.array([(len(self.documents), self.tokens, len(control), len(data))], HEAD)
        return b"".join([MAGIC, head.tobytes(), np.array(self.documents, DOCUMENT).tobytes(), control, data])


def read_file(content: bytes, id_of_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, ids) of one file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    head = np.frombuffer(content, HEAD, 1, at)[0]
    at += HEAD.itemsize
    documents = np.frombuffer(content, DOCUMENT, int(head["documents"]), at)
    at += documents.nbytes
    control = np.frombuffer(content, np.uint8, int(head["control"]), at)
    data = np.frombuffer(content, np.uint8, int(head["data"]), at + len(control))
    return documents, id_of_rank[unpack(control, data, int(head["tokens"]))]


def _put(uri: str, content: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(content)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Writes ``docs`` to token files in ``folder``; (path, first token) of each.

    Texts are encoded once into the shared folder, which the count of the ids
    and the ranked files both read.  File names carry the task attempt, and only
    files of attempts that succeeded are listed, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    size = max(load(tokenizer_path).size, end_id + 1)
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in grouped(batches):
            for lo, hi in slices(batch.column(1)):
                ids, bounds = bpe.encode_batch(batch.column(1)[lo:hi])
                raw = [np.concatenate([ids[a:b], end]).astype("<u4").tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(raw, pa.binary())], ["doc_id", "ids"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, ids binary"
    raw_path = scratch(spark, "token-ids")
    docs.select(id_col, text_col).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(raw_path)
    encoded = spark.read.schema(schema).parquet(raw_path)

    id_of_rank = frequency_ranks(encoded.select("ids"), size)
    rank_of_id = np.zeros(size, "<u4")
    rank_of_id[id_of_rank] = np.arange(size)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [rank_of_id[np.frombuffer(raw, "<u4")] for raw in batch.column(1).to_pylist()]
            narrow = [p.astype("<u2").tobytes() if size <= 1 << 16 else p.tobytes() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(narrow, pa.binary())], ["doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, rows, writer = task.partitionId(), [], FileWriter()

        def close() -> None:
            nonlocal writer
            path = f"{folder}/ids-{part:06d}-{len(rows):05d}-{task.taskAttemptId()}"
            _put(path, writer.content())
            rows.append((part, len(rows), path, writer.tokens))
            writer = FileWriter()

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(doc_id, np.frombuffer(raw, "<u2" if size <= 1 << 16 else "<u4"))
                if writer.tokens >= FILE_TOKENS:
                    close()
        if writer.documents:
            close()
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "file", "path", "tokens"])

    _make_folder(spark, folder)
    sort = ["doc_id", "ids"]
    dealt = encoded.mapInArrow(ranked, schema).repartitionByRange("doc_id").sortWithinPartitions(*sort)
    found = sorted(map(tuple, dealt.mapInArrow(write, "part int, file int, path string, tokens long").collect()))  # a row per file
    _put(f"{folder}/ranks", id_of_rank.tobytes())
    remove(spark, raw_path)
    starts = np.cumsum([0, *(n for *_, n in found)]).tolist()
    return [(path, start) for (_, _, path, _), start in zip(found, starts)]


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of ``files``, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    return _decoded(spark, folder, files, schema, lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def token_digest(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _decoded(spark, folder, files, schema, lambda ids: zlib.crc32(ids), pa.int64())


def _decoded(spark: SparkSession, folder: str, files: list[tuple[str, int]], schema: str, value, kind: pa.DataType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks").select("content").first()[0]
    id_of_rank = np.frombuffer(bytes(ranks), "<u4")
    first = {path.rsplit("/", 1)[1]: start for path, start in files}
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                documents, ids = read_file(content, id_of_rank)
                counts = documents["tokens"].astype(np.int64)
                ends = np.cumsum(counts)
                own = [value(np.ascontiguousarray(ids[b - n : b])) for b, n in zip(ends.tolist(), counts.tolist())]
                doc_ids = pa.array(documents["id"], mask=documents["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first[path.rsplit("/", 1)[1]] + ends - counts), pa.array(counts), pa.array(own, kind)], names)

    content = spark.read.format("binaryFile").load([path for path, _ in files])
    return content.select("path", "content").mapInArrow(run, schema)
