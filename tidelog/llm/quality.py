"""Quality classifier: a Bradley-Terry model over preference pairs.

Each pair prefers a text of label 1 to one of label 0.  The model learns one
weight per text feature by logistic loss on feature differences; the weighted
sum is a text's strength.  The cut is the quantile of strengths, over the
training texts, that leaves the observed share of label 0 below it; a logistic
curve around the cut makes scores from 0 to 1.

Features are shares and ratios of the text alone, so they do not depend on the
size of the corpus.  Fitting reads every labelled row that is not held out: each
row of the more frequent label stands in as many pairs as make ``PAIRS`` in all,
one at least, and the rows of the other label take turns.  Newton's sums are
added up over the pairs in tasks, and the cut is counted over all strengths;
the driver holds sums alone.  Scoring is a map over all rows.

Defined results
    null or empty text   scored by the features of the empty text
    null label           not used for fitting
    one label only       every score is 1 or 0 accordingly; no labels: 0.5
    repeated rows        every row keeps its own result row
    empty table          an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release_memory, saved, texts

#: Pairs that the fit has at least, if there are so many.
PAIRS = 40_000
#: Rows of the rarer label below which all of them meet each row of the other, and how many a task has if they are more.
FEW, TURNS = 10_000, 5000
#: Rows of the other label in a task where the rarer ones are few.
LARGE = 500_000
#: Pairs in one array, ranges of strengths that are counted at once, and strengths that the driver sorts.
BLOCK, RANGES, SORTED = 1000, 2048, 10_000
#: Cost of large weights, and steps of Newton's method.
RIDGE, STEPS = 1e-3, 25

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_STOP = [ord(c) for c in ".,;:?"]
_QUOTE = [ord(c) for c in "'\"()-"]
_SYMBOL = [ord(c) for c in "#$%&*@^~+=<>{}[]\\/_`"]
NAMES = (
    "upper", "lower", "digit", "stops", "quotes", "symbols", "bangs", "bars", "spaces", "newlines", "beyond_ascii", "control",
    "log_words", "word_length", "distinct_words", "repeats", "distinct_lines", "top_word", "line_length", "tail_symbol_words", "short",
)


def features(text: str) -> np.ndarray:
    """The feature vector of a whole text."""
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    m = len(words)
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    return np.array([
        histogram[_UPPER].sum() / n, histogram[_LOWER].sum() / n, histogram[_DIGIT].sum() / n, histogram[_STOP].sum() / n,
        histogram[_QUOTE].sum() / n, histogram[_SYMBOL].sum() / n, histogram[33] / n, histogram[124] / n, histogram[32] / n,
        histogram[10] / n, histogram[128:].sum() / n, histogram[:9].sum() / n,
        np.log1p(m), min(40.0, len(text) / max(1, m)), len(counted) / max(1, m),
        sum(map(str.__eq__, words, words[1:])) / max(1, m), len(set(lines)) / max(1, len(lines)),
        max(counted.values(), default=0) / max(1, m), np.log1p(len(text) / max(1, len(lines))),
        sum(not w[-1].isalnum() for w in words[:]) / max(1, m), float(m < 10),
    ])


@dataclass(frozen=True)
class BradleyTerry:
    """A fitted model; ``cut`` and ``spread`` turn strengths into scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        strength = expanded(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip((strength - self.cut) / self.spread, -30, 30)))


def expanded(x: np.ndarray) -> np.ndarray:
    """Standardized features with their squares."""
    return np.concatenate([x, np.minimum(x * x, 16)], axis=1)


def held_out(doc_id) -> bool:
    """Whether a row is kept from learning: crc32 of its id, as text, mod 3 is 1."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_column(column):
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class Moments:
    """Number, mean and sum of squared deviations of rows, which can be merged."""

    def __init__(self, n: int = 0, mean=0.0, squares=0.0):
        self.n, self.mean, self.squares = n, mean, squares

    def add(self, n: int, mean: np.ndarray, squares: np.ndarray) -> None:
        if n:
            apart = mean - self.mean
            self.squares = self.squares + squares + apart * apart * (self.n * n / (self.n + n))
            self.mean = self.mean + apart * (n / (self.n + n))
            self.n += n

    def scale(self) -> np.ndarray:
        return np.sqrt(self.squares / self.n) + 1e-6


def shaped(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return expanded(np.clip((rows - mean) / scale, -8, 8))


def paired(many: np.ndarray, few: np.ndarray, turns: int, start: int = 0) -> Iterator[np.ndarray]:
    """Pairs (of ``many``, of ``few``): each row of ``many`` in ``turns``, those of ``few`` by turns from ``start`` on."""
    at = np.arange(start, start + len(many))
    for k in range(min(turns, len(few))):
        yield np.stack([many, few[(at + k) % len(few)]], axis=1)


def sums(d: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of pairs, and the sums of gradients and curvatures of their loss."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return len(d), -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d


def newton(width: int, total) -> np.ndarray:
    """The weights of least loss; ``total`` gives the :func:`sums` of all pairs."""
    w = np.zeros(width)
    for _ in range(STEPS):
        n, gradient, curvature = total(w)
        step = np.linalg.solve(curvature / n + RIDGE * np.eye(width), gradient / n + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def crossing(strengths: np.ndarray, labels: np.ndarray, weights: tuple[float, float], before: float, share: float, beyond: float | None) -> float:
    """The middle between the strength at which the weight of rows reaches ``share`` and the next one.

    ``weights`` are those of a row of label 0 and 1, ``before`` that of all weaker
    rows, and ``beyond`` the next strength after these, if any.
    """
    order = np.lexsort((-labels, strengths))
    ordered, of = strengths[order], labels[order]
    below = before + np.cumsum(of == 0) * weights[0] + np.cumsum(of == 1) * weights[1]
    k = min(int(np.searchsorted(below, share - 1e-12)), len(ordered) - 1)
    if k + 1 < len(ordered):
        beyond = ordered[k + 1]
    return float(ordered[k] if beyond is None else (ordered[k] + beyond) / 2)


def one_sided(good: int, bad: int, width: int = len(NAMES)) -> BradleyTerry:
    """The model where a label has no rows."""
    cut = 0.0 if good == bad else (-1e9 if good else 1e9)
    return BradleyTerry(np.zeros(width), np.ones(width), np.zeros(2 * width), cut, 1.0)


def fit(rows: np.ndarray, labels: np.ndarray, share_rejected: float) -> BradleyTerry:
    """Fits the pair model to rows at hand; ``share_rejected`` is label 0's share of all labels."""
    good, bad = rows[labels == 1], rows[labels == 0]
    if not len(good) or not len(bad):
        return one_sided(len(good), len(bad), rows.shape[1] if len(rows) else len(NAMES))
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    sign, many, few = (1, good, bad) if len(good) >= len(bad) else (-1, bad, good)
    pairs = [shaped(p[:, 0], mean, scale) - shaped(p[:, 1], mean, scale) for p in paired(many, few, -(-PAIRS // len(many)))]
    d = sign * np.concatenate(pairs)
    w = newton(d.shape[1], lambda w: sums(d, w))
    strengths = shaped(rows, mean, scale) @ w
    cut = crossing(strengths, labels, (share_rejected / len(bad), (1 - share_rejected) / len(good)), 0.0, share_rejected, None)
    return BradleyTerry(mean, scale, w, cut, float(strengths.std() / 4 + 1e-9))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BradleyTerry:
    """Fits on all labelled rows that are not held out.

    The label table is aggregated whole for the shares of the labels.  Only features
    are shuffled, not texts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out_column(F.col(id_col))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return one_sided(0, 0)
    share = counts.get(0, 0) / sum(counts.values())
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & ~held_out_column(F.col("id")))
    found = found.mapInArrow(_featured, f"id {dict(docs.dtypes)[id_col]}, features binary")
    rows = saved(found.join(known.groupBy("id").agg(F.min("label").alias("label")), "id"), "quality-rows")
    rows_of = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = rows_of.get(1, 0), rows_of.get(0, 0)
    if not good or not bad:
        return one_sided(good, bad)
    width = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments()
        for batch in batches:
            x = _stacked(batch.column(0))
            if len(x):
                own.add(len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0))
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[own.n], own.mean, own.squares]).tobytes()], pa.binary())], ["sums"])

    whole = Moments()
    for r in sorted(rows.select("features").mapInArrow(moments, "sums binary").collect()):
        x = np.frombuffer(r["sums"])
        whole.add(int(x[0]), x[1 : 1 + width], x[1 + width :])
    mean, scale = whole.mean, whole.scale()

    pairs = saved(_pairs(rows, good, bad), "quality-pairs")
    sign = 1 if good >= bad else -1

    def total(w: np.ndarray) -> tuple:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, own = 0, np.zeros(len(w) * (1 + len(w)))
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    p = np.frombuffer(blob).reshape(-1, 2, width)
                    m, gradient, curvature = sums(sign * (shaped(p[:, 0], mean, scale) - shaped(p[:, 1], mean, scale)), w)
                    n += m
                    own += np.concatenate([gradient, curvature.reshape(-1)])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["n", "sums"])

        parts = sorted(pairs.mapInArrow(add, "n long, sums binary").collect())
        x = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0)
        return sum(r["n"] for r in parts), x[: len(w)], x[len(w) :].reshape(len(w), len(w))

    w = newton(2 * width, total)

    def strength(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shaped(_stacked(batch.column(1)), mean, scale) @ w, pa.float64())], ["label", "strength"])

    strengths = saved(rows.select("label", "features").mapInArrow(strength, "label int, strength double"), "quality-strengths")
    spread = strengths.agg(F.stddev_pop("strength")).first()[0]
    return BradleyTerry(mean, scale, w, _cut(strengths, (share / bad, (1 - share) / good), share), float(spread / 4 + 1e-9))


def _pairs(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(pairs): features of rows of the more frequent label and of the other, in blocks.

    Both labels are dealt to tasks by the hash of the id; where the rarer one has few
    rows, each task has them all.
    """
    common = int(good >= bad)
    many, few = max(good, bad), min(good, bad)
    turns = -(-PAIRS // many)
    tasks = many // LARGE + 1 if few < FEW else few // TURNS
    own = F.pmod(F.xxhash64("id"), F.lit(tasks))
    places = F.when((F.col("label") != common) & F.lit(few < FEW), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(own.cast("int")))
    dealt = rows.select(F.explode(places).alias("task"), (F.col("label") == common).alias("common"), "id", "features").repartition(tasks, "task")
    dealt = dealt.sortWithinPartitions("task", "common", F.xxhash64("id"), "id", "features").select("task", "common", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rare, at = None, [], None
        for batch in batches:
            of_task, of_common, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _stacked(batch.column(2))
            ends = [0, *(np.flatnonzero((np.diff(of_task) != 0) | (np.diff(of_common.astype(np.int8)) != 0)) + 1).tolist(), len(x)]
            blocks = []
            for lo, hi in zip(ends, ends[1:]):
                if lo == hi:
                    continue
                if of_task[lo] != task:
                    task, rare, at = of_task[lo], [], None
                if not of_common[lo]:
                    rare.append(x[lo:hi])
                    continue
                if at is None:  # tasks that share the rarer rows begin at different ones
                    rare = [np.concatenate(rare)]
                    at = int(task) * len(rare[0]) // tasks
                for k in range(lo, hi, BLOCK):
                    part = x[k : min(k + BLOCK, hi)]
                    blocks += [p.tobytes() for p in paired(part, rare[0], turns, at)]
                    at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["pairs"])
        release_memory()

    return dealt.mapInArrow(run, "pairs binary")


def _cut(strengths: DataFrame, weights: tuple[float, float], share: float) -> float:
    """:func:`crossing` over all strengths: ranges of them are counted, ever finer, until few are left."""
    low, high, n = strengths.agg(F.min("strength"), F.max("strength"), F.count("*")).first()
    before, s = 0.0, F.col("strength")
    within = lambda: strengths.filter(s.between(low, high))
    while n > SORTED and low < high:
        place = F.least(F.floor((s - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
        ranges = within().groupBy(place.alias("place")).agg(F.min(s).alias("low"), F.max(s).alias("high"), F.sum("label").alias("good"), F.count("*").alias("n")).collect()
        for r in sorted(ranges):
            low, high, n = r["low"], r["high"], r["n"]
            more = before + (n - r["good"]) * weights[0] + r["good"] * weights[1]
            if more >= share - 1e-12:
                break
            before = more
    left = within().groupBy("strength", "label").count().collect()
    beyond = strengths.filter(s > high).agg(F.min(s)).first()[0]
    own, of, times = (np.array([r[k] for r in left]) for k in ("strength", "label", "count"))
    return crossing(np.repeat(own, times), np.repeat(of, times), weights, before, share, beyond)


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(NAMES))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).astype(np.float64).tobytes() for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "features"])
        release_memory()


def score_documents(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(1))
            rows = np.array([features(t) for t in whole]).reshape(len(whole), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out_column(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(batch.schema.names.index(text_col)))
            rows = np.array([features(t) for t in whole]).reshape(len(whole), len(NAMES))
            yield batch.filter(pa.array(model.score(rows) >= 0.5))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
