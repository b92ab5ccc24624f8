"""Near-duplicate documents by consistent weighted sampling.

A document is the weighted set of its five-word shingles (lower-cased words
between white space; under five words, one shingle of all).  A shingle weighs its
count times its inverse document frequency, which is the mean over its words.
Every word is counted over all documents, in a shuffle.  Words with less than
``RARE_SHARE`` of all counts weigh alike, as if they had just that share: so the
table of the others has at most 1 / ``RARE_SHARE`` words, whatever the corpus, and
a word's weight depends on its share alone.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per
document, each equal for two documents with the probability of their weighted
Jaccard similarity.  Bands of samples are bucket keys.  In each bucket the
members are compared with one centre, drawn anew in each bucket.  Members that
no centre brought together meet again by weighted prefixes: with shingles in one
order, the rare ones first, two texts of similarity t share a shingle in the part
of each before the last t of its weight, and from the first such shingle on both
must hold enough weight for the overlap.  So what only shares a common passage
does not meet.  There, too, all members of a shingle are first compared with one,
the lightest, and only those still apart in pairs.  Every link that counts is
verified by the exact weighted Jaccard similarity of the whole texts.  Classes
are the connected components of the verified links.

Equal texts are one vertex throughout, so copies never meet in pairs.

Defined results
    null, empty or blank text   no shingles: a class of its own
    equal texts                 one class
    repeated rows               every row keeps its own result row
    null ids                    kept; a class id is the least id that is not null
    empty table                 an empty result
    further columns             ignored, whatever their names
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import release_memory, saved, texts
from .components import components, extended

WIDTH = 5
THRESHOLD = 0.8
#: At similarity 0.8 a pair shares no bucket with a chance of 4.9e-5.
BANDS, ROWS = 25, 5
#: Words with a lower share of the counts of all words weigh alike.
RARE_SHARE = 1e-6
#: Hashes of words that a task holds before it counts and sends them.
HELD = 2_000_000
#: Buckets of shingle frequencies; they only decide the order of shingles in a prefix.
BUCKETS = 1 << 18
#: A hot centre's members are dealt to this many tasks.
SALT = 16
#: Rows up to which a side is sent to every executor.
BROADCAST_ROWS = 100_000
#: Allows for rounding where weights are compared before the exact check.
_NEARLY = 1 - 1e-9
_TABLE_BITS = 16
_BLOCK = 1 << 12
#: With fewer shingles all their values are worked out; it decides no sample.
_FEW = 100


# The bytes that separate words, and white space beyond ASCII.
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: An odd base of the byte polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 4
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words between white space.

    All words are hashed at once: a word's hash is the difference of two running
    sums of bytes times powers of the base, moved to power 0 and scrambled.
    """
    text = text.lower()
    if not text.isascii() and _WIDE_SPACE.search(text):
        text = " ".join(text.split())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    _SPACES.take(raw, mode="clip", out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(15, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    own = np.add(raw, np.uint64(1), out=sums[1:])
    own *= up[: len(raw)]
    np.cumsum(own, out=own)
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class WordWeights:
    """Inverse document frequencies of words by their sorted hashes, and that of all other words."""

    hashes: np.ndarray
    values: np.ndarray
    other: float

    @functools.cached_property
    def _starts(self) -> tuple[np.uint64, np.ndarray, int]:
        """How far hashes are shifted to their first bits, where those with the same ones begin, and the most of these."""
        bits = min(20, max(1, len(self.hashes)).bit_length())
        starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return np.uint64(64 - bits), starts.astype(np.int32), int(np.diff(starts, append=len(self.hashes)).max())

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), self.other)
        shift, starts, most = self._starts
        at = starts[(words >> shift).astype(np.intp)]
        found = self.hashes.take(at, mode="clip")
        left = np.flatnonzero(found < words)
        for _ in range(most):
            if not len(left):
                break
            at[left] += 1
            found[left] = self.hashes.take(at[left], mode="clip")
            left = left[(found[left] < words[left]) & (at[left] < len(self.hashes))]
        return np.where(found == words, self.values.take(at, mode="clip"), self.other)


def weighted_shingles(text: str, idf: WordWeights) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their weights; none for a blank text."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words, np.zeros(0)
    of_word = idf.of(words)
    width = min(WIDTH, n)
    runs = np.full(n - width + 1, width, np.uint64)
    weight = np.zeros(n - width + 1)
    for k in range(width):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += words[k : n - width + 1 + k]
        weight += of_word[k : n - width + 1 + k]
    hashes = mixed(runs)
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(first, append=len(hashes)) * weight[order[first]] / width


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1e-300, a[1].sum() + b[1].sum() - both))


@functools.cache
def _draws():
    """The random variables of the samples: a multiplier per sample, which deals
    shingles to table entries, tables of (1/r, beta) and (r, ln c + r (beta - 1)),
    and one of a bit less than ln c - r.  Each pair is one complex number, so that
    one lookup reads both."""
    random = np.random.default_rng(11)
    size = 1 << _TABLE_BITS
    multipliers = random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    r, beta, c = random.gamma(2.0, 1.0, size), random.random(size), random.gamma(2.0, 1.0, size)
    least = (np.log(c) - r - 1e-3).astype(np.float32)
    return multipliers, (1 / r + 1j * beta).astype(np.complex64), (r + 1j * (np.log(c) + r * (beta - 1))).astype(np.complex64), least


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One value per sample, the scrambled (shingle, step) that it selects.

    With t = floor(ln w / r + beta), the shingle of least ln c - r (t - beta + 1)
    is selected.  Ties fall to the smaller shingle hash, for hashes come sorted.
    """
    multipliers = _draws()[0]
    k = len(multipliers)
    ln_w = np.log(weights).astype(np.float32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    chosen, steps, left = np.zeros(k, np.intp), np.zeros(k, np.float32), np.arange(k)
    if len(hashes) >= _FEW:
        found, *of_found = _below(short, ln_w, multipliers, np.float32(np.log(6 / weights.sum())))
        chosen[found], steps[found] = of_found
        left = np.flatnonzero(~found)
    if len(left) and len(hashes):
        chosen[left], steps[left] = _least(short, ln_w, multipliers[left])
    selected = hashes[chosen] if len(hashes) else np.zeros(k, np.uint64)
    return mixed(selected + mixed(steps.astype(np.int64).astype(np.uint64) + np.arange(k, dtype=np.uint64)))


def _least(short: np.ndarray, ln_w: np.ndarray, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sample's shingle, and its step, by the values of all shingles."""
    _, steps_of, values_of, _ = _draws()
    k = len(multipliers)
    best, chosen, steps = np.full(k, np.inf, np.float32), np.zeros(k, np.intp), np.zeros(k, np.float32)
    row = np.arange(k)
    for at in range(0, len(short), 256):
        index = ((short[None, at : at + 256] * multipliers[:, None]) >> np.uint32(32 - _TABLE_BITS)).astype(np.intp)
        drawn = steps_of.take(index, mode="clip")
        t = drawn.real * ln_w[at : at + 256]
        t += drawn.imag
        np.floor(t, out=t)
        drawn = values_of.take(index, mode="clip")
        value = drawn.imag - drawn.real * t
        least = value.argmin(axis=1)
        found = value[row, least]
        better = found < best
        best = np.where(better, found, best)
        chosen = np.where(better, at + least, chosen)
        steps = np.where(better, t[row, least], steps)
    return chosen, steps


def _below(short: np.ndarray, ln_w: np.ndarray, multipliers: np.ndarray, bound: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which samples' least value lies below ``bound``, and the places and steps of these.

    A value is at least ln c - r - ln w, so only shingles for which this lies below
    the bound have theirs worked out.  The least value is exponential with the sum
    of weights: a bound of ln(6 / sum) misses one sample in 400, to be done in full.
    """
    _, steps_of, values_of, least_of = _draws()
    k, n = len(multipliers), len(short)
    bounds = ln_w + bound
    rows, places, indices = [], [], []
    several = max(1, (1 << 16) // n)
    for at in range(0, k, several):
        index = ((short * multipliers[at : at + several, None]) >> np.uint32(32 - _TABLE_BITS)).astype(np.intp)
        flat = np.flatnonzero(least_of.take(index, mode="clip") < bounds)
        row = flat // n
        places.append(flat - row * n)
        rows.append(row + at)
        indices.append(index.reshape(-1)[flat])
    row, place, index = np.concatenate(rows), np.concatenate(places), np.concatenate(indices)
    drawn = steps_of.take(index, mode="clip")
    t = drawn.real * ln_w[place]
    t += drawn.imag
    np.floor(t, out=t)
    drawn = values_of.take(index, mode="clip")
    value = drawn.imag - drawn.real * t
    below = np.flatnonzero(value < bound)
    row, place, t, value = row[below], place[below], t[below], value[below]
    ends = np.searchsorted(row, np.arange(k + 1))
    found = ends[1:] > ends[:-1]
    firsts = ends[:-1][found]
    least = np.minimum.reduceat(value, firsts) if len(firsts) else value
    hit = np.flatnonzero(value == np.repeat(least, (ends[1:] - ends[:-1])[found]))
    hit = hit[np.searchsorted(hit, firsts)]  # the first of equal ones
    return found, place[hit], t[hit]


def bucket_keys(drawn: np.ndarray) -> np.ndarray:
    """One key per band, which also tells the bands apart."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in drawn.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def bucket_counts(docs: DataFrame, found, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each of ``BUCKETS`` hash buckets occurs, and how many texts
    have any; ``found`` gives the hashes of a text.

    Each task counts its rows in one array; the arrays meet block by block.
    What reaches the driver is the table, of a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in texts(batch.column(0)):
                own = (found(t) & np.uint64(BUCKETS - 1)).astype(np.int64)
                table[own] += 1  # once for each bucket, however often it occurs
                rows += len(own) > 0
        if rows:
            blocks = [*range(BUCKETS // _BLOCK), -1]
            parts = [*table.reshape(-1, _BLOCK), np.array([rows])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([x.astype("<u8").tobytes() for x in parts], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, "<u8")
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    summed = docs.select(text_col).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    parts = {r["block"]: np.frombuffer(r["counts"], "<u8") for r in summed}
    rows = int(parts.pop(-1)[0]) if -1 in parts else 0
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(BUCKETS), rows


def word_idf(docs: DataFrame, text_col: str = "text", share: float = RARE_SHARE) -> WordWeights:
    """Inverse document frequencies, by counts of every word over all documents.

    Tasks count before the shuffle.  What reaches the driver are the words with at
    least ``share`` of the sum of all counts, so at most 1 / ``share`` of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

        held, size, rows = [], 0, 0
        for batch in batches:
            for t in texts(batch.column(0)):
                own = np.unique(word_hashes(t))  # once for each word, however often it occurs
                held.append(own)
                size += len(own)
                rows += len(own) > 0
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()
        if rows:  # the number of texts stands without a word
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["word", "n"])
        release_memory()

    counted = saved(docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    named = F.col("word").isNotNull()
    total, rows = counted.agg(F.sum(F.when(named, F.col("n"))), F.sum(F.when(~named, F.col("n")))).first()
    least = max(1.0, share * (total or 0))
    found = counted.filter(named & (F.col("n") >= least)).toArrow()
    hashes, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    idf = lambda n: np.log(((rows or 0) + 1) / (n + 1.0)) + 0.1
    return WordWeights(hashes[order], idf(n[order]).astype(np.float32), float(idf(least)))


def vertices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, text); equal texts have equal nodes, blank ones a null node."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), _node(text).alias("node"), text.alias("text"))


def _node(text: Column) -> Column:
    return F.when(text.rlike(r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]"), F.unhex(F.md5(text)))


def sketches(rows: DataFrame, idf: WordWeights) -> DataFrame:
    """(node, keys) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            keys = [bucket_keys(samples(*weighted_shingles(t, idf))) for t in texts(batch.column(1))]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])
        release_memory()

    # blank texts, whose node is null, go on the other side: here the test would hash each text again
    return rows.select("node", "text").mapInArrow(run, "node binary, keys array<long>").dropDuplicates(["node"])


def _sized(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """``nodes``, to be sent to every executor if their number allows, and whether it does."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(nodes) if few else nodes), few


def one_text_each(rows: DataFrame, ids: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of each ``node`` of ``needed``, whose nodes are distinct.

    ``ids`` has the (doc_id, node) of all ``rows``.
    """
    needed, few = _sized(needed)
    # Of a text with many copies one row is read: the copies are told apart by id first.
    firsts = saved(ids.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(needed, "node", "left_semi"), "first-rows")
    firsts = firsts.select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    same_id = F.col("doc_id").eqNullSafe(F.col("d"))
    if few:  # only texts with a wanted id are hashed
        rows = rows.select("doc_id", "text").join(F.broadcast(firsts.select("d").distinct()), same_id, "left_semi").withColumn("node", _node(F.col("text")))
        firsts = F.broadcast(firsts)
    return saved(rows.join(firsts, (F.col("node") == F.col("n")) & same_id, "left_semi").select("node", "text").dropDuplicates(["node"]), "pair-texts")


def verified(pairs: DataFrame, content: DataFrame, idf: WordWeights, threshold: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose similarity reaches ``threshold``.

    ``content`` has the (node, text) of both.  The text of v comes once for all its
    partners in a task, ahead of them; each partner's text is compared with it as
    it streams by.  A v with very many partners is dealt to ``SALT`` tasks.
    """
    salted = pairs.withColumn("salt", F.pmod(F.hash("u"), F.lit(SALT)))
    leads = salted.select("v", "salt").distinct().join(content, F.col("v") == F.col("node")).select("v", "salt", F.lit(None).cast("binary").alias("u"), "text")
    members = salted.join(content, F.col("u") == F.col("node")).select("v", "salt", "u", "text")
    dealt = leads.unionAll(members).repartition("v", "salt").sortWithinPartitions(F.col("v"), F.col("salt"), F.col("u").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            us, vs = [], []
            for v, u, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = weighted_shingles(text, idf)
                if u is None:
                    lead = found
                elif similarity(found, lead) >= threshold:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
        release_memory()

    return dealt.mapInArrow(run, "u binary, v binary")


def near_classes(rows: DataFrame, ids: DataFrame, idf: WordWeights, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of every text that verified links connect with another.

    ``ids`` has the (doc_id, node) of all ``rows``.  The texts of bucket members are
    read once; all later steps take theirs from there.
    """
    entries = saved(sketches(rows, idf), "sketches").select(F.explode("keys").alias("key"), "node")
    order = F.struct(F.xxhash64("node", "key"), F.col("node"))
    # every bucket of two or more, with the centre that all its members meet
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("least")).filter("n > 1").select("key", F.col("least.node").alias("centre"))
    held = saved(entries.join(shared, "key"), "buckets")
    stars = saved(held.filter("node != centre").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct(), "stars-tried")
    content = one_text_each(rows, ids, held.select("node").distinct())
    links = saved(verified(stars, content, idf, threshold), "star-links")

    # members of one bucket that are still apart
    roots = components(links)
    placed = held.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart_keys = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    apart = saved(placed.join(apart_keys, "key", "left_semi").select("node").distinct(), "apart")
    content = saved(content.join(_sized(apart)[0], "node", "left_semi"), "apart-texts")
    entries = saved(prefixes(content, idf, threshold), "prefixes")
    several = entries.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    entries = saved(entries.join(several, "shingle", "left_semi"), "shared-prefixes")
    tried = stars
    for together in (_with_lightest, _in_pairs):
        rooted = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = saved(together(rooted, threshold).join(tried, ["u", "v"], "left_anti"), "pairs-tried")
        if pairs.limit(1).count():
            nodes, _ = _sized(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct())
            roots = extended(roots, saved(verified(pairs, content.join(nodes, "node", "left_semi"), idf, threshold), "pair-links"))
            tried = tried.unionAll(pairs)
    return roots


def prefixes(named: DataFrame, idf: WordWeights, threshold: float) -> DataFrame:
    """(shingle, node, size, rest) for each shingle in the prefix of each text.

    Shingles are ordered by how many of these texts hold their hash bucket, then by
    hash; ``rest`` is the weight from the shingle on.  Two texts at the threshold
    have an overlap of at least it times either weight, so the first shingle that
    they share lies where ``rest`` is at least that in both.
    """
    table, _ = bucket_counts(named, lambda t: weighted_shingles(t, idf)[0])
    # the order needs no finer steps than these
    steps = np.minimum(255, 12 * np.log2(table + 1.0)).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ends, sizes, rests = [], [0], [], []
            for t in texts(batch.column(1)):
                hashes, weights = weighted_shingles(t, idf)
                order = np.lexsort((hashes, steps[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                rest = weights[order][::-1].cumsum()[::-1]
                size = float(weights.sum())
                last = int((rest >= threshold * size * _NEARLY).sum())
                kept.append(hashes[order[:last]].view(np.int64))
                rests.append(rest[:last])
                sizes.append(size)
                ends.append(ends[-1] + last)
            flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((kept, np.int64), (rests, np.float64))]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.float64()), *lists], ["node", "size", "shingles", "rests"])
        release_memory()

    listed = named.mapInArrow(run, "node binary, size double, shingles array<long>, rests array<double>")
    return listed.select("node", "size", F.explode(F.arrays_zip("shingles", "rests")).alias("one")).select(F.col("one.shingles").alias("shingle"), "node", "size", F.col("one.rests").alias("rest"))


def _may_link(threshold: float) -> Column:
    """Whether entries a and b of one shingle, as the first that they share, leave room for the overlap."""
    room = F.least("a.rest", "b.rest") >= (F.col("a.size") + F.col("b.size")) * F.lit(threshold / (1 + threshold) * _NEARLY)
    return room & (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(threshold * _NEARLY)) & (F.col("a.root") != F.col("b.root"))


def _pair() -> list[Column]:
    return [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]


def _with_lightest(entries: DataFrame, threshold: float) -> DataFrame:
    """(u, v): each entry with the lightest text of its shingle."""
    lightest = F.min(F.struct("size", "node", "rest", "root")).alias("least")
    hubs = entries.groupBy("shingle").agg(lightest, F.max("root").alias("last"), F.min("root").alias("first")).filter("first != last").select("shingle", "least.*")
    same = (F.col("a.shingle") == F.col("b.shingle")) & _may_link(threshold)
    return entries.alias("a").join(hubs.alias("b"), same).select(*_pair()).distinct()


def _in_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(u, v): entries of one shingle in pairs, where it still has several classes.

    An entry goes before if even the lightest text of its shingle is too heavy for it.
    """
    groups = entries.groupBy("shingle").agg(F.min("size").alias("least"), F.max("root").alias("last"), F.min("root").alias("first")).filter("first != last")
    able = F.col("rest") >= (F.col("size") + F.col("least")) * F.lit(threshold / (1 + threshold) * _NEARLY)
    left = entries.join(groups, "shingle").filter(able).select("shingle", "node", "size", "rest", "root")
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node")) & _may_link(threshold)
    return left.alias("a").join(left.alias("b"), same).select(*_pair()).distinct()


def classified(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, class_id, class_size, keeper) of every row of ``docs``.

    Exactly one (doc_id, node) of a class is its keeper: the least id, nulls
    last, and of several texts under that id the least node.
    """
    rows = vertices(docs, id_col, text_col)
    idf = word_idf(docs, text_col)
    ids = saved(rows.select("doc_id", "node"), "nodes")
    roots = near_classes(rows, ids, idf, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    distinct = ids.filter(F.col("node").isNotNull()).groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min(F.struct("first", "node")).alias("keeper"), F.sum("copies").alias("class_size"))
    # only classes of several rows are joined back, under salted keys
    several = rooted.join(classes.filter("class_size > 1"), "root").select(rooted["node"], "keeper", "class_size")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = ids.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALT)))
    joined = salted.join(several, ["node", "salt"], "left")
    own = F.col("keeper").isNull()
    return joined.select(
        "doc_id", "node",
        F.when(own, F.col("doc_id")).otherwise(F.col("keeper.first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (own | (F.col("doc_id").eqNullSafe(F.col("keeper.first.doc_id")) & (F.col("node") == F.col("keeper.node")))).alias("keeper"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size): one row for each row of ``docs``.

    ``class_id`` is the least doc_id of the class; a class of one row has its own id.
    """
    return classified(docs, threshold, id_col, text_col).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, its keeper; blank texts all stay."""
    found = classified(docs, threshold, id_col, text_col).filter("class_size > 1")
    status = saved(found.groupBy("doc_id", "node").agg(F.max("keeper").alias("keeper"), F.count("*").alias("rows")), "classes")
    node = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (node == F.col("__node"))
    marked = status.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "keeper", "rows")
    gone = marked.filter("not keeper").select("__id", "__node")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = marked.filter("keeper and rows > 1").select("__id", "__node")
    if repeated.limit(1).count() == 0:
        return left
    # a keeper whose row itself is repeated: one of those rows stays
    several = left.join(repeated, same).dropDuplicates(["__id", "__node"]).select(*docs.columns)
    return left.join(repeated, same, "left_anti").unionAll(several)
