"""Document scores by masked pseudo-likelihood.

A small network predicts each token from the tokens on both sides of it: the
embeddings of a window are weighted by place, summed and passed through tanh,
and a two-level softmax (class, then token within the class) gives the
probability of the masked token.  A document's score is the sum of the log
probabilities of all its tokens, each given its neighbours.

Tokens are lower-cased words between white space.  The network predicts the
``WORDS`` most frequent ones and, for all others, one of ``RARE`` hash buckets.
Within its bucket a word has its share of the bucket's tokens, by counts of
every word over all documents.  So each token has a probability of its own, and
the probabilities of all words of the corpus sum to 1.

A network of fixed size cannot hold a corpus of any size, so it has a memory
that grows with the corpus: between every pair of words, all words seen there
are counted over all documents.  There the probability is
(n - 1 + PRIOR * p) / (m - 1 + PRIOR), where p is the network's, n of the m
tokens seen between this pair are this word, and the token itself is left out of
both.  So passages that occur elsewhere too score higher, and what occurs once
gets nothing from itself.  Only the first and the last token of a text, which
stand between no pair, have the network's probability.

Counts of the most frequent words travel with the tasks; all others are counted
by 64-bit hash in a shuffle, as are the pairs; only what has an equal hash would
be counted as one.  Tokens travel to their pair in compressed arrays, a word of
the most frequent as its rank; a task keeps arrays of its tokens in a temporary
file and in memory only the counts.  The files of a shuffle are removed when
what is made of it is written.

Training sees every document: after a warm start on ``WARM_DOCS`` documents,
each task continues from the same weights over all its rows, and the changes
are averaged by the number of tokens that made them.  A task holds the weights
and one batch; what reaches the driver has the size of the weights.

Defined results
    null or empty text   0 tokens, sum 0, no mean
    repeated rows        every row keeps its own result row
    empty table          an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import grouped
from .common import release_memory, remove, saved, scratch, shuffles_removed
from .near_dedup import mixed

CLASSES, WITHIN = 48, 32
RARE = 64
WORDS = CLASSES * WITHIN - RARE
PAD = WORDS + RARE
SIDE, WIDTH = 3, 24
#: Places of the window, without the middle.
PLACES = [k for k in range(2 * SIDE + 1) if k != SIDE]
#: Tokens of one step of training, and of one block of scores.
STEP, BLOCK_TOKENS = 8192, 16384
#: Tokens of one product of matrices, which stay in the cache; they decide no score.
COLUMNS = 768
RATE = 0.08
#: The warm start: whole texts of up to so many code points, and passes over them.
WARM_DOCS, WARM_CHARS, WARM_PASSES = 400, 20_000, 2
#: One pair of neighbours in so many is remembered: each; so many tokens the network's prediction counts there.
EVERY, PRIOR = 1, 2.0
#: Tokens that a task deals to their pairs at once, and that one task counts; they decide no score.
CHUNK, MEET = 1_000_000, 1_500_000
#: Words whose counts travel with a task; it decides where a word is counted, not its score.
CARRIED = 150_000
#: Weights travel in blocks of this many.
BLOCK = 4096
SEED = 13


def word_hash(word: str) -> int:
    """The 64-bit hash of a word, as Spark's xxhash64 but unsigned."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)


def tokenized(column: pa.Array | list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, all tokens as indices of them, and how many each text has."""
    column = pa.array(column, pa.large_string()) if isinstance(column, list) else column.cast(pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_lower(column.fill_null("")))
    words = lists.flatten().dictionary_encode()
    codes, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    if "" in distinct:  # stands where a text begins or ends with white space
        shown = codes != distinct.index("")
        before = np.concatenate([[0], np.cumsum(shown)])
        ends = np.cumsum(sizes)
        sizes, codes = before[ends] - before[ends - sizes], codes[shown]
    return distinct, codes, sizes


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def laid(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of texts one after another, with pads around each."""
    flat = np.full(len(ids) + SIDE * (len(sizes) + 1), PAD, np.uint16)
    flat[np.arange(len(ids)) + np.repeat(np.arange(1, len(sizes) + 1) * SIDE, sizes)] = ids
    return flat


def blocks(flat: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of :func:`laid` with ``size`` places each, and their windows' ends."""
    for at in range(SIDE, len(flat) - SIDE, size):
        yield flat[at - SIDE : min(at + size, len(flat) - SIDE) + SIDE]


class Vocabulary:
    """Ids of words: by falling frequency, then hash buckets."""

    def __init__(self, words: list[str]):
        self.known = {w: k for k, w in enumerate(words)}

    def ids(self, words: list[str], hashes: np.ndarray) -> np.ndarray:
        found = self.known.get
        ids = np.fromiter((found(w, -1) for w in words), np.int64, len(words))
        return np.where(ids < 0, WORDS + (hashes % np.uint64(RARE)).astype(np.int64), ids)

    def read(self, column: pa.Array | list[str]) -> np.ndarray:
        """The texts of a column as :func:`laid` has them."""
        words, codes, sizes = tokenized(column)
        return laid(self.ids(words, hashed(words))[codes], sizes)


@dataclass
class Counts:
    """The network's words, the counts that travel, these words first, and the tokens of each bucket."""

    words: list[str]
    carried: dict[str, int]
    buckets: list[int]

    def tokens(self) -> tuple[int, int]:
        """How many tokens there are, and how many of them are of words whose counts do not travel."""
        every = sum(self.buckets) + sum(self.carried[w] for w in self.words)
        return every, every - sum(self.carried.values())

    def shares(self, ranks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs of rare words' shares of their buckets, and which lack their count; those have the rest of it."""
        rare = ids >= WORDS
        # the last place is that of rank -1
        n = np.fromiter((*self.carried.values(), 0), np.float64, len(self.carried) + 1)[ranks]
        totals = np.array([1] * WORDS + [max(1, b) for b in self.buckets], np.float64)[ids]
        return np.where(rare, np.log(np.maximum(n, 1)) - np.log(totals), 0.0), rare & (n == 0)


class Ranks:
    """Looks up each word once, for its place among the words whose counts travel, its hash and its id."""

    def __init__(self, counts: Counts, known: np.ndarray):
        self.ranks, self.known, self.words = {w: k for k, w in enumerate(counts.carried)}, known, len(counts.words)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks (-1 if its count does not travel), hashes, and the ids of :class:`Vocabulary`."""
        found = self.ranks.get
        ranks = np.fromiter((found(w, -1) for w in words), np.int32, len(words))
        other = np.flatnonzero(ranks < 0)
        hashes = self.known[ranks] if len(self.known) else np.zeros(len(words), np.uint64)
        hashes[other] = hashed([words[k] for k in other.tolist()])
        own = (ranks >= 0) & (ranks < self.words)
        return ranks, hashes, np.where(own, ranks, WORDS + (hashes % np.uint64(RARE)).astype(np.int64))


def word_counts(docs: DataFrame, text_col: str = "text", carried: int = CARRIED) -> Counts:
    """Counts over all documents, the most frequent words first, ties by the word.

    Tasks count before the shuffle; the driver gets ``carried`` words at most
    besides the network's, and the tokens of each bucket, in rows without a word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            words, codes, _ = tokenized(batch.column(0))
            n = np.bincount(codes, minlength=len(words))
            kept = np.flatnonzero(n)
            words, n = [words[k] for k in kept.tolist()], n[kept]
            buckets = np.bincount((hashed(words) % np.uint64(RARE)).astype(np.int64), n, RARE).astype(np.int64)
            columns = [[*words, *[None] * RARE], [*[None] * len(words), *range(RARE)], np.concatenate([n, buckets])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], ["word", "bucket", "n"])
        release_memory()

    path = scratch(docs.sparkSession, "lm-counts")
    with shuffles_removed(docs.sparkSession):
        counted = docs.select(text_col).mapInArrow(count, "word string, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n"))
        counted.write.parquet(path)
    counted = docs.sparkSession.read.schema(counted.schema).parquet(path)
    named = counted.filter("word is not null").select("word", "n")
    # the least count that not more than ``carried`` words reach: a limit would send as many from every task
    least, reached = None, 0
    for r in named.groupBy("n").count().orderBy(F.desc("n")).collect():
        if reached + r["count"] > max(carried, WORDS):
            break
        least, reached = r["n"], reached + r["count"]
    first = named.filter(F.col("n") >= least).collect() if least is not None else []
    if reached < WORDS:  # the rest has one count, or there is none
        first += named.filter(F.col("n") < least if least is not None else F.lit(True)).orderBy(F.desc("n"), "word").limit(WORDS - reached).collect()
    known = {r["word"]: r["n"] for r in sorted(first, key=lambda r: (-r["n"], r["word"]))}
    words = list(known)[:WORDS]
    if carried < WORDS:
        known = {w: known[w] for w in words}
    buckets = [0] * RARE
    for r in counted.filter("word is null").collect():
        buckets[r["bucket"]] = r["n"]
    remove(docs.sparkSession, path)
    for w in words:  # the network predicts these itself
        buckets[word_hash(w) % RARE] -= known[w]
    return Counts(words, known, buckets)


@dataclass
class Network:
    """Weights and their Adagrad sums; ``flat`` is one vector of all weights."""

    parts: dict[str, np.ndarray] = field(default_factory=dict)
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls) -> Network:
        random = np.random.default_rng(SEED)
        near = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        parts = {
            "embedding": near(PAD + 1, WIDTH), "place": 1 + near(2 * SIDE, WIDTH), "shift": np.zeros(WIDTH, np.float32),
            "classes": near(WIDTH, CLASSES), "class_shift": np.zeros(CLASSES, np.float32),
            "tokens": near(CLASSES, WIDTH, WITHIN), "token_shift": np.zeros((CLASSES, WITHIN), np.float32),
        }
        return cls(parts, {k: np.full_like(v, 1e-3) for k, v in parts.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.parts.values()])

    def with_flat(self, flat: np.ndarray) -> Network:
        parts, at = {}, 0
        for k, v in self.parts.items():
            parts[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Network(parts, {k: v.copy() for k, v in self.sums.items()})

    def _hidden(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings of a block of places and its ends, and the hidden units of the places
        with a last row of ones.  Places stand side by side, as in all that follows."""
        seen = np.ascontiguousarray(self.parts["embedding"].T).take(part.astype(np.intp), axis=1, mode="clip")
        n = len(part) - 2 * SIDE
        hidden, weighted = np.ones((WIDTH + 1, n), np.float32), np.empty((WIDTH, n), np.float32)
        total = hidden[:WIDTH]
        total[...] = self.parts["shift"][:, None]
        for weight, at in zip(self.parts["place"], PLACES):
            total += np.multiply(weight[:, None], seen[:, at : at + n], out=weighted)
        np.tanh(total, out=total)
        return seen, hidden

    def log_probabilities(self, flat: np.ndarray) -> np.ndarray:
        """log P(token | its window) of every token of :func:`laid`."""
        out = [np.zeros(0, np.float32)]
        for part in blocks(flat, BLOCK_TOKENS):
            middle = part[SIDE:-SIDE]
            order = _by_target(middle)
            found = np.zeros(len(middle), np.float32)
            found[order] = self._softmax(self._hidden(part)[1].take(order, axis=1, mode="clip"), middle[order])[0]
            out.append(found[middle != PAD])
        return np.concatenate(out)

    def _softmax(self, hidden: np.ndarray, target: np.ndarray, learn: bool = False):
        """The log probabilities of targets, which come sorted; to learn, also the gradients and what
        goes back to ``hidden``, with a last column of zeros."""
        p, n = self.parts, len(target)
        # the shifts are the weights of the row of ones
        classes = np.vstack([p["classes"], p["class_shift"]])
        tokens = np.concatenate([p["tokens"], p["token_shift"][:, None]], axis=1)
        to_classes, to_tokens = np.ascontiguousarray(classes.T), np.ascontiguousarray(tokens.transpose(0, 2, 1))
        of_classes, of_tokens = np.zeros_like(to_classes), np.zeros_like(to_tokens)
        # no logit is beyond this, for hidden units are in -1 .. 1; powers of it are far from the ends of their kind
        small = max(np.abs(classes).sum(axis=0).max(), np.abs(tokens).sum(axis=1).max()) < 40
        group, within, row = (target // WITHIN).astype(np.intp), (target % WITHIN).astype(np.intp), np.arange(n)

        def level(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            """The log probabilities of what is chosen; to learn, the logits become the loss's slopes."""
            if not small:
                logits -= logits.max(axis=0)
            flat, at = logits.reshape(-1), chosen * n + row
            found = flat[at]
            totals = np.exp(logits, out=logits).sum(axis=0)
            found -= np.log(totals)
            if learn:
                logits /= totals
                flat[at] -= 1
            return found

        columns = [slice(lo, min(lo + COLUMNS, n)) for lo in range(0, n, COLUMNS)]
        logits = np.empty((CLASSES, n), np.float32)
        for x in columns:
            np.matmul(to_classes, hidden[:, x], out=logits[:, x])
        out = level(logits, group)
        back = np.zeros((WIDTH, n + 1), np.float32) if learn else None
        if learn:
            for x in columns:
                of_classes += logits[:, x] @ hidden[:, x].T
                np.matmul(p["classes"], logits[:, x], out=back[:, x])
        ends = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        parts = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]
        logits = np.concatenate([np.zeros((WITHIN, 0), np.float32), *(to_tokens[c] @ hidden[:, x] for c, x in parts)], axis=1)
        out += level(logits, within)
        if learn:
            for c, x in parts:
                of_tokens[c] = logits[:, x] @ hidden[:, x].T
            back[:, :n] += np.concatenate([p["tokens"][c] @ logits[:, x] for c, x in parts], axis=1)
        if not learn:
            return out, {}, None
        of_tokens = of_tokens.transpose(0, 2, 1)
        gradients = {"classes": of_classes.T[:WIDTH], "class_shift": of_classes.T[WIDTH], "tokens": of_tokens[:, :WIDTH], "token_shift": of_tokens[:, WIDTH]}
        return out, gradients, back

    def learn(self, flat: np.ndarray) -> int:
        """Steps of Adagrad on the mean negative log-likelihood; how many tokens were seen."""
        tokens = 0
        for part in blocks(flat, STEP):
            middle = part[SIDE:-SIDE]
            order, n = _by_target(middle), len(middle)
            size = len(order)
            if not size:
                continue
            seen, hidden = self._hidden(part)
            _, gradients, back = self._softmax(hidden.take(order, axis=1, mode="clip"), middle[order], True)
            places = np.full(n, size)  # what is not shown takes the column of zeros
            places[order] = np.arange(size)
            back = back.take(places, axis=1, mode="clip")
            back *= 1 - np.square(hidden[:WIDTH])
            each, weighted = np.zeros_like(seen), np.empty_like(back)
            for weight, at in zip(self.parts["place"], PLACES):
                each[:, at : at + n] += np.multiply(weight[:, None], back, out=weighted)
            gradients["place"] = np.stack([np.einsum("db,db->d", seen[:, at : at + n], back) for at in PLACES])
            gradients["shift"] = back.sum(axis=1)
            order = np.argsort(part, kind="stable")
            ids = part[order]
            firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            gradients["embedding"] = np.zeros_like(self.parts["embedding"])
            gradients["embedding"][ids[firsts]] = np.add.reduceat(each.take(order, axis=1, mode="clip"), firsts, axis=1).T
            for name, g in gradients.items():
                g = g / np.float32(size)
                self.sums[name] += g * g
                self.parts[name] -= np.float32(RATE) * g / np.sqrt(self.sums[name])
            tokens += size
        return tokens


def _by_target(middle: np.ndarray) -> np.ndarray:
    """The places of a block's tokens, by the token."""
    shown = np.flatnonzero(middle != PAD)
    return shown[np.argsort(middle[shown], kind="stable")]


def train(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Trains on all documents."""
    warm = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, WARM_CHARS))
    warm = [r["text"] for r in warm.orderBy(F.xxhash64("id"), "id").limit(WARM_DOCS).select("text").collect()]
    network = Network.fresh()
    flat = Vocabulary(words).read(warm)
    for _ in range(WARM_PASSES):
        network.learn(flat)
    start = network.flat()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own, tokens = Vocabulary(words), network.with_flat(start), 0
        for batch in grouped(batches):
            tokens += own.learn(vocabulary.read(batch.column(0)))
        if tokens:
            change = (own.flat() - start).astype(np.float64) * tokens
            parts = [change[at : at + BLOCK].tobytes() for at in range(0, len(change), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "tokens", "change"])
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, change in zip(*(c.to_pylist() for c in batch.columns)):
                one = sums.setdefault(block, [0, 0.0])
                one[0] += tokens
                one[1] = one[1] + np.frombuffer(change, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()), pa.array([c.tobytes() for _, c in sums.values()], pa.binary())], ["block", "tokens", "change"])

    schema = "block int, tokens long, change binary"
    # one set of weights, whatever the number of documents
    with shuffles_removed(docs.sparkSession):
        blocks = docs.select(text_col).mapInArrow(learn, schema).repartition("block").mapInArrow(add, schema).collect()
    if not blocks:
        return network
    change = np.concatenate([np.frombuffer(r["change"], np.float64) / r["tokens"] for r in sorted(blocks, key=lambda r: r["block"])])
    return network.with_flat(start + change)


def score_documents(docs: DataFrame, counts: Counts, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row of the counted documents.

    Rows are numbered as they are read, which tables give in the same order each time.
    """
    network = Network(network.parts, {})
    known = hashed(list(counts.carried))
    tokens, uncounted = counts.tokens()
    tasks, word_tasks = tokens // MEET + 1, uncounted // MEET + 1
    kind = dict(docs.dtypes)[id_col]
    names = ["part", "chunk", "tokens", "words", "gains", "row", "doc_id", "n_tokens", "sum"]
    schema = f"part int, chunk long, tokens binary, words binary, gains binary, row long, doc_id {kind}, n_tokens long, sum double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(counts, known)
        chunk, held, rows, size = TaskContext.get().partitionId() << 16, [], 0, 0
        for batch in grouped(batches):
            words, codes, sizes = tokenized(batch.column(1))
            rank, hashes, ids = ranks.of(words)
            logs, lacking = counts.shares(rank, ids)
            own = network.log_probabilities(laid(ids[codes], sizes)).astype(np.float64) + logs[codes]
            ends = np.cumsum(sizes)
            sums = np.zeros(len(sizes))
            sums[sizes > 0] = np.add.reduceat(own, (ends - sizes)[sizes > 0]) if len(own) else 0
            rank[lacking] = -1
            pairs, inner = neighbours(hashes[codes], sizes)
            held.append((hashes[codes], rank[codes], own.astype(np.float32), np.repeat(np.arange(rows, rows + len(sizes), dtype=np.int32), sizes), pairs, inner))
            of_row = [pa.array(np.arange(rows, rows + len(sizes)) % tasks, pa.int32()), pa.array((chunk << 24) + np.arange(rows, rows + len(sizes)), pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]
            yield _filled(schema_of, dict(zip(["part", "row", "doc_id", "n_tokens", "sum"], of_row)))
            rows, size = rows + len(sizes), size + len(codes)
            if max(rows, size) >= CHUNK:
                yield from dealt(chunk, held)
                chunk, held, rows, size = chunk + 1, [], 0, 0
        if held:
            yield from dealt(chunk, held)
        release_memory()

    def dealt(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The tokens of a chunk, in one array for each part of the pairs; those between no pair, by their word."""
        of_token, rank, own, row, pairs, inner = (np.concatenate(x) for x in zip(*held))
        held.clear()
        at = np.flatnonzero(inner & (pairs % np.uint64(EVERY) == 0))
        at, ends = _by_part(pairs[at], tasks, at)
        blobs = []
        for lo, hi in zip(ends, ends[1:]):
            places = at[lo:hi]
            codes = [rank[places + k] for k in (-1, 0, 1)]
            others = [of_token[places + k][c < 0] for k, c in zip((-1, 0, 1), codes)]
            blobs.append(packed(*codes, *others, own[places], np.diff(row[places], prepend=np.int32(0))))
        full = [k for k in range(tasks) if ends[k] < ends[k + 1]]
        yield _filled(schema_of, {"part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "tokens": pa.array([blobs[k] for k in full], pa.binary())})
        at = np.flatnonzero(~inner & (rank < 0))
        one = np.ones(len(at), np.int32)
        yield _filled(schema_of, _of_words(of_token[at], own[at], one, one, (chunk << 24) + row[at].astype(np.int64), word_tasks))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts each pair, and each word in it; adds up what the memory adds to each row."""
        chunks, held = [], 0
        with tempfile.SpooledTemporaryFile(max_size=32 << 20) as kept:
            for batch in batches:
                here = batch.column(2).is_valid()
                rest = batch.filter(pc.invert(here))
                if len(rest):
                    yield rest
                mine = batch.filter(here)
                for chunk, blob in zip(mine.column(1).to_pylist(), mine.column(2).to_pylist()):
                    chunks.append((chunk, len(blob)))
                    held += first_length(blob)
                    kept.write(blob)
            kept.seek(0)
            sizes = [size for _, size in chunks]
            if held <= 2 * MEET:
                numbers = _numbered([met(kept.read(size)) for size in sizes])
            else:  # a pair that is everywhere
                of_pair, of_both = Tally(), Tally()
                for size in sizes:
                    pairs, both, *_ = met(kept.read(size))
                    of_pair.add(pairs)
                    of_both.add(both)
                kept.seek(0)
                numbers = ((of_pair.of(pairs), of_both.of(both), *more) for pairs, both, *more in (met(kept.read(size)) for size in sizes))
            later, waiting = [], 0
            for (chunk, _), (m, n, lacking, word, own, row) in zip(chunks, numbers):
                several = (m > 1) & ~lacking
                yield _filled(schema_of, {"chunk": pa.array([chunk], pa.int64()), "gains": pa.array([_of_rows(row[several], gain(own[several], n[several], m[several]))], pa.binary())})
                later.append((word, own[lacking], n[lacking].astype(np.int32), m[lacking].astype(np.int32), (chunk << 24) + row[lacking].astype(np.int64)))
                waiting += len(word)
                if waiting >= CHUNK:
                    yield _filled(schema_of, _of_words(*(np.concatenate(x) for x in zip(*later)), word_tasks))
                    later, waiting = [], 0
            if later:
                yield _filled(schema_of, _of_words(*(np.concatenate(x) for x in zip(*later)), word_tasks))
        release_memory()

    def met(blob: bytes) -> tuple[np.ndarray, ...]:
        """Of each token: its pair, its pair and word, whether the word's count is lacking (and these words), its log probability, and its row in the chunk."""
        left, rank, right, *others, own, row = unpacked(blob, [np.int32] * 3 + [np.uint64] * 3 + [np.float32, np.int32])
        words = []
        for codes, other in zip((left, rank, right), others):
            found = known[codes] if len(known) else np.zeros(len(codes), np.uint64)
            found[codes < 0] = other
            words.append(found)
        pairs = pair_hash(words[0], words[2])
        return pairs, mixed(pairs + mixed(words[1])), rank < 0, others[1], own, np.cumsum(row, dtype=np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts words, all of whose tokens are here."""
        held = [unpacked(b, _WORD_KINDS) for batch in batches for b in batch.column(0).to_pylist()]
        if held:
            word, own, n, m, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, place, tokens = np.unique(word, return_inverse=True, return_counts=True)
            more = np.log(tokens)[place]
            more += gain(own + more, n, m)
            chunk = row >> 24
            order = np.argsort(row)
            ends = [*np.flatnonzero(np.diff(chunk[order], prepend=-1)).tolist(), len(order)]
            for lo, hi in zip(ends, ends[1:]):
                here = order[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[here[0]])], pa.int64()), pa.array([_of_rows((row[here] & 0xFFFFFF).astype(np.int32), more[here])], pa.binary())], ["chunk", "gains"])
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, more = unpacked(blob, [np.int32, np.float32])
                if len(rows):
                    rows = np.cumsum(rows)
                    own = sums.get(chunk, np.zeros(0))
                    if len(own) <= rows[-1]:
                        own = np.concatenate([own, np.zeros(int(rows[-1]) + 1 - len(own))])
                    own[rows] += more
                    sums[chunk] = own
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array((chunk << 24) + np.arange(len(own)), pa.int64()), pa.array(own)], ["row", "gain"])

    types = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.float64()]
    schema_of = pa.schema(list(zip(names, types)))
    with shuffles_removed(docs.sparkSession):
        scored = saved(docs.select(id_col, text_col).mapInArrow(run, schema).repartitionById(tasks, "part").mapInArrow(meet, schema), "lm-scores")
    words = scored.filter("words is not null").select("part", "words").repartitionById(word_tasks, "part").select("words")
    gains = scored.filter("gains is not null").select("chunk", "gains").unionAll(words.mapInArrow(count, "chunk long, gains binary"))
    gains = gains.repartition("chunk").mapInArrow(add, "row long, gain double")
    full = scored.filter("row is not null").select("row", "doc_id", "n_tokens", "sum").join(gains, "row", "left")
    full = full.withColumn("log_likelihood", F.col("sum") + F.coalesce("gain", F.lit(0.0)))
    return full.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


#: Arrays of tokens on their way to their word: it, the log probability, n and m of the pair, and the row.
_WORD_KINDS = [np.uint64, np.float32, np.int32, np.int32, np.int64]


def gain(log_p: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the memory adds to log probabilities; nothing, where a pair was seen once."""
    log_p = log_p.astype(np.float64)
    return np.where(m > 1, np.log(n - 1 + PRIOR * np.exp(log_p)) - np.log(m - 1 + PRIOR) - log_p, 0.0)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one, compressed; bytes of equal places stand side by side."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(body), *map(len, arrays)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def first_length(blob: bytes) -> int:
    """How long the first array of :func:`packed` is."""
    return int(np.frombuffer(blob, np.int64, 2)[1])


def unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    """The arrays of :func:`packed`, whose kinds these are."""
    size, *counts = np.frombuffer(blob, np.int64, 1 + len(kinds)).tolist()
    body, at, out = pa.decompress(memoryview(blob)[8 * (1 + len(kinds)) :], size, codec="zstd", asbytes=True), 0, []
    for n, kind in zip(counts, kinds):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += n * width
    return out


def _by_part(hashes: np.ndarray, parts: int, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Values by the part of their hashes, in their order, and the ends of the parts."""
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    return values[order], [0, *np.cumsum(np.bincount(part, minlength=parts)).tolist()]


def _of_words(word: np.ndarray, own: np.ndarray, n: np.ndarray, m: np.ndarray, row: np.ndarray, parts: int) -> dict[str, pa.Array]:
    order, ends = _by_part(word, parts, np.arange(len(word)))
    full = [k for k in range(parts) if ends[k] < ends[k + 1]]
    blobs = [packed(*(x[order[ends[k] : ends[k + 1]]] for x in (word, own, n, m, row))) for k in full]
    return {"part": pa.array(full, pa.int32()), "words": pa.array(blobs, pa.binary())}


def _of_rows(row: np.ndarray, more: np.ndarray) -> bytes:
    """The sums of ``more`` of each row that is there."""
    if not len(row):
        return packed(row, more.astype(np.float32))
    sums, there = np.bincount(row, more), np.flatnonzero(np.bincount(row))
    return packed(np.diff(there, prepend=0).astype(np.int32), sums[there].astype(np.float32))


def _filled(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of these columns; all others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def times(keys: np.ndarray) -> np.ndarray:
    """How often the key of each place occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    counts = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
    out = np.empty(len(keys), np.int32)
    out[order] = np.repeat(counts, counts)
    return out


def _numbered(tokens: list[tuple]) -> Iterator[tuple]:
    """Tokens with how often their pair, and their word in it, occurs among them, in place of these two."""
    pairs, both, *more = zip(*tokens) if tokens else ((), ())
    ends = np.cumsum([len(x) for x in pairs]).tolist()
    m = times(np.concatenate(pairs)) if ends else np.zeros(0, np.int32)
    n = np.ones(len(m), np.int32)
    several = m > 1
    if several.any():
        n[several] = times(np.concatenate(both)[several])
    del pairs, both
    for lo, hi, *rest in zip([0, *ends], ends, *more):
        yield m[lo:hi], n[lo:hi], *rest


class Tally:
    """How often each key was added; equal keys take place once."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= 2 * MEET:
            self._sum()

    def _sum(self) -> None:
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.size = [], 0
        if len(self.keys):
            keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[firsts], np.add.reduceat(counts, firsts)
        self.keys, self.counts = keys, counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.waiting:
            self._sum()
        order = np.argsort(keys)
        out = np.empty(len(keys), np.int64)
        out[order] = self.counts[np.searchsorted(self.keys, keys[order])]
        return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of the words on both sides."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def neighbours(of_token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words on both sides of each token, and which tokens have both."""
    pairs = np.zeros(len(of_token), np.uint64)
    pairs[1:-1] = pair_hash(of_token[:-2], of_token[2:])
    inner = np.ones(len(of_token), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    inner[ends - sizes[sizes > 0]] = inner[ends - 1] = False
    return pairs, inner


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: int = CARRIED) -> DataFrame:
    """Trains on ``docs`` and scores them."""
    counts = word_counts(docs, text_col, carried)
    return score_documents(docs, counts, train(docs, counts.words, id_col, text_col), id_col, text_col)
