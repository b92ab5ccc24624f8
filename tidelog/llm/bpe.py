"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge product is a vocabulary token, so a pair of neighbouring bytes that
occurs inside no token can never be merged over: it marks a certain cut.  The
cuts of a text are the boundaries of its pre-tokens and, within a pre-token,
these byte pairs.  Each fragment is encoded on its own by ranked merges, with a
bounded cache, and the ids are concatenated.  Words are cut many at a time, and
new fragments are merged many at a time by a compiled loop, if it is installed.

Pre-tokens come first because their pattern looks ahead over white space, which
a cut text would hide.  A text that holds code points on whose class Unicode
versions differ is pre-tokenized by the tokenizers library itself.

Defined results
    null text            encoded as the empty text: no ids
    special token text   its own id, as the library does by default
    repeated rows        every row keeps its own result row
    empty table          an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import release_memory

#: Distinct words, and distinct fragments, that a worker keeps at least while a task runs.
CACHE = 120_000
#: Bytes of texts that :func:`encode_documents` encodes at once: their tokens stand in
#: arrays of many times that size.  It decides no id.
GROUP_BYTES = 1 << 20
#: Pre-tokens never span a space between two visible characters.  White space
#: before a space that further white space or the end follows is left whole.
_RUN = re.compile(r"\s (?:\s|$)")
NEVER = 1 << 30
#: Stands between pre-tokens and fragments that are handled together; no word that holds it is.
_MARK = "\0"
#: What must be looked at before a text is cut at its single spaces.
_WHITE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What the bytes of plain words are to the pre-token pattern.
_SPACE, _LETTER, _DIGIT, _BREAK, _OTHER = range(5)
_BEYOND = re.compile("[^\x00-\u052f]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others follow from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _unassigned() -> str:
    """A character class of the code points without a category, surrogates aside."""
    ranges, start = [], None
    for c in range(0x110001):
        odd = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "[" + "".join(ranges) + "]"


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file of the tokenizers library."""

    #: Fixed value: the pre-token pattern of byte-level tokenizer files.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw = byte_alphabet()
        to_bytes = lambda piece: bytes(raw[c] for c in piece)
        self.ids = {to_bytes(piece): i for piece, i in spec["model"]["vocab"].items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * self.size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self._piece_sizes = np.array([len(x) for x in self.pieces])
        self._piece_starts = np.cumsum(self._piece_sizes) - self._piece_sizes
        self._piece_buffer = np.frombuffer(b"".join(self.pieces), np.uint8)
        #: inside[a, b]: the bytes a, b are neighbours inside some token.
        self.inside = np.zeros((256, 256), bool)
        for piece in self.ids:
            codes = np.frombuffer(piece, np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        #: plain words: ASCII without apostrophes, and Latin letters; line breaks inside only;
        #: after the last character's last byte no token goes on with a space
        shown = r"!-&(-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{27f}"
        ends = [c for c in range(33, 0x280) if chr(c).encode()[-1] in np.flatnonzero(~self.inside[:, 32])]
        last = "".join(f"\\x{{{c:x}}}" for c in ends if c not in (39, 127, 0xD7, 0xF7) and not 128 <= c < 0xC0)
        self._plain_word = rf"\A(?:[{shown}]+\n+)*[{shown}]*[{last}]\z"
        self._kinds = np.full(256, _OTHER, np.uint8)
        self._kinds[[*b"\n"]], self._kinds[[*b" "]], self._kinds[[*b"0123456789"]] = _BREAK, _SPACE, _DIGIT
        self._kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
        self._inside_rows = [bytes(row) for row in self.inside.astype(np.uint8)]
        self._pair_rank = {pair: rank for pair, (rank, _) in self.ranks.items()}
        self._made = {rank: new for rank, new in self.ranks.values()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self._split = regex.compile(self.PATTERN)
        self._odd = regex.compile(_unassigned())
        self._marks = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        #: texts that may not be cut at single spaces, or hold special tokens, and some more
        self._suspects = "  |\n |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]" + "".join("|" + re.escape(m) for m in self.special)
        self._path = path
        self._words: dict[str, bytes] = Bounded(self._encode_chunk)
        self._spaced: dict[str, bytes] = Bounded(lambda word: self._encode_chunk(" " + word))
        self._fragments: dict[bytes, bytes] = Bounded(self._merge)

    @functools.cached_property
    def _engine(self):
        """A compiled merge loop, if ids are in merge order and it is installed."""
        try:
            import tiktoken
        except ImportError:
            return None
        ordered = sorted(self.ranks.values())
        if any(a[1] >= b[1] for a, b in zip(ordered, ordered[1:])) or len({new for _, new in ordered}) < len(ordered):
            return None
        return tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={_MARK: self.size})

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path).pre_tokenizer

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if not _BEYOND.search(text) or not self._odd.search(text):
            return self._split.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def fragments(self, word: bytes) -> list[bytes]:
        """The pieces of a pre-token between certain cuts."""
        if len(word) < 48:
            inside = self._inside_rows
            cuts = [k for k in range(1, len(word)) if not inside[word[k - 1]][word[k]]]
        else:
            codes = np.frombuffer(word, np.uint8)
            cuts = (np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1).tolist()
        if not cuts:
            return [word] if word else []
        bounds = [0, *cuts, len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _merge(self, fragment: bytes) -> bytes:
        """Ids of one fragment: the best-ranked pair merges first, leftmost first."""
        whole = self.ids.get(fragment)
        if len(fragment) == 1:
            return array("I", [whole]).tobytes()
        ids = [self.byte_ids[b] for b in fragment]
        if len(ids) > 64:
            return array("I", self._merge_long(ids)).tobytes()
        if self._engine is not None:
            try:
                return array("I", self._engine.encode_ordinary(fragment.decode())).tobytes()
            except UnicodeDecodeError:  # a cut within a character
                pass
        pairs, made = self._pair_rank, self._made
        ranks = [pairs.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), NEVER)
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), NEVER)
        return array("I", ids).tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for runs of any length."""
        import heapq

        n, ranks = len(ids), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := ranks.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (r[0], a, ids[a], ids[b], r[1]))
        return [x for x, kept in zip(ids, alive) if kept]

    def _encode_chunk(self, text: str) -> bytes:
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return b"".join([self._fragments[f] for f in self.fragments(text.encode())])
        return b"".join([self._fragments[f] for w in self.pre_tokens(text) for f in self.fragments(w.encode("utf-8", "replace"))])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._marks and self._marks.search(text):
            out, at = [], 0
            for m in self._marks.finditer(text):
                out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _whole(self, text: str) -> bool:
        """Whether ``text`` may not be cut at its single spaces."""
        return ("  " in text or "\n " in text or _WHITE.search(text) is not None) and _RUN.search(text) is not None

    def _plain(self, text: str) -> bytes:
        if self._whole(text):
            return self._encode_chunk(text)
        first, *rest = text.split(" ")
        return b"".join([self._words[first], *map(self._spaced.__getitem__, rest)])

    def _encode_spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space before it: all ids, and where
        each word's start and how many they are.

        Plain words are laid side by side and cut together, at pre-token boundaries
        and forced byte pairs; their distinct fragments are looked up or merged.
        Others are encoded one by one.
        """
        plain = pc.match_substring_regex(words, self._plain_word).to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        chosen = words.filter(pa.array(plain))
        own = pc.binary_length(chosen).to_numpy()
        bare = np.frombuffer(b"".join(chosen.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint8)
        raw = np.full(len(bare) + len(own), 32, np.uint8)
        raw[np.arange(len(bare)) + np.repeat(np.arange(1, len(own) + 1), own)] = bare
        kind = self._kinds[raw]
        cut = np.ones(len(raw), bool)
        before, here = kind[:-1], kind[1:]
        # a space goes with what follows it; of a run of line breaks the last stands alone
        cut[1:] = (before != here) & (before != _SPACE) | ~self.inside[raw[:-1], raw[1:]]
        cut[1:-1] |= (kind[:-2] == _BREAK) & (kind[1:-1] == _BREAK) & (kind[2:] != _BREAK)
        at = np.flatnonzero(cut)
        bounds = np.append(at, len(raw)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        ids, counts = gather(self._fragments.many(found.dictionary.to_numpy(zero_copy_only=False).tolist(), self._merge_many), found.indices.to_numpy())
        heads = np.flatnonzero(raw[at] == 32)  # the first fragment of each word
        firsts = (np.cumsum(counts) - counts)[heads]
        starts[plain], sizes[plain] = firsts, np.diff(np.append(firsts, len(ids)))
        rest = [self._spaced[w] for w in words.filter(pa.array(~plain)).to_pylist()]
        more = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        starts[~plain], sizes[~plain] = len(ids) + np.cumsum(more) - more, more
        return np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")]), starts, sizes

    def _merge_many(self, fragments: list[bytes]) -> list[bytes]:
        """:meth:`_merge` of every fragment, in one call of the compiled loop where that can take them."""
        out: list[bytes | None] = [None] * len(fragments)
        if self._engine is not None:
            good, shown = [], []
            for k, f in enumerate(fragments):
                if 1 < len(f) <= 64:
                    try:
                        shown.append(f.decode())
                        good.append(k)
                    except UnicodeDecodeError:  # a cut within a character
                        pass
            ids = np.array(self._engine.encode(_MARK.join(shown), allowed_special="all"), "<u4")
            marks = np.flatnonzero(ids == self.size).tolist()
            flat = ids.tobytes()
            for k, a, b in zip(good, [-1, *marks], [*marks, len(ids)]):
                out[k] = flat[4 * a + 4 : 4 * b]
        return [self._merge(f) if x is None else x for f, x in zip(fragments, out)]

    def forget(self) -> None:
        """Empties the caches."""
        for cache in (self._words, self._spaced, self._fragments):
            cache.clear()
            cache.old = {}

    def encode_batch(self, batch: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it.

        The words of the batch are made distinct first, so each is looked up once;
        the ids are then gathered.  Texts with special tokens or longer white
        space are encoded one by one and put in their places.
        """
        column = (pa.array(batch, pa.large_string()) if isinstance(batch, list) else batch.cast(pa.large_string())).fill_null("")
        suspect = np.flatnonzero(pc.match_substring_regex(column, self._suspects).to_numpy(zero_copy_only=False)).tolist()
        alone = {k: self.encode_bytes(t) for k in suspect if self._whole(t := column[k].as_py()) or self._marks and self._marks.search(t)}
        if alone:
            single = np.zeros(len(column), bool)
            single[list(alone)] = True
            lists = pc.split_pattern(pc.if_else(pa.array(single), pa.scalar(None, pa.large_string()), column), " ")
        else:
            lists = pc.split_pattern(column, " ")
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        starts = np.zeros(len(column) + 1, np.int64)
        np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), out=starts[1:])
        source, word_starts, word_sizes = self._encode_spaced(words.dictionary)
        # the first word of each text has no space before it: it gets a code of its own
        heads = [k for k in range(len(column)) if k not in alone]
        at = starts[:-1][heads]
        first = [self._words[w] for w in words.dictionary.take(pa.array(codes[at])).to_pylist()]
        codes[at] = len(word_sizes) + np.arange(len(heads))
        sizes = np.fromiter(map(len, first), np.int64, len(first)) // 4
        word_starts = np.concatenate([word_starts, len(source) + np.cumsum(sizes) - sizes])
        word_sizes = np.concatenate([word_sizes, sizes])[codes]
        ids = spread(np.concatenate([source, np.frombuffer(b"".join(first), "<u4")]), word_starts[codes], word_sizes)
        ends = np.concatenate([[0], np.cumsum(word_sizes)])
        bounds = ends[starts]
        if alone:
            parts, sizes = [], np.diff(bounds)
            for k in range(len(column)):
                parts.append(np.frombuffer(alone[k], "<u4") if k in alone else ids[bounds[k] : bounds[k + 1]])
                sizes[k] = len(parts[-1])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text of :meth:`encode_batch`, by table lookup."""
        out: list[bytes] = []
        lengths = np.concatenate([[0], np.cumsum(self._piece_sizes[ids])])[bounds]
        flat = spread(self._piece_buffer, self._piece_starts[ids], self._piece_sizes[ids]).tobytes()
        for a, b in zip(lengths.tolist(), lengths[1:].tolist()):
            out.append(flat[a:b].decode("utf-8", "replace").encode())
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(array("I", ids).tobytes())


def spread(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """source[start : start + size] of every pair, one after another."""
    parts = []
    step = 1 << 18
    for k in range(0, len(sizes), step):
        size = sizes[k : k + step]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        parts.append(source[np.repeat(starts[k : k + step] - ends + size, size) + np.arange(total)])
    return np.concatenate(parts) if parts else source[:0]


def gather(encoded: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words ``codes``, one after another, and how many each has."""
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    source = np.frombuffer(b"".join(encoded), "<u4")
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    return spread(source, starts[codes], own), own


def grouped(batches: Iterator[pa.RecordBatch], limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in groups of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together, for even memory."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy()
    at = held = 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


class Bounded(dict):
    """A cache of a function in two generations of ``CACHE`` entries each.

    What is looked up again moves to the new generation; the old one goes when
    the new one is full.  Long keys are not kept.
    """

    def __init__(self, function, size: int = CACHE, longest: int = 64):
        super().__init__()
        self.function, self.size, self.longest, self.old = function, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def many(self, keys: list, function) -> list:
        """The values of distinct keys; ``function`` makes all missing ones at once."""
        out = list(map(self.get, keys))
        absent = [k for k, v in enumerate(out) if v is None]
        wanted = [keys[k] for k in absent]
        values = list(map(self.old.get, wanted))
        lost = [k for k, v in enumerate(values) if v is None]
        for k, value in zip(lost, function([wanted[k] for k in lost])):
            values[k] = value
        for k, value in zip(absent, values):
            out[k] = value
        for at in range(0, len(wanted), self.size):
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self.update((key, value) for key, value in zip(wanted[at : at + self.size], values[at : at + self.size]) if len(key) <= self.longest)
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file in a worker."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    A map over rows: no shuffle, memory bounded by a batch and the caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in grouped(batches, GROUP_BYTES):
            for lo, hi in slices(batch.column(1), GROUP_BYTES):
                ids, bounds = bpe.encode_batch(batch.column(1)[lo:hi])
                raw = [ids[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(bounds), pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])
        bpe.forget()
        release_memory()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of rows that :func:`encode_documents` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode_bytes(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes those ids, and returns the digests of both.

    Both directions run in one pass, so that ids never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in grouped(batches):
            for lo, hi in slices(batch.column(1)):
                ids, bounds = bpe.encode_batch(batch.column(1)[lo:hi])
                of_ids = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                of_text = [hashlib.sha256(x).hexdigest() for x in bpe.decode_batch(ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(bounds), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()
        release_memory()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
