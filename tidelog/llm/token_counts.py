"""Token counts by a count-only Viterbi pass.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; dynamic
programming keeps, for each end, the best score and the number of pieces of the
best path, and no path.  Ties follow the tokenizer: of the pieces that end at
one place the one that starts first is kept unless a later one is strictly
better.  A character that is no piece by itself is unknown, scored below
all pieces; with byte pieces in the vocabulary it counts its UTF-8 bytes,
otherwise a run of unknown characters counts one.

The scores are the file's own.  The file at hand has whole-number scores, so
their sums are exact, and a text is cut where no piece can cross: before
a word mark that follows another character.  Words are then counted once each.

Defined results
    null or empty text   0 tokens
    repeated rows        every row keeps its own result row
    empty table          an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bounded
from .common import texts

#: Distinct words, and distinct units, that a worker keeps at least.
CACHE = 250_000
MARK = "▁"
#: Fixed value: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class UnigramCounter:
    """Counts pieces of the best segmentation under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.single = {p for p in names if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # a piece may hold the mark at its start, or be a run of marks
        self.cuttable = all(MARK not in p[1:] or not p.strip(MARK) for p in names) and all(float(s).is_integer() for _, s in pieces)
        self._units = Bounded(self.count_unit, CACHE)
        self._words = Bounded(lambda word: self.count_unit(MARK + word), CACHE)

    def count_unit(self, text: str) -> int:
        """Pieces of a text whose spaces are marks already."""
        n = len(text)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):  # per end, longest first
            matches[end].append(match)
        best, count, lone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top = None
            for length, score in matches[end]:
                start = end + 1 - length
                if best[start] is None:
                    continue
                total = best[start] + score
                if top is None or total > top:
                    top, pieces, alone = total, count[start] + 1, False
            if text[end] not in self.single:
                total = best[end] + self.unknown
                if top is None or total > top:
                    top, alone = total, True
                    pieces = count[end] + (len(text[end].encode("utf-8", "replace")) if self.bytes else not lone[end])
            best[end + 1], count[end + 1], lone[end + 1] = top, pieces, alone
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuttable:
            return self.count_unit(MARK + text.replace(" ", MARK))
        if "  " not in text and MARK not in text and text[0] != " ":
            return sum(map(self._words.__getitem__, text.split(" ")))
        return sum(map(self._units.__getitem__, re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))))


@functools.lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """One counter for each file in a worker."""
    return UnigramCounter(read_pieces(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; a map, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_path)
        for batch in batches:
            counts = [counter.count(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def library_tokenizer(pieces: list[tuple[str, float]]):
    """The same vocabulary in the tokenizers library, for tests."""
    from tokenizers import Tokenizer, models, normalizers

    names = [p for p, _ in pieces]
    tokenizer = Tokenizer(models.Unigram([(p, s) for p, s in pieces], names.index("<unk>"), True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    return tokenizer
