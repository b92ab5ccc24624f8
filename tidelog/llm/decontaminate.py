"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are compared as sets of five-word shingles of lower-cased words: runs of
letters and digits, and in scripts without spaces each character.  An item of
under five words is one shingle of all its words; documents are probed with
shingles of such a length too if some item has it.  An item is found in a
document if the document holds at least ``threshold`` of its distinct shingles.

Items are partitioned by shingle count, in powers of two.  Each partition has
one sketch length: an item of n shingles may miss n - ceil(t n) of them, so its
n - ceil(t n) + 1 smallest hashes (its bottom MinHash sketch) cannot all be
missed; the partition's largest size fixes the length for all its items.  So
every document that contains an item shares a sketch hash with it.  Long documents need no
sketch of their own: each of their shingle hashes probes the sketch index, which
makes the candidates.  Candidates are verified by the shingles themselves.

Only DataFrame functions are used.

Defined results
    null or empty text          no words: no shingles, never a pair
    repeated rows               one row per (doc_id, item_id), the largest share
    null ids                    kept as null
    empty tables                an empty result
    further columns             ignored, whatever their names
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

WIDTH = 5
THRESHOLD = 0.8
#: Rows of an index, or of candidates, up to which it is sent to every executor
#: (at 16 bytes each, 8 MB); beyond that the join is shuffled.
BROADCAST_ROWS = 500_000


#: Scripts that set no spaces between words, and the first code point of any of them.
UNSPACED = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]
FIRST_UNSPACED = 0xE00


def words(text: Column) -> Column:
    """The lower-cased words of a text."""
    unspaced = "[" + "".join(rf"\p{{Is{name}}}" for name in UNSPACED) + "]"
    lower = F.lower(F.coalesce(text, F.lit("")))
    some = lower.rlike(rf"[\x{{{FIRST_UNSPACED:x}}}-\x{{10ffff}}]")  # most texts need no replacing
    apart = F.when(some, F.regexp_replace(lower, f"({unspaced})", " $1 ")).otherwise(lower)
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def hashed_shingles(hashes: Column, width: int) -> Column:
    """One hash for each run of ``width`` word hashes, in order."""
    at = lambda i: [F.get(hashes, i + k) for k in range(width)]
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*at(i)))
    return F.when(F.size(hashes) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def written_shingles(tokens: Column, width: int) -> Column:
    """The shingles of ``width`` words as text."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(F.size(tokens) >= width, runs).otherwise(F.array().cast("array<string>"))


def _of_item(shingles, words_of: Column) -> Column:
    """The shingles of an item: of all its words, if it is short."""
    out = shingles(words_of, WIDTH)
    for width in range(1, WIDTH):
        out = F.when(F.size(words_of) == width, shingles(words_of, width)).otherwise(out)
    return out


def _of_document(shingles, words_of: Column, short: list[int]) -> Column:
    """The shingles of a document that can be an item's."""
    return F.concat(shingles(words_of, WIDTH), *[shingles(words_of, width) for width in short])


def short_widths(items: DataFrame) -> list[int]:
    """The word counts under ``WIDTH`` that items have: a few numbers."""
    counted = items.select(F.size(words(F.col("text"))).alias("n")).filter(F.col("n").between(1, WIDTH - 1)).distinct()
    return sorted(r["n"] for r in counted.collect())


def _hashes(df: DataFrame, keys: list[str], shingles) -> DataFrame:
    """(keys..., shingles): word hashes are a column of their own, so that each
    word is hashed once and not once for each shingle that it is in."""
    hashed = df.select(*keys, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*keys, shingles(F.col("hashes")).alias("shingles"))


def sketch_length(n: Column, threshold: float) -> Column:
    """Length of the sketches in the size partition that holds ``n`` shingles."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.5)) + 1) - 1
    return (largest - F.ceil(largest * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def sketch_index(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash): the bottom sketch of every item."""
    distinct = _hashes(items, ["item_id"], lambda h: _of_item(hashed_shingles, h)).select("item_id", F.array_sort(F.array_distinct("shingles")).alias("shingles"))
    some = distinct.filter(F.size("shingles") > 0)
    kept = F.slice(F.col("shingles"), F.lit(1), sketch_length(F.size("shingles"), threshold))
    return some.select("item_id", _exploded(kept))


def _exploded(hashes: Column) -> Column:
    """One row per hash.  The outer form keeps the optimizer from inferring a
    filter on the size, which would compute the shingles twice, and inlined."""
    return F.explode_outer(hashes).alias("hash")


def _sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): the key tells texts under a repeated id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment) of every leak."""
    keyed = _keyed(docs, id_col, text_col)
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    index = _sized(saved(sketch_index(tests, threshold), "sketches"))
    short = short_widths(tests)
    probes = _hashes(keyed, ["doc_id", "text_key"], lambda h: _of_document(hashed_shingles, h, short)).select("doc_id", "text_key", _exploded(F.col("shingles")))
    pairs = saved(probes.join(index, "hash").select("doc_id", "text_key", "item_id").distinct(), "candidates")

    wanted = pairs.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "item_id")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    candidates = keyed.join(_sized(wanted), same).select("doc_id", "text_key", "item_id", words(F.col("text")).alias("tokens"))
    known = tests.select(F.col("item_id").alias("item"), words(F.col("text")).alias("item_tokens"))
    known = known.select("item", F.array_distinct(_of_item(written_shingles, F.col("item_tokens"))).alias("item_shingles"))
    joined = candidates.join(_sized(known), F.col("item_id").eqNullSafe(F.col("item")))
    shared = F.size(F.array_intersect(_of_document(written_shingles, F.col("tokens"), short), F.col("item_shingles"))).cast("long")
    counted = joined.select("doc_id", "text_key", "item_id", shared.alias("n_shared"), F.size("item_shingles").cast("long").alias("n_item"))
    return counted.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))).withColumn(
        "containment", F.col("n_shared") / F.col("n_item")
    )


def leak_report(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment), one row per pair."""
    best = find_leaks(docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    bad = find_leaks(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    bad = _sized(saved(bad, "leaks"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")


def sketch_length_of(n: int, threshold: float = THRESHOLD) -> int:
    """:func:`sketch_length` of one number, for tests."""
    largest = 2 ** (n.bit_length()) - 1
    return largest - math.ceil(largest * threshold - 1e-9) + 1


#: The pairs by exact containment over all shingles.
ORACLE_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, lower(coalesce(text, '')) AS text FROM documents UNION ALL SELECT 'b', item_id, lower(coalesce(text, '')) FROM benchmark),
u AS (SELECT kind, id, regexp_replace(text, '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g') AS text FROM t),
v AS (SELECT kind, id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM u),
b AS (SELECT id AS item_id, w, least(5, len(w)) AS k FROM v WHERE kind = 'b' AND len(w) > 0),
ks AS (SELECT 5 AS k UNION SELECT k FROM b),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT id AS doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM v, ks WHERE kind = 'd')),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / CAST(n_item AS DOUBLE) AS containment
FROM m JOIN bn USING (item_id) WHERE n_shared >= ceil(n_item * CAST(0.8 AS DOUBLE) - CAST(0.000000001 AS DOUBLE))
"""
