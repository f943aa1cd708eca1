"""Evaluation texts leaking into training text.

Method: spaced-seed hashing. Windows of SPAN words are hashed under fixed masks that each ignore some positions; hashes of
the corpus are joined with those of the evaluation texts, and the windows of every hit are compared word by word,
tolerating substitutions. With the masks of SEEDS any window of 12 words with at most two substituted words is hit by at
least one mask, an exact one by all.

Both sides are tables and meet in one shuffle join on the masked hash; the corpus is read once, however many evaluation
texts there are. Before the shuffle a filter of fixed size (a bitmap of the evaluation hashes) drops the corpus windows
that cannot hit; what it lets through by mistake the join drops. Hashes that a large part of the corpus hits (a standing
text) are salted. The pairs of windows found are as many as the result needs: one per place where an item stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.scale import join_salted, map_arrow, written

#: Words of a window.
SPAN = 12
#: The window falls into four parts of three words; each mask looks at two parts and ignores the other two.
SEEDS = [[p * 3 + i for p in parts for i in range(3)] for parts in combinations(range(4), 2)]
#: Substituted words tolerated in a window of SPAN words.
SUBSTITUTED = 2
#: The filter has 2^FILTER_BITS bits (8 MB), whatever the evaluation texts: more of them only let more windows through.
FILTER_BITS = 26
#: Words hashed at a time; a text of more characters is taken in pieces of so many words that overlap by SPAN - 1 words.
PIECE_WORDS = 1 << 18
#: Words whose hashes a worker remembers before it starts anew.
CACHED_WORDS = 200_000

#: A run of letters and digits (\\w without the underscore).
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def _masked(words, mask: list[int], n: int):
    """64-bit hashes of the words that `mask` looks at, for each of the n windows."""
    import numpy as np

    h = np.full(n, 0x9E3779B97F4A7C15 * (mask[0] + 16 * mask[-1] + 1) & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for p in mask:
            h = (h ^ words[p : p + n]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, list[int]]]:
    """(text index, first word, hashes of the words) of texts, long ones in overlapping pieces."""
    hashed = _hashes.__getitem__
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= PIECE_WORDS:
            yield i, 0, list(map(hashed, words_of(text)))
            continue
        found, at, kept = (m[0] for m in _WORD.finditer(text.lower())), 0, []
        while fresh := list(map(hashed, islice(found, PIECE_WORDS))):
            yield i, at - len(kept), kept + fresh
            at, kept = at + len(fresh), (kept + fresh)[1 - SPAN :]


def _blocks(texts: list[str | None]) -> Iterator[tuple]:
    """(words, places, text index of each, first word of each): pieces laid end to end, about PIECE_WORDS words at a time.

    places: where a window of 12 words of one piece begins in `words`.
    """
    import numpy as np

    def laid(pieces: list[tuple]) -> tuple:
        words = np.array([w for _, _, p in pieces for w in p], np.uint64)
        sizes = np.array([len(p) for _, _, p in pieces])
        windows = np.maximum(sizes - SPAN + 1, 0)
        which = np.repeat(np.arange(len(pieces)), windows)
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        return words, (np.cumsum(sizes) - sizes)[which] + inside, np.array([i for i, _, _ in pieces])[which], np.array([f for _, f, _ in pieces])[which] + inside

    pieces, size = [], 0
    for piece in _pieces(texts):
        pieces.append(piece)
        size += len(piece[2])
        if size >= PIECE_WORDS:
            yield laid(pieces)
            pieces, size = [], 0
    if pieces:
        yield laid(pieces)


def _seeds(batches: Iterator, bitmap=None) -> Iterator:
    """(h, id, copy, at, words) of every window of 12 words and mask; with a bitmap, of those whose hash is in it."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for words, places, texts, firsts in _blocks(batch.column(1).to_pylist()):
            if not len(places):
                continue
            hashes, kept, n = [], [], len(words) - SPAN + 1
            for mask in SEEDS:
                h = _masked(words, mask, n)[places]
                some = np.arange(len(h)) if bitmap is None else np.flatnonzero(_in_filter(bitmap, h))
                hashes.append(h[some])
                kept.append(some)
            h, some = np.concatenate(hashes), np.concatenate(kept)
            if len(h):
                windows = np.lib.stride_tricks.sliding_window_view(words, SPAN)[places[some]].view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(windows) + 1, SPAN, dtype=np.int32)), pa.array(windows))
                rows = pa.array(texts[some])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(firsts[some].astype(np.int32)), lists], ["h", "id", "copy", "at", "words"])


def _in_filter(bitmap, h):
    """Whether both bits of a hash are set; they come from different parts of it."""
    import numpy as np

    found = np.ones(len(h), bool)
    for shift in (0, 38):
        bit = (h >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        found &= (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter(seeds: DataFrame):
    """The bitmap of the hashes of `seeds`: at most 2^FILTER_BITS / 64 rows reach the driver."""
    import numpy as np

    bit = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = seeds.select(F.explode(F.array(bit(0), bit(38))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bitmap[np.asarray(words["w"], np.int64)] = np.asarray(words["v"], np.int64).view(np.uint64)
    return bitmap


def _alignments(batches: Iterator) -> Iterator:
    """What document and item have in common on one diagonal, from its matching windows (document place, equal words as bits, first word highest)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for places in batch.column("places").to_pylist():
            at = np.array([p["at"] for p in places])
            low = int(at.min())
            covered, equal = np.zeros(int(at.max()) - low + SPAN, bool), np.zeros(int(at.max()) - low + SPAN, bool)
            for p in places:
                k = p["at"] - low
                covered[k : k + SPAN] = True
                equal[k : k + SPAN] |= [bool(p["equal"] >> (SPAN - 1 - j) & 1) for j in range(SPAN)]
            breaks = np.flatnonzero(np.concatenate([[True], ~(covered & equal), [True]]))
            rows.append((int(np.diff(breaks).max()) - 1, int(covered.sum()), int((covered & equal).sum()), low))
        found = [pa.array([r[k] for r in rows], pa.int32()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "copy", "item_id", "item_copy")] + found, ["doc_id", "copy", "item_id", "item_copy", "exact_run", "span_words", "equal_words", "first_word"])


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, exact_run, span_words, equal_words, first_word) for every document that holds part of an item.

    A row means: some window of 12 consecutive words of the item stands in the document with at most two words
    substituted. span_words: the words covered by such windows on the best alignment; equal_words: those of them that are
    the same; exact_run: the most of these in a row (all of a run of 12 or more is covered by its own windows);
    first_word: where they begin. Words are runs of letters and digits, lower-cased.

    Null and empty texts, and those under 12 words, match nothing. Null ids pass through as null. Rows with the same id and
    text are one document (or item) and come out once; with the same id and another text they come out each. Empty tables
    give an empty result, further columns do not matter.
    """
    spark = documents.sparkSession
    name = lambda df, c: df.select(F.col(f"`{c}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("copy"))
    rows, asked = name(documents, doc_id), name(items, item_id)
    kind = lambda df: df.schema["id"].dataType.simpleString()
    schema = "h bigint, id {}, copy bigint, at int, words array<bigint>"
    tests = written(map_arrow(asked, _seeds, schema.format(kind(asked))).distinct(), "evaluation-seeds")
    bitmap = spark.sparkContext.broadcast(_filter(tests))  # 2^FILTER_BITS bits
    hits = written(map_arrow(rows, lambda batches: _seeds(batches, bitmap.value), schema.format(kind(rows))), "corpus-seeds")
    wanted = tests.select("h", F.col("id").alias("item_id"), F.col("copy").alias("item_copy"), F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    both = join_salted(hits.select("h", F.col("id").alias("doc_id"), "copy", "at", "words"), wanted, "h")
    bits = F.aggregate(F.zip_with("words", "item_words", lambda a, b: a == b), F.lit(0), lambda s, same: s * 2 + same.cast("int"))
    matched = both.select("doc_id", "copy", "item_id", "item_copy", (F.col("at") - F.col("item_at")).alias("shift"), "at", bits.alias("equal"))
    near = matched.where(F.bit_count("equal") >= SPAN - SUBSTITUTED)
    # One row per window of the item on a diagonal: the item's length bounds the array.
    diagonals = near.groupBy("doc_id", "copy", "item_id", "item_copy", "shift").agg(F.collect_set(F.struct("at", "equal")).alias("places"))
    out = f"doc_id {kind(rows)}, copy bigint, item_id {kind(asked)}, item_copy bigint, exact_run int, span_words int, equal_words int, first_word int"
    aligned = map_arrow(diagonals.select("doc_id", "copy", "item_id", "item_copy", "places"), _alignments, out)
    best = aligned.groupBy("doc_id", "copy", "item_id", "item_copy").agg(F.max(F.struct("exact_run", "span_words", "equal_words", "first_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")
