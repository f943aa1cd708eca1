"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: merge replay. The distinct words of a block of the corpus are laid out once as byte tokens; an inverted index
from token pair to positions applies every merge in rank order and updates only the neighbours it touches. A word's
ids depend on nothing but the word, so blocks (Arrow batches) are independent: no shuffle, and memory is bounded by
the batch and a cache of words seen before.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.scale import map_arrow

#: Words whose ids a Python worker remembers; when there are more, it starts anew. Bounds memory, changes no result.
CACHED_WORDS = 200_000
#: Texts longer than this many characters are split twice instead of holding all their words.
LONG_TEXT = 1 << 20

_PAIR = 1 << 17  # more than any token id, so that left * _PAIR + right tells pairs apart


def default_path() -> str:
    """Where byte_bpe_50k.json lies on this machine; read by the driver only."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def split_pattern() -> str:
    """Fixed value: the pattern that splits text into words before the merges."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeTable:
    """The vocabulary as needed for replay: the token of each byte, and per merge rank the pair and what it makes."""

    def __init__(self, model: bytes) -> None:
        spec = json.loads(model)["model"]
        ids: dict[str, int] = spec["vocab"]
        # The file spells bytes as printable characters: printable ones as themselves, the others from 256 on in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.of_byte = [ids[spelled[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.rank = {a * _PAIR + b: r for r, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}


def replay(words: list[bytes], table: MergeTable) -> list[array]:
    """The token ids of each word: all merges applied to all words together, in rank order."""
    token, of_byte = [], table.of_byte
    for w in words:
        token += [of_byte[b] for b in w]
        token.append(-1)  # ends the word: no pair reaches across
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, left, right, made = table.rank, table.left, table.right, table.made
    index: dict[int, list[int]] = {}
    for i in range(n - 1):
        r = rank.get(token[i] * _PAIR + token[i + 1])
        if r is not None:
            index.setdefault(r, []).append(i)
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        r = heapq.heappop(queue)
        a, b, new = left[r], right[r], made[r]
        places = index.pop(r)
        places.sort()  # overlapping pairs merge from the left
        for i in places:
            j = after[i]
            if token[i] != a or token[j] != b:
                continue  # an earlier merge took one of the two
            k = after[j]
            token[i], token[j] = new, -2
            after[i], before[k] = k, i
            for at, pair in ((before[i], token[before[i]] * _PAIR + new), (i, new * _PAIR + token[k])):
                s = rank.get(pair)
                if s is not None:
                    if s in index:
                        index[s].append(at)
                    else:
                        index[s] = [at]
                        heapq.heappush(queue, s)
    out, current = [], array("i")
    for t in token:
        if t >= 0:
            current.append(t)
        elif t == -1:
            out.append(current)
            current = array("i")
    return out


class Encoder:
    """Encodes texts block by block, replaying only words it has not in its cache."""

    def __init__(self, model: bytes) -> None:
        import regex

        self.table, self.cache, self.split = MergeTable(model), {}, regex.compile(split_pattern())

    def _words(self, text: str) -> Iterator[str]:
        return (m[0] for m in self.split.finditer(text)) if len(text) > LONG_TEXT else iter(self.split.findall(text))

    def encode(self, texts: list[str | None]) -> tuple[array, array]:
        """(offsets, ids) of the texts' id lists; null and empty texts have empty lists."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, held, new = self.cache, [], set()
        for text in texts:
            words = [] if not text else self.split.findall(text) if len(text) <= LONG_TEXT else None
            held.append(words)
            new.update(w for w in (self._words(text) if words is None else words) if w not in cache)
        fresh = list(new)
        cache.update(zip(fresh, replay([w.encode("utf-8", "replace") for w in fresh], self.table)))
        offsets, ids = array("i", [0]), array("i")
        for text, words in zip(texts, held):
            for w in self._words(text) if words is None else words:
                ids.extend(cache[w])
            offsets.append(len(ids))
        return offsets, ids


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, model: Broadcast) -> Encoder:
    """This worker's encoder of the broadcast file `name`; a module's function, so that it outlives the task."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(model.value)
    return _encoders[name]


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of `documents`, ids being those of `text` without special tokens.

    A null or empty text has an empty list; strings that look like special tokens are ordinary text; texts are encoded
    whole, whatever their length. Rows with a null or repeated doc_id come out like any other, further columns do not
    matter, an empty table gives an empty result. `path` is the tokenizer's json file; its bytes (a fixed 1.5 MB)
    are broadcast, so only the driver needs it.
    """
    name = path or default_path()
    with open(name, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(name, model)
        for batch in batches:
            offsets, ids = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return map_arrow(rows, encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
