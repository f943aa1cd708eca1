"""Long exact spans shared between records.

Method: relative Lempel-Ziv factoring with a content-addressed reference. Every document against every other would be
quadratic, so a document meets the reference only where its own content points to it:

1. Anchors. Of every MIN_LENGTH characters at least one window of WINDOW characters is chosen by its hash alone
   (the smallest of STRIDE neighbours). Equal stretches of that length thus choose equal windows.
2. Reference. The block of an anchor that several documents chose is the passage around its first occurrence; the hash of
   the anchor is its index. An anchor of one document only has no reference and drops out, in a hash aggregation.
3. Factoring. Each passage of each document is factored against the block of its anchor: from the anchor the match is
   extended greedily in both directions, as text. What has no anchor in common with the reference is literal.
4. Factor boundaries. A factor of MIN_LENGTH characters is a duplicate span: documents whose factors overlap that far in
   one block share it. Where at least two documents leave a block at the same place with the same character they may go
   on together; their spans across that boundary are compared among themselves, by hash and then by SHA-256.

Work and shuffles grow with the passages, not with their pairs: a standing text of any length held by a third of all
documents is one block, factored row by row. Documents that share exactly the same spans form a class, so that links can
be counted, and pairs told, between classes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.scale import HOT_SHARE, counted, join_hot, join_salted, map_arrow, written

MIN_LENGTH = 300
WINDOW = 200
STRIDE = MIN_LENGTH - WINDOW + 1
#: Characters hashed at a time; longer texts are taken in pieces that overlap by MIN_LENGTH - 1.
PIECE = 1 << 20


def _mixed(x):
    """splitmix64's finalizer, on arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a given length: differences of prefix sums of mixed characters times powers of a base."""

    def __init__(self, base: int, size: int) -> None:
        import numpy as np

        self.base, inverse = base, pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)

    def windows(self, codes, length: int):
        import numpy as np

        with np.errstate(over="ignore"):
            values = _mixed(codes.astype(np.uint64) + np.uint64(self.base))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.up[: len(codes)], dtype=np.uint64)])
            n = len(codes) - length + 1
            return _mixed((sums[length:] - sums[:n]) * self.down[:n])


def _sliding(x, k: int, smallest: bool):
    """The smallest (or largest) of each k consecutive values, in a constant number of passes."""
    import numpy as np

    op, fill = (np.minimum, np.iinfo(np.uint64).max) if smallest else (np.maximum, 0)
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % k, fill, np.uint64)]).reshape(-1, k)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - k + 1], ahead[k - 1 : n])


_rolling: dict[tuple[int, int], Rolling] = {}
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _roller(which: int, size: int) -> Rolling:
    size = 1 << max(16, (size - 1).bit_length())
    if (which, size) not in _rolling:
        _rolling[which, size] = Rolling(_BASES[which], size)
    return _rolling[which, size]


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchors(texts: list[str]) -> tuple:
    """(text index, position, hash) of all chosen windows; ties are all chosen, so equal stretches choose alike."""
    import numpy as np

    pieces, owner, offset = [], [], []
    for i, t in enumerate(texts):
        codes = _codes(t)
        for a in range(0, max(1, len(codes) - MIN_LENGTH + 1), PIECE - MIN_LENGTH + 1):
            pieces.append(codes[a : a + PIECE])
            owner.append(i)
            offset.append(a)
    rows, places, hashes = [], [], []
    a = 0
    while a < len(pieces):  # short texts are hashed together
        b, size = a, 0
        while b < len(pieces) and (b == a or size + len(pieces[b]) <= PIECE):
            size += len(pieces[b])
            b += 1
        lengths = np.array([len(p) for p in pieces[a:b]])
        ends = np.cumsum(lengths)
        h = _roller(0, size).windows(np.concatenate(pieces[a:b]), WINDOW)
        left = np.repeat(ends, lengths)[: len(h)] - np.arange(len(h))  # characters up to the end of the text
        low = _sliding(h, STRIDE, True)
        low = np.where(left[: len(low)] >= MIN_LENGTH, low, np.uint64(0))  # stretches within one text only
        padded = np.concatenate([np.zeros(STRIDE - 1, np.uint64), low, np.zeros(STRIDE - 1, np.uint64)])
        chosen = np.flatnonzero((_sliding(padded, STRIDE, False) == h) & (left >= WINDOW))
        which = np.searchsorted(ends, chosen, "right")
        rows.append(np.array(owner[a:b])[which])
        places.append(chosen - (ends - lengths)[which] + np.array(offset[a:b])[which])
        hashes.append(h[chosen].view(np.int64))
        a = b
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, places, hashes))


def _anchor_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).to_pylist()
        rows, places, hashes = _anchors(texts)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32())], ["key", "doc_id", "pos"])


def _passages(batches: Iterator) -> Iterator:
    """Cuts the passage around every anchor of a document."""
    import pyarrow as pa

    reach = MIN_LENGTH - WINDOW
    names = ["key", "salt", "doc_id", "pos", "lead", "passage"]
    for batch in batches:
        rows = []
        for doc, text, anchors in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for a in anchors:
                low = max(0, a["pos"] - reach)
                rows.append((a["key"], a["salt"], doc, a["pos"], a["pos"] - low, text[low : a["pos"] + WINDOW + reach]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


_PASSAGES = "key bigint, salt int, doc_id bigint, pos int, lead int, passage string"


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _factor(lead: int, passage: str, ref_lead: int, reference: str) -> tuple:
    """(low, high, back, after, before_char, next_char) of a passage against the reference of its anchor.

    back and after: characters equal before and from the anchor. low..high: how many characters before the anchor a span
    of MIN_LENGTH inside the factor may begin; low > high if the factor is too short. The characters are those with
    which the passage leaves the reference, null where the passage itself ends.
    """
    ahead, behind = passage[lead:], passage[:lead][::-1]
    after, back = _common(ahead, reference[ref_lead:]), _common(behind, reference[:ref_lead][::-1])
    if after < WINDOW:
        back = after = 0  # equal hashes of different windows: nothing in common
    low, high = max(0, MIN_LENGTH - after), min(back, MIN_LENGTH - WINDOW)
    return low, high, back, after, behind[back : back + 1] or None, ahead[after : after + 1] or None


def _factors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [_factor(*r) for r in zip(*(batch.column(k).to_pylist() for k in ("lead", "passage", "ref_lead", "reference")))]
        kinds = [("low", pa.int32()), ("high", pa.int32()), ("back", pa.int32()), ("after", pa.int32()), ("before_char", pa.string()), ("next_char", pa.string())]
        found = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("key", "salt", "doc_id", "pos")] + found, ["key", "salt", "doc_id", "pos"] + [n for n, _ in kinds])


_FACTORS = "key bigint, salt int, doc_id bigint, pos int, low int, high int, back int, after int, before_char string, next_char string"


def _boundary_spans(batches: Iterator) -> Iterator:
    """Two hashes of every span of MIN_LENGTH characters around the given anchors that lies outside their factors."""
    import numpy as np
    import pyarrow as pa

    reach = MIN_LENGTH - WINDOW
    for batch in batches:
        for doc, text, anchors in zip(*(batch.column(k) for k in range(3))):
            codes = _codes(text.as_py())
            last, each = len(codes) - MIN_LENGTH, []
            for a in anchors.as_py():
                starts = np.arange(max(0, a["pos"] - reach), min(last, a["pos"]) + 1)
                before = a["pos"] - starts
                each.append(starts[(before < a["low"]) | (before > a["high"])])
            starts = np.unique(np.concatenate(each))
            for s in range(0, len(starts), PIECE):  # starts of a long text are taken piece by piece
                some = starts[s : s + PIECE]
                base, part = int(some[0]), codes[int(some[0]) : int(some[-1]) + MIN_LENGTH]
                one, two = (_roller(w, len(part)).windows(part, MIN_LENGTH)[some - base].view(np.int64) for w in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array([doc.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32())], ["k1", "k2", "doc_id", "start"])


def _long_texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= MIN_LENGTH))


def _shared_anchors(long: DataFrame) -> DataFrame:
    """(key, doc_id, pos, n, salts, salt, is_reference) of the anchors that at least two documents chose, n times in all.

    The rows of a hot anchor (over 1/HOT_SHARE of all) are cut into `salts` parts; all its later joins are on (key, salt).
    """
    anchors, total = counted(map_arrow(long, _anchor_rows, "key bigint, doc_id bigint, pos int"), "anchors")
    at = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(at).alias("first")).where("low < high").select("key", "n", "first")
    keys = written(keys, "shared-keys")
    salts = F.ceil(F.col("n") / F.lit(max(1000.0, total / HOT_SHARE))).cast("int")
    joined = join_hot(anchors, keys, "key", "n", total).select("key", "doc_id", "pos", "n", salts.alias("salts"), (at == F.col("first")).alias("is_reference"))
    return written(joined.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.col("salts")).cast("int")), "shared-anchors")


def _by_document(long: DataFrame, anchors: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, text, anchors): the documents concerned with their anchors, an array that the document's length bounds."""
    per_doc = anchors.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("anchors"))
    return long.join(per_doc, "doc_id").select("doc_id", "text", "anchors")


def _per_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _spans(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(kind, k1, k2, doc_id, start): spans of MIN_LENGTH characters; equal (kind, k1, k2) mean equal text.

    Of the spans inside factors only those that begin where some factor of the block begins or ends to allow a span: any
    two factors that overlap by MIN_LENGTH meet there, and first and last shared span of each document are among them.
    """
    long = _long_texts(documents, doc_id, text)
    anchors = _shared_anchors(long)
    passages = map_arrow(_by_document(long, anchors, "key", "pos", "salt"), _passages, _PASSAGES)
    firsts = anchors.where("is_reference")
    references = map_arrow(_by_document(long, firsts, "key", "pos", "salt"), _passages, _PASSAGES).select("key", F.col("lead").alias("ref_lead"), F.col("passage").alias("reference"))
    references = _per_salt(references.join(firsts.select("key", "salts"), "key"))
    factors = written(map_arrow(passages.join(references, ["key", "salt"]), _factors, _FACTORS), "factors")
    # Inside the factors.
    sizes = firsts.select("key", "n", "salts")
    whole = factors.where("low <= high")
    marks = whole.groupBy("key").agg(F.array_distinct(F.concat(F.collect_set("low"), F.collect_set("high"))).alias("marks"))  # at most STRIDE numbers
    marked = whole.join(_per_salt(marks.join(sizes.select("key", "salts"), "key")), ["key", "salt"])
    inside = marked.select("key", "doc_id", "pos", F.explode(F.filter("marks", lambda m: m.between(F.col("low"), F.col("high")))).alias("m"))
    inside = inside.select(F.lit(0).alias("kind"), F.col("key").alias("k1"), F.col("m").cast("bigint").alias("k2"), "doc_id", (F.col("pos") - F.col("m")).alias("start"))
    # Across the boundaries where documents leave a block together; a block of two rows has nobody to leave it with.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("back").alias("at"), F.col("before_char").alias("c")), F.struct(F.lit(1).alias("side"), F.col("after").alias("at"), F.col("next_char").alias("c")))
    crowded = _per_salt(sizes.where("n > 2").select("key", "salts"))
    ends = factors.join(crowded, ["key", "salt"]).select("key", "doc_id", "pos", "low", "high", F.explode(sides).alias("e")).where("e.c is not null").select("key", F.col("e.side").alias("side"), F.col("e.at").alias("at"), F.col("e.c").alias("c"), "doc_id", "pos", "low", "high")
    ends, n_ends = counted(ends.select(F.struct("key", "side", "at", "c").alias("end"), "doc_id", "pos", "low", "high"), "ends")
    together = ends.groupBy("end").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("end", "n")
    leaving = join_hot(ends, together, "end", "n", n_ends).select("doc_id", "pos", "low", "high").distinct()
    hashed, n_hashed = counted(map_arrow(_by_document(long, leaving, "pos", "low", "high"), _boundary_spans, "k1 bigint, k2 bigint, doc_id bigint, start int").withColumn("k", F.struct("k1", "k2")).drop("k1", "k2"), "boundary-spans")
    alike = hashed.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("k", "n")
    starts = join_hot(hashed, alike, "k", "n", n_hashed).select("doc_id", "start").distinct()
    each = _by_document(long, starts, "start").select("doc_id", "text", F.explode("anchors.start").alias("start"))
    digest = F.sha2(F.substring(F.col("text"), F.col("start") + 1, F.lit(MIN_LENGTH)), 256)
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("bigint")
    across = each.select(F.lit(1).alias("kind"), half(1).alias("k1"), half(17).alias("k2"), "doc_id", "start")
    return inside.unionByName(across)


def shared_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(span, doc_id, start): spans of MIN_LENGTH characters that at least two documents hold; `span` tells equal text.

    Ids are bigint and unique; rows with a null id or text, and shorter texts, share nothing.
    """
    members, total = counted(_spans(documents, doc_id, text).select(F.struct("kind", "k1", "k2").alias("span"), "doc_id", "start"), "spans")
    held = members.groupBy("span").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("span", "n")
    return join_hot(members, written(held, "held-spans"), "span", "n", total).select("span", "doc_id", "start")


def _classes(documents: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id, class_size) and links between classes (class_a, class_b), a < b; both written.

    A class is the documents that share the same spans, known by its lowest document. Spans held by the same documents (a
    long stretch has many) count as one, told by number, sum, xor and extremes of the documents' hashes. A span whose
    holders all have the same most widely held span adds no link to that one and is left out, so that what stands
    before and after a standing text does not split its class.
    """
    one, n_one = counted(_spans(documents, doc_id, text).select(F.struct("kind", "k1", "k2").alias("span"), "doc_id").distinct(), "holders")
    mark = F.xxhash64("doc_id")
    groups = one.groupBy("span").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    kept = groups.groupBy("n", "sum", "xor", "low", "high").agg(F.min("span").alias("span")).select("span", "n")
    distinct, n_distinct = counted(join_hot(one, written(kept, "kept-spans"), "span", "n", n_one).select("span", "doc_id", F.max(F.struct("n", "span")).over(W.partitionBy("doc_id")).getField("span").alias("widest")), "distinct-holders")
    telling = distinct.groupBy("span").agg(F.count("*").alias("n"), F.min("widest").alias("a"), F.max("widest").alias("b")).where("a <> b or a = span").select("span", "n")
    held = written(join_hot(distinct, telling, "span", "n", n_distinct).select("span", "doc_id"), "telling-holders")
    # The spans of a document: an array that its length bounds.
    signed, n_signed = counted(held.groupBy("doc_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_set("span"))), 256).alias("signature")), "signatures")
    classes = signed.groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    members = written(join_hot(signed, classes, "signature", "n", n_signed).select("doc_id", "class_id", F.col("n").alias("class_size")), "classes")
    first = members.where("doc_id = class_id").select("doc_id")
    reps = written(held.join(first, "doc_id").select("span", F.col("doc_id").alias("class_a")), "representatives")
    links = join_salted(reps, reps.withColumnRenamed("class_a", "class_b"), "span").where("class_a < class_b").select("class_a", "class_b").distinct()
    return members, links


def sharing_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, links): one row per document that shares a span, with its number of links.

    Documents of a class share exactly the same spans, so each links to all others of its class and to every document of
    the classes linked to it. Hot standing texts cost one class, not their pairs.
    """
    members, links = _classes(documents, doc_id, text)
    links = written(links, "links")
    sizes = members.where("doc_id = class_id").select("class_id", "class_size")
    both = links.union(links.select("class_b", "class_a")).toDF("class_id", "other")
    reached = both.join(sizes.toDF("other", "size"), "other").groupBy("class_id").agg(F.sum("size").alias("reached"))
    counted = sizes.join(reached, "class_id", "left").select("class_id", F.col("class_size").alias("n"), (F.coalesce("reached", F.lit(0)) + F.col("class_size") - 1).alias("links"))
    return join_hot(members, counted, "class_id", "n", members.count()).select("doc_id", "class_id", "class_size", "links")


def sharing_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two documents with at least MIN_LENGTH consecutive characters in common.

    Characters are Unicode code points, compared as written. Equal texts of that length are a pair; repeats inside
    one document are none; null, empty and shorter texts have no pair. Ids are unique. Made of the classes and their
    links by writing out the members; `sharing_classes` says the same without the pairs.
    """
    members, links = _classes(documents, doc_id, text)
    of = lambda name: members.select(F.col("class_id").alias(name), F.col("doc_id").alias(f"doc_{name[-1]}"))
    within = join_salted(of("class_a"), of("class_b").withColumnRenamed("class_b", "class_a"), "class_a").select("doc_a", "doc_b")
    sides = written(links.join(of("class_a"), "class_a").select("class_b", "doc_a"), "sides")
    between = join_salted(sides, of("class_b"), "class_b").select("doc_a", "doc_b")
    pairs = within.where("doc_a < doc_b").unionByName(between)
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))


def shared_stretches(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end): the maximal stretches of each document of which every character lies in a shared span."""
    spans = shared_spans(documents, doc_id, text).select("doc_id", "start", (F.col("start") + MIN_LENGTH).alias("end"))
    w = W.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.distinct().select("doc_id", "start", "end", F.when(F.col("start") <= reached, 0).otherwise(1).alias("new"))
    islands = islands.select("doc_id", "start", "end", F.sum("new").over(w).alias("island"))
    return islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_characters(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document with characters shared elsewhere."""
    per_doc = shared_stretches(documents, doc_id, text).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    sizes = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.length(F.col(f"`{text}`")).cast("bigint").alias("n_chars"))
    return sizes.join(per_doc, "doc_id").withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
