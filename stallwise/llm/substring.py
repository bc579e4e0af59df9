"""Substring dedup: suffix automata of reference shards, and matching statistics against them.

A window of words is removed from a document if it also starts in a smaller document. Every
window is filed under an anchor, the least hash of the short grams in it, which depends on
the window alone; a region is a run of windows with the same anchor. Only anchors that occur
in two documents matter. Equal regions of several documents are settled by the smallest
document that holds them. For anchors with different regions a suffix automaton of the
regions of smaller documents is built, a shard of anchors at a time, and the region's words
are streamed through it: where the matching statistics reach the window's length, the window
is covered. Anchors with more regions than a shard may hold are settled by counting their
windows, which needs no shard at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.llm.common import LAST_ID, dropped, staged
from stallwise.llm.rolling import Powers, Words, mixed

WINDOW = 13
GRAM = 5
# A region is at most so many windows, so that a bit each fits into a number.
REGION = 16
# Words of a text that are hashed at a time.
STRETCH = 1 << 17
# Fixed size of the bit field of repeated anchors: 2**26 bits are 8 MB, whatever the input.
FIELD = 26
BLOCK_WORDS = 1 << 13
# Regions that a task remembers to have sent.
REMEMBERED = 1_000_000
# Regions of one anchor, and words of all regions, that one automaton holds.
ANCHOR_REGIONS = 4_000
SHARD_WORDS = 100_000

REGIONS = "doc long, text_key long, anchor long, region long, start int, windows int, words binary"


def anchored(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each region."""
    hashes = words.grams(gram)
    n = words.count - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    width, least = window - gram + 1, hashes
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n], least[width - size :])
    new = np.append(True, least[1:] != least[:-1])
    first = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.flatnonzero(since % REGION == 0)
    return least[first], first, np.diff(np.append(first, n))


def stretches(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    """``words`` in overlapping stretches, so that every window lies in exactly one."""
    for at in range(0, max(1, len(words) - window + 1), STRETCH):
        yield at, words[at : at + STRETCH + window - 1]


def marking(window: int, gram: int):
    """(anchor, doc): each anchor of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            anchors, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                for _, words in stretches((text.as_py() or "").encode().split(), window):
                    found = np.unique(anchored(Words(words, powers), window, gram)[0])
                    anchors.append(found)
                    docs.append(np.full(len(found), doc))
            columns = [pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(docs))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc"])

    return run


def probes(anchor):
    """Two places of an anchor in the bit field."""
    mask = (1 << FIELD) - 1
    return anchor & mask, (anchor >> FIELD) & mask


def packed_bits(key: tuple, words: pd.DataFrame) -> pd.DataFrame:
    """The words of one block of the bit field as bytes."""
    block = np.zeros(BLOCK_WORDS, np.int64)
    block[words["word"].to_numpy() % BLOCK_WORDS] = words["bits"].to_numpy()
    return pd.DataFrame({"block": [key[0]], "data": [block.tobytes()]})


def bit_field(repeated: DataFrame) -> np.ndarray:
    """The places of the repeated anchors as bits; its size does not depend on their number."""
    mask = (1 << FIELD) - 1
    places = F.array(F.col("anchor").bitwiseAND(mask), F.shiftright("anchor", FIELD).bitwiseAND(mask))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))"))
    words = repeated.select(F.explode(places).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(bits.alias("bits"))
    blocks = words.groupBy(F.expr(f"word div {BLOCK_WORDS}").alias("block")).applyInPandas(packed_bits, "block long, data binary")
    field = np.zeros(1 << (FIELD - 6), np.uint64)
    for row in blocks.collect():
        at = row["block"] * BLOCK_WORDS
        field[at : at + BLOCK_WORDS] = np.frombuffer(row["data"], np.uint64)
    return field


def hits(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which anchors may be in a bit field."""
    found = [bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in probes(anchors)]
    return (found[0] & found[1]).astype(bool)


def holding(field):
    """Rows whose anchor may be in the field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(field.value, batch.column("anchor").to_numpy())))

    return run


def listing(field, window: int, gram: int):
    """The regions whose anchor may be repeated; equal regions of a task carry their words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), field.value
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "text_key", "anchor", "region", "start", "windows", "words")}
            if len(seen) > REMEMBERED:
                seen.clear()
            docs, keys = batch.column("doc").to_pylist(), batch.column("text_key").to_pylist()
            for doc, key, text in zip(docs, keys, batch.column("text"), strict=True):
                for at, piece in stretches((text.as_py() or "").encode().split(), window):
                    words = Words(piece, powers)
                    anchors, first, n = anchored(words, window, gram)
                    keep = np.flatnonzero(hits(bits, anchors.view(np.int64)))
                    if not len(keep):
                        continue
                    anchors, first, n = anchors[keep], first[keep], n[keep]
                    last = first + n + window - 2
                    regions = words.runs(first, last).view(np.int64)
                    begins, ends = words.starts[first].tolist(), words.ends[last].tolist()
                    for a, r, f, w, b, e in zip(anchors.view(np.int64).tolist(), regions.tolist(), first.tolist(), n.tolist(), begins, ends, strict=True):
                        new = r not in seen
                        seen.add(r)
                        for k, v in zip(out, (doc, key, a, r, at + f, w, words.joined[b:e] if new else None), strict=True):
                            out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


class Automaton:
    """Suffix automaton of several word sequences, built as they come."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, follow: dict[bytes, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, target: int, word: bytes) -> int:
        """The state of the shorter sequences of ``target`` that ``state`` and ``word`` reach."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            target = following[last].get(word)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, target, word)
                continue
            state = last
            last = self._state(length[last] + 1, 0, {})
            while state >= 0 and word not in following[state]:
                following[state][word] = last
                state = link[state]
            if state >= 0:
                target = following[state][word]
                link[last] = target if length[target] == length[state] + 1 else self._split(state, target, word)

    def covered(self, words: list[bytes], window: int) -> int:
        """Bits of the windows of ``words`` that occur in a sequence added so far."""
        following, link, length = self.next, self.link, self.length
        state = match = mask = 0
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                match = length[state]
            target = following[state].get(word)
            if target is None:
                continue
            state, match = target, match + 1
            if match >= window:
                mask |= 1 << (i - window + 1)
        return mask


def settled(regions: list[tuple[int, int, int, list[bytes]]], window: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, region, mask) of the regions (anchor, first, region, words), sorted by anchor and first.

    Regions of one document do not count for each other: all are streamed, then added.
    """
    automaton, at = Automaton(), 0
    while at < len(regions):
        end = at
        while end < len(regions) and regions[end][:2] == regions[at][:2]:
            end += 1
        for anchor, _, region, words in regions[at:end]:
            mask = automaton.covered(words, window)
            if mask:
                yield anchor, region, mask
        for _, _, _, words in regions[at:end]:
            automaton.add(words)
        at = end


def matching(window: int):
    """Streams regions sorted by anchor through automata of a shard of anchors each."""
    names, kinds = ["anchor", "region", "mask"], [pa.int64(), pa.int64(), pa.int32()]

    def flushed(regions: list) -> pa.RecordBatch:
        columns = list(zip(*settled(regions, window), strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[bytes]]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("anchor", "first", "region", "words")]
            for anchor, first, region, words in zip(*columns, strict=True):
                if held and size > SHARD_WORDS and anchor != held[-1][0]:
                    yield flushed(held)
                    held, size = [], 0
                held.append((anchor, first, region, words.split(b" ")))
                size += len(held[-1][3])
        yield flushed(held)

    return run


def windowing(window: int):
    """Every window of the regions on its own: (anchor, region, first, nth, window)."""
    names, kinds = ["anchor", "region", "first", "nth", "window"], [pa.int64()] * 3 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("anchor", "region", "first", "words")]
            for anchor, region, first, joined in zip(*columns, strict=True):
                hashes = mixed(Words(joined.split(b" "), powers).grams(window)).view(np.int64).tolist()
                out += [(anchor, region, first, i, h) for i, h in enumerate(hashes)]
            found = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names)

    return run


def masks_of(found: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """(anchor, region, mask): windows of each region that a smaller document has in another region.

    Only regions of anchors with several regions need their words; a bit field of these
    anchors keeps the others out of the shuffle.
    """
    per = regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions"), F.min("first").alias("low"), F.max("last").alias("high"))
    per = staged(per.filter("regions > 1 AND low < high").select("anchor", "regions"), "several")
    field = found.sparkSession.sparkContext.broadcast(bit_field(per))
    rows = found.select("anchor", "region", "doc", "words").mapInArrow(holding(field), "anchor long, region long, doc long, words binary")
    worded = rows.groupBy("anchor", "region").agg(F.min("doc").alias("first"), F.max("words").alias("words"))
    several = staged(worded.join(per, "anchor"), "worded")
    few = several.filter(F.col("regions") <= ANCHOR_REGIONS).select("anchor", "first", "region", "words")
    shards = few.repartition("anchor").sortWithinPartitions("anchor", "first", "region")
    by_automaton = shards.mapInArrow(matching(window), "anchor long, region long, mask int")
    many = several.filter(F.col("regions") > ANCHOR_REGIONS).select("anchor", "region", "first", "words")
    each = many.mapInArrow(windowing(window), "anchor long, region long, first long, nth int, window long")
    least = each.groupBy("window").agg(F.min("first").alias("least"))
    late = each.join(least, "window").filter("least < first")
    by_count = late.groupBy("anchor", "region").agg(F.bit_or(F.expr("shiftleft(1, nth)")).alias("mask"))
    masks = staged(by_automaton.unionByName(by_count), "masks")
    dropped(several)
    return masks


def covered_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, text_key, spans): starts and bit masks of the windows to remove from a text."""
    anchors = docs.select("doc", "text").mapInArrow(marking(window, gram), "anchor long, doc long")
    twice = anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    field = docs.sparkSession.sparkContext.broadcast(bit_field(twice.select("anchor")))
    found = staged(docs.select("doc", "text_key", "text").mapInArrow(listing(field, window, gram), REGIONS), "regions")
    regions = staged(found.groupBy("anchor", "region").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "distinct-regions")
    masks = masks_of(found, regions, window)
    known = regions.join(masks, ["anchor", "region"], "left").filter("mask IS NOT NULL OR first < last")
    whole = F.expr("cast(shiftleft(1L, windows) - 1 as int)")
    covered = (
        found.drop("words")
        .join(known, ["anchor", "region"])
        .withColumn("mask", F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("mask")))
        .filter("mask != 0")
    )
    return covered.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def removing(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, texts = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                removed = 0
                if spans.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    starts = spans.values.field("start").to_numpy()
                    masks = spans.values.field("mask").to_numpy()
                    for i in range(REGION):
                        at = starts[masks >> i & 1 == 1] + i
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    removed = len(words) - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                totals.append(len(words) + removed)
                gone.append(removed)
                texts.append(b" ".join(words).decode())
            columns = [batch.column("row"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, n_words, n_removed, kept_text): every row of ``docs`` as a struct, and its kept words.

    A word goes if a window of ``window`` words that covers it also starts in a document with
    a smaller doc_id; windows are judged on the input. Words are what ASCII white space
    separates. A null text has no words. Rows with an equal doc_id are one document; a null
    doc_id counts as the largest. All columns of the input are in ``doc``, whatever their names.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    spans = covered_windows(rows, window, gram)
    joined = rows.join(spans, ["doc", "text_key"], "left").select("row", "text", "spans")
    schema = (
        T.StructType([T.StructField("doc", rows.schema["row"].dataType)])
        .add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    )
    return joined.mapInArrow(removing(window), schema)
