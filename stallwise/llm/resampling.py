"""Importance resampling towards a target: documents whose words look like the target's are drawn.

Features are words and pairs of neighbouring words, hashed into buckets by CRC-32. The frequent
words and pairs of the whole corpus are broadcast, words with the CRC state after them and
pairs with their bucket; a word outside this head is hashed directly, a pair goes on from the
state of its first word. Both give the same buckets, so the totals are exact whatever the head is.

A bucket's gain is the log of its share in the target over its share in the corpus, a
document's weight the mean gain of its features. Weights get noise from a hash of the id and the
highest are drawn, which is sampling without replacement in proportion to exp(weight).

A null text has no words and a null id is hashed as an empty one; repeated rows are rows of
their own. An empty target or corpus counts as having no features.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.operators.ordered import with_position

# Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# So many words and pairs are broadcast at most, none of them longer than LONGEST bytes.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 20_000, 40_000, 64
SCALE = 1000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


# ---- the head ------------------------------------------------------------------


def thinned(counts: dict, size: int) -> dict:
    """Misra-Gries: at most ``size`` counters stay, lowered by the largest that goes."""
    cut = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -size - 1)[-size - 1]
    return {k: n - int(cut) for k, n in counts.items() if n > cut}


def batch_words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of a batch, and how many each text has."""
    texts = [words_of(text.as_py()) for text in batch.column("text")]
    return list(chain.from_iterable(texts)), np.fromiter(map(len, texts), np.int64, len(texts))


def neighbours(sizes: np.ndarray) -> np.ndarray:
    """Positions of the words that have a next word in their own text."""
    inside = np.ones(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)
    inside[ends[sizes > 0] - 1] = False
    return np.flatnonzero(inside)


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the frequent words and pairs of a task's texts, in bounded memory.

    A pair that a batch has once is not counted, so counts of pairs are too low by one a batch
    at most; they only choose the head.
    """
    single: dict[bytes, int] = {}
    double: dict[tuple[bytes, bytes], int] = {}
    for batch in batches:
        words, sizes = batch_words(batch)
        index: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        distinct = list(index)
        for word, n in zip(distinct, np.bincount(ids).tolist(), strict=True):
            single[word] = single.get(word, 0) + n
        at = neighbours(sizes)
        pairs, counts = np.unique(ids[at] * len(index) + ids[at + 1], return_counts=True)
        again = counts > 1
        for pair, n in zip(pairs[again].tolist(), counts[again].tolist(), strict=True):
            key = (distinct[pair // len(index)], distinct[pair % len(index)])
            double[key] = double.get(key, 0) + n
        if len(single) > 8 * HEAD_WORDS:
            single = thinned(single, 4 * HEAD_WORDS)
        if len(double) > 8 * HEAD_PAIRS:
            double = thinned(double, 4 * HEAD_PAIRS)
    rows = [(w, None, n) for w, n in Counter(single).most_common(2 * HEAD_WORDS) if len(w) <= LONGEST]
    rows += [(a, b, n) for (a, b), n in Counter(double).most_common(2 * HEAD_PAIRS) if len(a) <= LONGEST and len(b) <= LONGEST]
    first, second, n = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(n, pa.int64())], ["first", "second", "n"])


@dataclass
class Head:
    """The broadcast vocabulary: frequent words with their CRC states, frequent pairs with their buckets."""

    words: list[bytes]
    states: list[int]
    pairs: list[tuple[bytes, bytes]]
    pair_buckets: list[int]
    buckets: int


def head_of(texts: DataFrame, buckets: int) -> Head:
    """The most frequent words and pairs of all texts, as far as the tasks' counters show them."""
    found = staged(texts.select("text").mapInArrow(frequent, "first binary, second binary, n long"), "frequent-features")
    summed = found.groupBy("first", "second").agg(F.sum("n").alias("n"))

    def top(rows: DataFrame, size: int) -> list:
        return rows.orderBy(F.desc("n"), "first", "second").limit(size).collect()  # at most ``size`` short rows

    words = [bytes(r["first"]) for r in top(summed.filter("second IS NULL"), HEAD_WORDS)]
    pairs = [(bytes(r["first"]), bytes(r["second"])) for r in top(summed.filter("second IS NOT NULL"), HEAD_PAIRS)]
    held = set(words)
    pairs = [(a, b) for a, b in pairs if a in held and b in held]
    return Head(words, [zlib.crc32(w) for w in words], pairs, [zlib.crc32(a + b" " + b) % buckets for a, b in pairs], buckets)


# ---- buckets of features ---------------------------------------------------------


def shift_tables(longest: int) -> np.ndarray:
    """[length, byte of a CRC, value]: what that byte becomes after ``length`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [now]
    for _ in range(longest):
        now = step[now & 255] ^ (now >> 8)
        tables.append(now)
    return np.stack(tables)


class Features:
    """Buckets of words and pairs from the head, and directly where it does not have them.

    A CRC is linear: that of two texts in a row is the first one's, moved on by the length of
    the second, xor the second one's. So a pair outside the head needs the states of its words.
    """

    def __init__(self, head: Head):
        self.buckets = head.buckets
        self.index = {w: i for i, w in enumerate(head.words)}
        self.states = np.array(head.states, np.uint32)
        self.shift = shift_tables(LONGEST + 1)
        blank = np.array([zlib.crc32(b" ")], np.uint32)
        self.blanks = np.array([self.moved(blank, np.array([n]))[0] for n in range(LONGEST + 1)], np.uint32)
        # Pairs of the head by a slot of their own; of two in one slot the rarer is not kept.
        self.slots = 1 << max(1, 3 + len(head.pairs)).bit_length()
        self.keys = np.full(self.slots, -1, np.int64)
        self.known = np.zeros(self.slots, np.int64)
        first, second = (np.array([self.index[p[k]] for p in head.pairs], np.int64)[::-1] for k in (0, 1))
        keys = self.key(first, second)
        self.keys[self.slot(keys)] = keys
        mine = self.keys[self.slot(keys)] == keys
        self.known[self.slot(keys)[mine]] = np.array(head.pair_buckets, np.int64)[::-1][mine]

    def key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * np.int64(HEAD_WORDS) + second

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> 7) & (self.slots - 1)

    def moved(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC states after so many zero bytes."""
        t = self.shift
        return t[lengths, 0, states & 255] ^ t[lengths, 1, (states >> 8) & 255] ^ t[lengths, 2, (states >> 16) & 255] ^ t[lengths, 3, states >> 24]

    def __call__(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, the positions of those with a next word, and the buckets of these pairs."""
        get = self.index.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        states = self.states[ids] if len(self.states) else np.zeros(len(words), np.uint32)
        tail = np.flatnonzero(ids < 0)
        states[tail] = np.fromiter((zlib.crc32(words[i]) for i in tail.tolist()), np.uint32, len(tail))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = neighbours(sizes)
        keys = self.key(ids[at], ids[at + 1])
        slots = self.slot(keys)
        pairs = self.known[slots]
        unseen = np.flatnonzero((ids[at] < 0) | (ids[at + 1] < 0) | (self.keys[slots] != keys))
        first, second = at[unseen], at[unseen] + 1
        short = lengths[second] <= LONGEST
        a, b = first[short], second[short]
        crc = self.moved(states[a], lengths[b] + 1) ^ self.blanks[lengths[b]] ^ states[b]
        pairs[unseen[short]] = crc % np.uint32(self.buckets)
        for i in unseen[~short].tolist():  # long words, one by one
            pairs[i] = zlib.crc32(b" " + words[at[i] + 1], int(states[at[i]])) % self.buckets
        return (states % np.uint32(self.buckets)).astype(np.int64), at, pairs


# ---- totals and scores -----------------------------------------------------------


def totalling(head):
    """Texts to (bucket, n): the features of all texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(head.value)
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            single, _, double = features(*batch_words(batch))
            for found in (single, double):
                total += np.bincount(found, minlength=features.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, head, buckets: int) -> np.ndarray:
    """Exact number of features per bucket over all texts; one number per bucket reaches the driver."""
    found = texts.select("text").mapInArrow(totalling(head), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in found.collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the smoothed log ratio of its shares, rounded down."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = [(t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, key: str) -> int:
    """A thousand times a Gumbel variate from a hash of seed and key, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = "n_words long, n_features long, weight long, score long"


def scoring(head, gain: np.ndarray, seed: int):
    """(doc, key, text) to (doc, n_words, n_features, weight, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(head.value)
        for batch in batches:
            words, sizes = batch_words(batch)
            single, at, double = features(words, sizes)
            each = gain[single]
            each[at] += gain[double]
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(sizes)
            number = sizes + np.maximum(sizes - 1, 0)
            weight = (upto[ends] - upto[ends - sizes]) // np.maximum(number, 1)
            score = weight + np.array([noise(seed, key) for key in batch.column("key").to_pylist()], np.int64)
            columns = [pa.array(x, pa.int64()) for x in (sizes, number, weight, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", "n_words", "n_features", "weight", "score"])

    return run


def resampled(
    docs: DataFrame, target: DataFrame, keep: Sequence[str] = ("doc_id",), percent: int = 25, least: int = 20,
    buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text, ...).

    ``doc`` holds the columns named by ``keep``. Of the documents with at least ``least`` words,
    ``percent`` of a hundred get a rank, 1 for the highest score; ties go to the smaller id (a null
    id last), then to fewer features, the smaller weight and the rest of ``doc``.
    """
    texts = docs.select("text")
    both = texts.unionByName(target.select("text"))
    head = docs.sparkSession.sparkContext.broadcast(head_of(both, buckets))
    gain = gains(bucket_totals(texts, head, buckets), bucket_totals(target, head, buckets))
    rows = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, {SCORES}"
    scored = staged(rows.mapInArrow(scoring(head, gain, seed), schema), "resampling-scores")
    able = scored.filter(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    first = F.asc_nulls_last("doc.doc_id") if "doc_id" in keep else F.lit(0)
    placed = with_position(able, [F.desc("score"), first, "n_features", "weight", "doc"], "rank")
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
