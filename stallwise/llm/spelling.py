"""Spelling variants: a word and the commoner words one edit away.

The vocabulary is sorted twice, by the words and by the words read backwards, and cut into
shards of bounded size. Two words one edit apart share their first half or their last half,
so a word only visits the shards of its own half in either order. In a shard the sorted list
is walked by columns: words with a common prefix are neighbours there, so a row of the banded
edit matrix is computed once for a whole range of them and goes on to the longer prefixes; a
range whose prefix is more than one edit away is left out with all its words.

Rows with a null text give nothing and a null id counts as an empty one. Only counts of
distinct words travel. A word's near words are found whole, whatever their number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import dropped, staged
from stallwise.operators.ordered import laid_out

# Letters of words in Latin-1: A-Z lower-cased, a-z and the letters from U+00C0 on; all else is blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
HELD = 500_000  # words a task counts before it hands the counts on
SHARD_BYTES = 1 << 17
SHARDS = 50_000  # the directory of shards has no more entries in either order
SHOWN = 64  # code points of a shard's first word in the directory
QUERIES = 8192  # words that visit a shard at a time
LAST = chr(0x10FFFF)


# ---- counting ------------------------------------------------------------------


def altered(key: str, word: bytes, one_in: int, state: int) -> bytes:
    """``word`` without one letter if the hash of ``key:word`` says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), state)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counting(shortest: int, one_in: int | None):
    """(key, text) to (word, n), as often as ``HELD`` words are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().encode("latin-1", "replace").translate(LETTERS).split()
                total.update(words)
                if one_in:
                    state = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(words).items():
                        new = altered(key, word, one_in, state)
                        if new is not word:
                            total[word] -= n
                            total[new] += n
                if len(total) > HELD:
                    yield counts(total, shortest)
                    total.clear()
        yield counts(total, shortest)

    return run


def counts(total: Counter, shortest: int) -> pa.RecordBatch:
    kept = [(w.decode("latin-1"), n) for w, n in total.items() if n > 0 and len(w) >= shortest]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, one_in: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least ``shortest`` letters and ``least`` occurrences.

    With ``one_in`` a document's word loses a letter where the hash of its id and the word is
    divisible by it: known misspellings, to test the grouping.
    """
    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    found = rows.mapInArrow(counting(shortest, one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- one shard -----------------------------------------------------------------


class Codes:
    """Code points of many words, one after the other."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if words else np.zeros(0, np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)

    def at(self, which: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """The code point of each word at a place, -1 outside the word."""
        inside = (place >= 0) & (place < self.lengths[which])
        if not len(self.points):
            return np.full(len(which), -1, np.int32)
        return np.where(inside, self.points[np.where(inside, self.starts[which] + place, 0)], -1)


def common_prefixes(words: list[str], codes: Codes) -> np.ndarray:
    """How many code points each word of a sorted list shares with the one before it."""
    shared = np.zeros(len(words), np.int64)
    alive = np.arange(1, len(words))
    depth = 0
    while len(alive):
        a, b = codes.at(alive, depth), codes.at(alive - 1, depth)
        alive = alive[(a == b) & (a >= 0)]
        depth += 1
        shared[alive] = depth
    return shared


def near_words(words: list[str], queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of positions, exactly one edit apart and equal in the query's half.

    ``words`` are sorted and distinct. Column after column, every range of neighbours with a
    common prefix has one row of the edit matrix, three cells wide, for each query that is
    still within one edit of that prefix.
    """
    list_codes, query_codes = Codes(words), Codes(queries)
    shared = common_prefixes(words, list_codes)
    n = len(words)
    entries: dict[int, list[tuple[int, int, int]]] = {}
    own = np.full(len(queries), -1)
    for i, (query, half) in enumerate(zip(queries, halves, strict=True)):
        low = bisect_left(words, query[:half])
        high = bisect_right(words, query[:half] + LAST, low)
        if low < high:
            entries.setdefault(half, []).append((i, low, high))
            at = bisect_left(words, query, low, high)
            own[i] = at if at < high and words[at] == query else -1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    who = first = end = np.zeros(0, np.int64)
    row = np.zeros((3, 0), np.int8)
    depths = sorted(entries)
    depth = depths[0] if depths else 0
    while len(who) or depths:
        if not len(who):
            depth = depths[0]
        if depths and depths[0] == depth:
            new = np.array(entries[depths.pop(0)], np.int64).T
            who, first, end = (np.concatenate(x) for x in zip((who, first, end), new, strict=True))
            # The prefixes are equal: one edit if the query is taken one longer or shorter.
            row = np.concatenate([row, np.tile(np.array([[1], [0], [1]], np.int8), len(new[0]))], 1)
        # The word that is this prefix is the first of its range.
        ends = list_codes.lengths[first] == depth
        if ends.any():
            gap = query_codes.lengths[who] - depth
            hit = ends & (np.abs(gap) <= 1)
            hit[hit] = row[(gap + 1)[hit], np.flatnonzero(hit)] == 1
            found.append((who[hit], first[hit]))
            first = first + ends
        # Ranges of prefixes one longer; a query that is alone with itself has nothing to find.
        alone = (first >= end) | ((end - first == 1) & (first == own[who]))
        who, first, end, row = who[~alone], first[~alone], end[~alone], row[:, ~alone]
        if not len(who):
            continue
        heads = np.flatnonzero((shared <= depth) & (list_codes.lengths > depth))
        low, high = np.searchsorted(heads, first), np.searchsorted(heads, end)
        sizes = high - low
        from_row = np.repeat(np.arange(len(who)), sizes)
        head = np.arange(len(from_row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        who, first, end = who[from_row], heads[head], np.minimum(np.append(heads, n)[head + 1], end[from_row])
        old, point = row[:, from_row], list_codes.at(first, depth)
        shorter = np.minimum(old[0] + (query_codes.at(who, np.int64(depth - 1)) != point), old[1] + 1)
        same = np.minimum(np.minimum(old[1] + (query_codes.at(who, np.int64(depth)) != point), old[2] + 1), shorter + 1)
        longer = np.minimum(old[2] + (query_codes.at(who, np.int64(depth + 1)) != point), same + 1)
        row = np.minimum(np.stack([shorter, same, longer]), 2).astype(np.int8)
        alive = row.min(0) <= 1
        who, first, end, row = who[alive], first[alive], end[alive], row[:, alive]
        depth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def shared_prefix(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def half(word_length: int, backwards: bool) -> int:
    """How much of a word is equal in all words one edit away that its order finds.

    Forwards these are the ones equal in the first half of the shorter word; backwards all others,
    whose last half is equal.
    """
    return word_length // 2 if backwards else (word_length - 1) // 2


def own_order(word: str, other: str, backwards: bool) -> bool:
    """Whether this order is the one that reports the pair; each pair has one."""
    middle = min(len(word), len(other)) // 2
    forwards = word[:middle] == other[:middle]
    return forwards != backwards


def best_forms(visits: pa.Table, shard: pa.Table) -> pa.Table:
    """Per visiting word: how many near words the shard has for it, and the commonest of them.

    The commonest comes first in code-point order among equals.
    """
    backwards = bool(visits.column("backwards")[0].as_py()) if len(visits) else False
    listed = sorted(zip(shard.column("key").to_pylist(), shard.column("n").to_pylist(), strict=True))
    keys, numbers = [k for k, _ in listed], [n for _, n in listed]
    queries = visits.column("key").to_pylist()
    if not keys or not queries:
        return BEST.empty_table()
    best: dict[int, tuple[int, int, str]] = {}
    for i, at in zip(*(x.tolist() for x in near_words(keys, queries, [half(len(q), backwards) for q in queries])), strict=True):
        word, other = (queries[i][::-1], keys[at][::-1]) if backwards else (queries[i], keys[at])
        if own_order(word, other, backwards):
            near, n, form = best.get(i, (0, -1, ""))
            better = numbers[at] > n or (numbers[at] == n and other < form)
            best[i] = (near + 1, *((numbers[at], other) if better else (n, form)))
    words = [queries[i][::-1] if backwards else queries[i] for i in best]
    return pa.Table.from_arrays(
        [pa.array(words, pa.string()), *(pa.array([v[k] for v in best.values()], BEST.field(k + 1).type) for k in range(3))], schema=BEST
    )


BEST = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


# ---- all shards ----------------------------------------------------------------


def within_one(shared: str, key: str) -> bool:
    """Whether some prefix of ``key`` is at most one edit from ``shared``."""
    at = shared_prefix(shared, key)
    a, b = shared[at:], key[at:]
    return not a or b.startswith(a[1:]) or b[1:].startswith(a) or b[1:].startswith(a[1:])


def visiting(firsts: dict[bool, list[str]], offsets: dict[bool, list[int]]):
    """(backwards, key, n) to one row per shard that can hold near words of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards = [], []
            for i, (backwards, key) in enumerate(zip(batch.column("backwards").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                starts, numbers = firsts[backwards], offsets[backwards]
                begin = key[: min(half(len(key), backwards), SHOWN)]
                low = max(0, bisect_left(starts, begin) - 1)
                for at in range(low, bisect_right(starts, begin + LAST)):
                    after = starts[at + 1] if at + 1 < len(starts) else ""
                    if within_one(starts[at][: shared_prefix(starts[at], after)], key):
                        rows.append(i)
                        shards.append(numbers[at])
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards, pa.int64())], [*batch.schema.names, "shard"])

    return run


def sharded(words: DataFrame) -> DataFrame:
    """(backwards, key, n, shard): the vocabulary in both orders, cut into shards of a few bytes each.

    No shard has more than ``SHARD_BYTES`` and a word, or a ``SHARDS``-th of the vocabulary.
    """
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    both = [(False, F.col("word")), (True, F.reverse("word"))]
    sides = F.array(*[F.struct(F.lit(back).alias("backwards"), key.alias("key")) for back, key in both])
    laid = laid_out(words.select("n", F.inline(sides)), ["backwards", "key"])
    inside = Window.partitionBy("backwards", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("backwards").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bytes_of = F.octet_length("key").cast("long")
    # One row per sorted partition.
    starts = (
        laid.groupBy("backwards", "_part")
        .agg(F.sum(bytes_of).alias("_bytes"))
        .select("backwards", "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_start") + F.coalesce(F.sum(bytes_of).over(inside), F.lit(0))
    cut = max(SHARD_BYTES, -(-size // SHARDS))
    shard = F.floor(place / cut) * 2 + F.col("backwards").cast("int")
    return laid.join(F.broadcast(starts), ["backwards", "_part"]).select("backwards", "key", "n", shard.cast("long").alias("shard"))


def nearest_forms(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of every word of ``words`` (word, n) that has a near word.

    ``near`` counts the words exactly one insertion, deletion or replacement away, ``best`` is
    the commonest of them, the first in code-point order among equals.
    """
    spark = words.sparkSession
    shards = staged(sharded(words), "word-shards")
    # At most SHARDS rows of bounded size in either order.
    directory = sorted(
        (r["backwards"], r["shard"], r["first"])
        for r in shards.groupBy("backwards", "shard").agg(F.substring(F.min("key"), 1, SHOWN).alias("first")).collect()
    )
    firsts = {side: [f for b, _, f in directory if b == side] for side in (False, True)}
    offsets = {side: [s for b, s, _ in directory if b == side] for side in (False, True)}
    schema = "backwards boolean, key string, n long, shard long"
    visits = staged(shards.select("backwards", "key", "n").mapInArrow(visiting(firsts, offsets), schema), "word-visits")
    sizes = staged(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")), "visit-sizes")
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    blocks = sizes.agg(F.sum("parts")).first()[0] or 1
    # A block is little data and much work: adaptive execution must not put them together.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    asked = visits.join(sizes, "shard").withColumn("part", part).repartition(tasks, "shard", "part")
    copies = sizes.select("shard", F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("copies"))
    held = shards.join(copies, "shard").select("shard", "key", "n", F.explode("copies").alias("copy")).repartition(tasks, "shard", "copy")
    found = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "copy")).applyInArrow(best_forms, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    merged = found.groupBy("word").agg(F.sum("near").alias("near"), top.alias("top"))
    out = staged(merged.select("word", "near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best")), "near-words")
    dropped(visits)
    dropped(shards)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of ``links`` (word, form): the last word that forms lead to.

    Each round doubles the steps that are known. Forms lead to commoner words only, so there
    is no circle and rounds are few.
    """
    now = staged(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while now.filter("moved").head(1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.drop("moved").join(ahead, "root", "left")
        moved = F.col("further").isNotNull()
        after = staged(step.select("word", F.coalesce("further", "root").alias("root"), moved.alias("moved")), "forms")
        dropped(now)
        now = after
    return now.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words`` (word, n).

    ``form`` is the commonest near word if it is at least ``times`` as common, else null; ``root``
    the last word that forms lead to, the word itself without a form. An empty vocabulary gives
    no rows.
    """
    words = staged(words, "vocabulary")
    near = nearest_forms(words)
    rated = words.join(near, "word", "left").withColumn("formed", F.col("best_n") >= times * F.col("n"))
    formed = rated.select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("formed"), F.col("best")).alias("form"), F.when(F.col("formed"), F.col("best_n")).alias("form_n"),
    )
    formed = staged(formed, "formed")
    led = roots(formed.filter("form IS NOT NULL"))
    return formed.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))
