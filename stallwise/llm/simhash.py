"""SimHash fingerprints linked by meet-in-the-middle balls.

Two fingerprints within twice a radius have a common variant within the radius of both. So
every distinct fingerprint emits its variants, variants are shuffled, and all fingerprints
that meet at a variant are tied to the smallest of them: a variant's ball holds at most 65
fingerprints, and copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.llm.components import components

BITS = 64
SEED = 42
# A byte's bits, each in a byte of its own: eight counters in one number.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
BLOCK = 255 * 256


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit set."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        lanes = LANES[part.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash over the word shingles of ``text``; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        found = [b" ".join(words)]
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in found], np.uint64)
    bits = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def marking(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            keys = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(marks, pa.int64())], [*keys, "mark"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with ``mark`` in place of ``text``."""
    keys = [f"`{c}` {kind}" for c, kind in docs.dtypes if c != "text"]
    return docs.mapInArrow(marking(shingle), ", ".join([*keys, "mark long"]))


def variants(mark: Column) -> Column:
    """``mark`` itself and with each single bit changed."""
    return F.explode(F.array(mark, *[mark.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(BITS)]))


def links(marks: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct marks at most two bits apart, enough to connect them all.

    Every mark of a variant's ball is tied to the ball's smallest one; both are within one bit
    of the variant. The distance is verified all the same.
    """
    spread = marks.select(F.col("mark").alias("a"), variants(F.col("mark")).alias("variant"))
    met = spread.withColumn("b", F.min("a").over(Window.partitionBy("variant"))).filter("a != b")
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")


def rooted(marks: DataFrame) -> DataFrame:
    """(mark, root) of distinct ``mark``: the same root for all marks reachable over steps of two bits."""
    found = components(links(marks))
    return marks.join(found, marks["mark"] == found["node"], "left").select("mark", F.coalesce("component", "mark").alias("root"))


def linked(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, mark, component_id): the smallest doc_id reachable over marks two bits apart.

    One row per row of ``docs``. Texts without words, null ones too, have mark zero and are
    linked like any other. A null doc_id never is the smallest.
    """
    marked = staged(fingerprints(docs.select("doc_id", "text"), shingle), "marks")
    marks = staged(marked.groupBy("mark").agg(F.min("doc_id").alias("first")), "distinct-marks")
    roots = staged(marks.join(rooted(marks.select("mark")), "mark"), "roots")
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(roots.join(ids, "root").select("mark", "component_id"), "mark")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group of texts linked over marks two bits apart.

    It is the row of the smallest doc_id, ids before null; of several rows with that id, the one
    whose columns have the smallest hash, so equal rows count once. Texts without words, null
    ones too, are one group. Only ids, hashes and marks are grouped; whole rows travel once.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    hashed = docs.select("doc_id", row.alias("row"), "text")
    marked = staged(fingerprints(hashed, shingle), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    marks = staged(marked.groupBy("mark").agg(first), "distinct-marks")
    kept = marks.join(rooted(marks.select("mark")), "mark").groupBy("root").agg(F.min("first").alias("first"))
    out = docs.withColumn("_row", row).join(kept.select(F.col("first.row").alias("_row")), "_row", "left_semi")
    return out.dropDuplicates(["_row"]).drop("_row")
