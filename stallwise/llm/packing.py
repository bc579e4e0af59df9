"""Shortest-pack-first packing over the length histogram.

Texts become token ids, ids are cut into pieces of at most a sequence, and only the histogram
of piece lengths (at most one entry per length) reaches the driver. There, lengths are placed
longest first into the emptiest open pattern; a pattern stands for many equal sequences. The
patterns are joined back to the pieces by rank within their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import cells_for, numbered, staged
from stallwise.llm.tokens import ByteTokens

PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packs: longest length first, always into the emptiest pack.

    Packs with equal content are one entry with a count, so the work depends on the number of
    different lengths and not on the number of pieces.
    """
    open_packs: list[tuple[int, int, int, list[int]]] = []  # (-space, order, count, lengths)
    done: list[tuple[int, list[int]]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        again = []
        while left and open_packs and -open_packs[0][0] >= length:
            space, _, count, lengths = heapq.heappop(open_packs)
            used = min(count, left)
            left -= used
            if used < count:
                order += 1
                heapq.heappush(open_packs, (space, order, count - used, lengths))
            rest = -space - length
            order += 1
            if rest:
                heapq.heappush(open_packs, (-rest, order, used, [*lengths, length]))
            else:
                done.append((used, [*lengths, length]))
        if left:
            # What is left opens packs; equal pieces fill a new pack as far as they go.
            per = size // length
            for held, count in ((per, left // per), (left % per, 1)):
                if held and count:
                    order += 1
                    rest = size - held * length
                    if rest:
                        again.append((-rest, order, count, [length] * held))
                    else:
                        done.append((count, [length] * held))
        for pack in again:
            heapq.heappush(open_packs, pack)
    return done + [(count, lengths) for _, _, count, lengths in open_packs]


def spans(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): which pieces go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            used[length] = first + count
            out.append((length, first, first + count - 1, sequence, offset))
            offset += length
        sequence += count
    return out


def piece_maker(size: int, end: int, make: Callable[[], ByteTokens]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = make().encode, end.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = encode(text or "") + last
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc, row, start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def pieces_of(docs: DataFrame, size: int, end: int, make: Callable[[], ByteTokens]) -> DataFrame:
    """One row per piece: whole sequences from the front, then the rest."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(piece_maker(size, end, make), PIECES)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Needs the columns row, start and length with 1 <= length <= size; (row, start) must be
    distinct. All pieces are packed, an empty table gives an empty one.
    """
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    packs = patterns({x["length"]: x["n"] for x in counted}, size)
    where = pieces.sparkSession.createDataFrame(spans(packs), "length long, lo long, hi long, first long, offset long")
    most = max((x["n"] for x in counted), default=0)
    cell = F.pmod(F.xxhash64("row", "start"), F.lit(cells_for(most, 1)))
    ranked = numbered(pieces, ["length"], cell, [F.col("row"), F.col("start")], "rank")
    # At most a few thousand spans: their number is bounded by the number of lengths.
    inside = (F.col("p.length") == F.col("s.length")) & F.col("rank").between(F.col("lo"), F.col("hi"))
    return (
        ranked.alias("p")
        .join(F.broadcast(where).alias("s"), inside)
        .select("p.*", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
        .drop("rank")
    )


def pack_documents(docs: DataFrame, size: int, end: int, make: Callable[[], ByteTokens]) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens.

    A null or empty text is the end token alone. A very long text is many pieces. Repeated
    rows are packed each; columns other than doc_id and text are ignored.
    """
    return pack(staged(pieces_of(docs, size, end, make), "pieces"), size).drop("row")
