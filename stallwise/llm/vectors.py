"""Vectors as objects, blocks and query blocks: what the two searches share.

Equal vectors are one object with the smallest ids that a result can need, so copies cost
nothing. Objects lie in blocks of bounded size by hash; a set of queries meets all objects
block by block, and the rows that travel are blocks of numbers, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.operators.joins import join_shuffled

BLOCK_ROWS = 8192
QUERY_ROWS = 1024


def finite(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def objects(vectors: DataFrame, keep: int) -> DataFrame:
    """(obj, ids, vector): each distinct vector with its ``keep`` smallest ids.

    ``vectors`` has id and vector. Rows without an id take no part; of rows with an equal id
    the smallest vector counts. Shorter vectors are filled up with zeros. ``obj`` is the
    smallest id.
    """
    once = vectors.filter("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    zero = F.lit(0).cast(dict(vectors.dtypes)["vector"].removeprefix("array<").removesuffix(">"))
    width = once.agg(F.max(F.size("vector"))).first()[0] or 0
    once = once.withColumn("vector", F.concat("vector", F.array_repeat(zero, F.lit(width) - F.size("vector"))))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = once.withColumn("nth", nth).filter(F.col("nth") <= keep)
    return first.groupBy("vector").agg(F.min("id").alias("obj"), F.sort_array(F.collect_list("id")).alias("ids")).select("obj", "ids", "vector")


def block_of(key: Column, rows: int, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count_of(rows, size))).cast("int")


def packing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, list of (obj, vector)) to (block, objs, data): the numbers as bytes."""
    for batch in batches:
        out = []
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            flat = rows.values
            objs = flat.field("obj").to_numpy()
            data = flat.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out.append((block, objs.tobytes(), data.tobytes()))
        blocks, objs, data = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(objs, pa.binary()), pa.array(data, pa.binary())], ["block", "objs", "data"])


def blocks(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """(name, objs, data): ``rows`` (obj, vector) in blocks of about ``size``."""
    grouped = rows.groupBy(block_of(F.col("obj"), count, size).alias("block")).agg(F.collect_list(F.struct("obj", "vector")).alias("rows"))
    packed = grouped.mapInArrow(packing_rows, "block int, objs binary, data binary")
    return packed.withColumnsRenamed({"block": name, "objs": f"{name}_objs", "data": f"{name}_data"})


def numbers(objs: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(objs, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), len(data) // 8 // max(1, len(ids)))


def count_of(rows: int, size: int) -> int:
    """How many blocks ``rows`` make."""
    return max(1, -(-rows // size))


def pairs(left: DataFrame, right: DataFrame, n_left: int, parallel: int, asking: DataFrame | None = None) -> DataFrame:
    """Every block of ``left`` beside every query block of ``right``; one row per two blocks.

    The query blocks, the smaller ones, go to each of the ``n_left`` blocks; a block itself
    travels once. Tasks grow in number with the blocks. ``asking`` keeps the pairs of (block,
    query) that it has, and adds its columns. The copies of the query blocks pass for a table as
    small as their file, so these joins are shuffled; a task holds one block while they pass by.
    """
    spread = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    if asking is not None:
        spread = join_shuffled(spread, asking, ["block", "query"])
    tasks = max(parallel, n_left)
    return join_shuffled(spread.repartition(tasks, "block"), left.repartition(tasks, "block"), ["block"])


def best(scores: np.ndarray, objs: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best: higher score first, then smaller object."""
    return np.lexsort((objs, -scores))[:keep]


def ranked(found: DataFrame, objs: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) from the best objects of each query object.

    ``found`` (qobj, obj, score) has ``keep`` + 1 objects at most per query object, ``asked``
    (qobj, query_id) the queries. Every object gives at most ``keep`` + 1 ids.
    """
    rows = join_shuffled(found, objs.select("obj", F.explode("ids").alias("vec_id")), ["obj"])
    nth = F.row_number().over(Window.partitionBy("qobj").orderBy(F.desc("score"), "vec_id"))
    few = staged(rows.withColumn("nth", nth).filter(F.col("nth") <= keep + 1).select("qobj", "vec_id", "score"), "nearest")
    own = join_shuffled(asked, few, ["qobj"]).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= keep).select("query_id", "rank", "vec_id", "score")
