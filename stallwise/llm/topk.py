"""Exact top-k by a three-phase uniform threshold.

The components of the vectors are cut into parts, and every (part, block of objects) is a
node that knows only its own partial scores. Phase one gathers each node's best local scores
of a query and has the objects on these lists added up; the k-th best sum is a lower bound.
Phase two sends the bound, divided by the number of parts, to all nodes, and each returns
every object whose partial score reaches it: an object that no node returns cannot be among
the best. Phase three drops objects whose upper bound is too low and asks the nodes for what
is missing of the others. Partial scores are shifted by their least value per query, so that
an unknown part is at least zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.llm.vectors import BLOCK_ROWS, QUERY_ROWS, best, block_of, blocks, count_of, finite, numbers, objects, pairs, ranked
from stallwise.operators.joins import join_shuffled

CHUNK = 128
LISTS = "qobj long, part int, block int, least double, objs binary, scores binary"


def scaled(vector, factor: int):
    """Integer components floor(factor * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
    names = ["qobj", "part", "block", "least", "objs", "scores"]
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def node_lists(parts: int, keep: int | None):
    """Phases one and two: a node's best ``keep`` scores, or all that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                objs, data = numbers(row["block_objs"], row["block_data"])
                asked, wanted = numbers(row["query_objs"], row["query_data"])
                if keep is None:
                    cutoffs = np.frombuffer(row["cutoffs"], np.float64).reshape(len(asked), parts)
                for part in range(parts):
                    mine = slice(part * data.shape[1] // parts, (part + 1) * data.shape[1] // parts)
                    there = np.ascontiguousarray(data[:, mine]).T
                    out = []
                    for at in range(0, len(asked), CHUNK):
                        scores = wanted[at : at + CHUNK, mine] @ there
                        least = scores.min(1)
                        for i, line in enumerate(scores):
                            if keep is None:
                                chosen = np.flatnonzero(line >= cutoffs[at + i, part])
                            elif len(objs) > keep:
                                chosen = np.argpartition(line, len(objs) - keep)[-keep:]
                            else:
                                chosen = np.arange(len(objs))
                            if len(chosen):
                                out.append((int(asked[at + i]), part, row["block"], least[i], objs[chosen].tobytes(), line[chosen].tobytes()))
                    yield _rows(out)

    return run


def node_answers(parts: int):
    """Phase three: exact scores of the objects that are asked for (qobj, block, objs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                objs, data = numbers(row["block_objs"], row["block_data"])
                order = np.argsort(objs)
                asked, wanted = numbers(row["query_objs"], row["query_data"])
                place = {int(q): i for i, q in enumerate(asked)}
                out = []
                for need in row["needs"] or ():
                    named = np.frombuffer(need["objs"], np.int64)
                    at = order[np.searchsorted(objs[order], named)]
                    scores = data[at] @ wanted[place[need["qobj"]]]
                    out.append((need["qobj"], 0, row["block"], 0.0, need["objs"], scores.tobytes()))
                yield _rows(out)

    return run


def cutoff_of(parts: int, keep: int):
    """The cutoffs of a query from whole scores (some twice) and the least scores per part."""

    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        objs = np.concatenate([np.frombuffer(x, np.int64) for x in lists["objs"]])
        scores = np.concatenate([np.frombuffer(x, np.float64) for x in lists["scores"]])
        scores = np.sort(scores[np.unique(objs, return_index=True)[1]])
        shifts = np.array(lists["shifts"].iloc[0], float)
        bound = scores[-keep] - shifts.sum() if len(scores) >= keep else 0.0
        return pd.DataFrame({"qobj": [key[0]], "cutoff": [(np.floor(bound / parts) + shifts).tobytes()]})

    return run


def needs_of(parts: int, keep: int):
    """The objects of a query that can still be among the best, by block."""

    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        cutoffs = np.frombuffer(lists["cutoff"].iloc[0], np.float64)
        found = [np.frombuffer(x, np.int64) for x in lists["objs"]]
        objs, place = np.unique(np.concatenate(found), return_inverse=True)
        # Scores relative to the cutoff: an unknown part lies below zero.
        table = np.full((len(objs), parts), np.nan)
        where = np.zeros(len(objs), np.int32)
        seen = 0
        for ids, part, block, scores in zip(found, lists["part"], lists["block"], lists["scores"], strict=True):
            mine = place[seen : seen + len(ids)]
            table[mine, part] = np.frombuffer(scores, np.float64) - cutoffs[part]
            where[mine] = block
            seen += len(ids)
        upper = np.nansum(table, 1)
        sums = np.sort(upper[~np.isnan(table).any(1)])
        left = upper >= (sums[-keep] if len(sums) >= keep else -np.inf)
        order = np.argsort(where[left], kind="stable")
        blocks_, first = np.unique(where[left][order], return_index=True)
        groups = np.split(objs[left][order], first[1:])
        return pd.DataFrame({"qobj": key[0], "block": blocks_.astype(np.int32), "objs": [g.tobytes() for g in groups]})

    return run


def best_of(keep: int):
    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        objs = np.concatenate([np.frombuffer(x, np.int64) for x in lists["objs"]])
        scores = np.concatenate([np.frombuffer(x, np.float64) for x in lists["scores"]])
        top = best(scores, objs, keep)
        return pd.DataFrame({"qobj": key[0], "obj": objs[top], "score": scores[top].astype(np.int64)})

    return run


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exact_top(vectors: DataFrame, is_query, keep: int, factor: int = 64, parts: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``keep`` highest integer inner products per query.

    ``vectors`` has id and vector; rows for which ``is_query`` holds are queries, and every
    row but the query's own is a candidate. Ties go to the smaller id. Vectors that are null
    or hold a null or non-finite component take no part; an empty table gives no rows. Scores
    are exact as long as they stay below 2**53.
    """
    spark = vectors.sparkSession
    good = vectors.filter(finite(F.col("vector"))).select("id", scaled(F.col("vector"), factor).alias("vector"))
    objs = staged(objects(good, keep + 1), "objects")
    asked = good.filter(is_query).select(F.col("id").alias("query_id"), "vector")
    of_query = join_shuffled(asked, objs.select("obj", "vector"), ["vector"])
    asked = staged(of_query.select(F.col("obj").alias("qobj"), "query_id").distinct(), "asked")
    n, n_asked = objs.count(), asked.select("qobj").distinct().count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = count_of(n, BLOCK_ROWS)
    left = staged(blocks(objs, n, BLOCK_ROWS, "block"), "blocks")
    ask = join_shuffled(objs, asked.select(F.col("qobj").alias("obj")).distinct(), ["obj"])
    right = staged(blocks(ask, n_asked, QUERY_ROWS, "query"), "query-blocks")
    by_query = block_of(F.col("qobj"), n_asked, QUERY_ROWS).alias("query")
    most = parallelism(spark)

    def answers(needs: DataFrame) -> DataFrame:
        asking = needs.groupBy("block", by_query).agg(F.collect_list(F.struct("qobj", "objs")).alias("needs"))
        return pairs(left, right, n_blocks, most, asking).mapInArrow(node_answers(parts), LISTS)

    first = staged(pairs(left, right, n_blocks, most).mapInArrow(node_lists(parts, keep + 1), LISTS), "local-lists")
    least = first.groupBy("qobj", "part").agg(F.min("least").alias("least"))
    shifts = least.groupBy("qobj").agg(F.sort_array(F.collect_list(F.struct("part", "least"))).alias("by_part"))
    known = join_shuffled(
        answers(first.select("qobj", "block", "objs")), shifts.select("qobj", F.col("by_part.least").alias("shifts")), ["qobj"]
    )
    cutoffs = staged(known.groupBy("qobj").applyInPandas(cutoff_of(parts, keep + 1), "qobj long, cutoff binary"), "cutoffs")

    named = cutoffs.groupBy(by_query).agg(F.map_from_entries(F.collect_list(F.struct("qobj", "cutoff"))).alias("known"))
    sent = join_shuffled(right, named, ["query"]).mapInArrow(with_cutoffs, "query int, query_objs binary, query_data binary, cutoffs binary")
    second = join_shuffled(pairs(left, sent, n_blocks, most).mapInArrow(node_lists(parts, None), LISTS), cutoffs, ["qobj"])
    needs = second.groupBy("qobj").applyInPandas(needs_of(parts, keep + 1), "qobj long, block int, objs binary")
    found = answers(needs).groupBy("qobj").applyInPandas(best_of(keep + 1), "qobj long, obj long, score long")
    return ranked(found, objs, asked, keep)


def with_cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the cutoffs of a query block's queries in the block's order."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            known = dict(row["known"])
            out.append(b"".join(known[int(q)] for q in np.frombuffer(row["query_objs"], np.int64)))
        columns = [batch.column(n) for n in ("query", "query_objs", "query_data")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["query", "query_objs", "query_data", "cutoffs"])
