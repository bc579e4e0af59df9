"""Vantage-point trees, one per shard, for the largest inner product.

Inner products become distances by one more component that gives all vectors the same
length: the nearest of the lengthened vectors has the largest inner product. A node takes a
few vantage points out of its points and splits the rest by their distance to the first one,
the nearer half inside, the other outside; both sides keep the range of those distances, and
every point keeps its distances to all vantage points above it. By the triangle inequality
the largest difference between those and the query's own distances is a lower bound. A side
or a point whose bound exceeds the best so far is not scored. ``factor`` multiplies the
bound: one is exact, more skips more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.llm.topk import parallelism
from stallwise.llm.vectors import QUERY_ROWS, best, blocks, count_of, finite, numbers, objects, pairs, ranked

LEAF = 64
VANTAGES = 4  # vantage points of a node
SHARD_ROWS = 16_384
SLACK = 1e-9
ROUNDING = 1e-5  # more than single precision takes from a distance between vectors of length one
NODE = np.dtype([("start", "i8"), ("end", "i8"), ("inside", "i8"), ("outside", "i8"), ("near", "f8", 2), ("far", "f8", 2)])
INDEX = "block int, block_objs binary, block_data binary, nodes binary, paths binary"
FOUND = "qobj long, objs binary, scores binary"


def distances(points: np.ndarray, norms: np.ndarray, other: np.ndarray, other_norm) -> np.ndarray:
    return np.sqrt(np.maximum(norms + other_norm - 2 * (points @ other), 0.0))


def lengthened(data: np.ndarray, longest: float) -> np.ndarray:
    """``data`` with a component more, so that every row has the length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (data**2).sum(1), 0.0))
    return np.concatenate([data, rest[:, None]], 1)


def grown(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the points, the nodes of their tree, and the distances of each to its vantage points.

    Leaves hold LEAF points at most. A node's range begins with its vantage points: the one
    farthest from the first point, then always the one farthest from those taken. Halves are
    cut by rank, so equal distances do no harm.
    """
    order, nodes = np.arange(len(points)), []
    columns: list[np.ndarray] = []

    def grow(start: int, end: int, depth: int) -> int:
        number = len(nodes)
        nodes.append((start, end, -1, -1, (0, 0), (0, 0)))
        if end - start <= LEAF:
            return number
        mine = order[start:end]
        farthest = ((points[mine] - points[mine[0]]) ** 2).sum(1)
        taken, away = [], []
        for _ in range(VANTAGES):
            taken.append(int(np.argmax(farthest)))
            away.append(np.sqrt(((points[mine] - points[mine[taken[-1]]]) ** 2).sum(1)))
            farthest = np.minimum(away[-1], farthest) if len(taken) > 1 else away[-1].copy()
            farthest[taken] = -1
        while len(columns) < (depth + 1) * VANTAGES:
            columns.append(np.zeros(len(points), np.float32))
        for i, d in enumerate(away):
            columns[depth * VANTAGES + i][mine] = d
        rest = np.ones(len(mine), bool)
        rest[taken] = False
        by = np.flatnonzero(rest)
        by = by[np.argsort(away[0][by], kind="stable")]
        order[start:end] = np.concatenate([mine[taken], mine[by]])
        d, first = away[0][by], start + VANTAGES
        half = len(by) // 2
        inside, outside = grow(first, first + half, depth + 1), grow(first + half, end, depth + 1)
        nodes[number] = (start, end, inside, outside, (d[0], d[half - 1]), (d[half], d[-1]))
        return number

    grow(0, len(points), 0)
    paths = np.stack(columns, 1)[order] if columns else np.zeros((len(points), 0), np.float32)
    return order, np.array(nodes, NODE), paths


def indexing(longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                objs, data = numbers(row["block_objs"], row["block_data"])
                order, nodes, paths = grown(lengthened(data, longest))
                names = ["block", "block_objs", "block_data", "nodes", "paths"]
                values = [row["block"], *(x.tobytes() for x in (objs[order], data[order], nodes, paths))]
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return run


class Search:
    """The nearest points of one tree for a block of queries, found together.

    ``scored`` counts the pairs of a query and a point whose inner product was taken.
    """

    def __init__(self, data: np.ndarray, nodes: np.ndarray, paths: np.ndarray, longest: float, wanted: np.ndarray, keep: int, factor: float):
        self.data, self.nodes, self.paths, self.wanted, self.keep, self.factor = data, nodes, paths, wanted, keep, factor
        self.shift = (wanted**2).sum(1) + longest**2
        self.rounding = ROUNDING * float(np.sqrt(self.shift.max(initial=0.0)))
        self.scores = np.full((len(wanted), keep), -np.inf)
        self.at = np.full((len(wanted), keep), -1, np.int64)
        self.scored = 0
        self.home = np.full(len(wanted), -1, np.int64)  # where the leaf begins that a query itself falls into
        # First every query goes down to its own leaf alone, so that the others can be skipped by what it finds.
        for down in (True, False):
            self.visit(0, np.arange(len(wanted)), np.zeros((len(wanted), 0), np.float32), down)

    def reach(self, asked: np.ndarray) -> np.ndarray:
        """The distance within which a point would be among the best so far."""
        worst = self.scores[asked].min(1)
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(self.shift[asked] - 2 * worst, 0.0)))

    def visit(self, number: int, asked: np.ndarray, away: np.ndarray, down: bool) -> None:
        """``away``: distances of the queries ``asked`` to the vantage points above the node."""
        node = self.nodes[number]
        if not len(asked):
            return
        start, end = int(node["start"]), int(node["end"])
        new = (self.home[asked] < start) | (self.home[asked] >= end)
        if node["inside"] < 0:
            if down:
                self.home[asked] = start
            self.scan(start, end, asked[new], away[new])
            return
        scores = self.wanted[asked] @ self.data[start : start + VANTAGES].T
        self.scored += int(new.sum()) * VANTAGES
        self.offer(asked[new], scores[new], start)
        all_d = np.sqrt(np.maximum(self.shift[asked, None] - 2 * scores, 0.0))
        away = np.concatenate([away, all_d.astype(np.float32)], 1)
        d = all_d[:, 0]
        nearer = d <= (node["near"][1] + node["far"][0]) / 2
        for side, (low, high), own in ((int(node["inside"]), node["near"], nearer), (int(node["outside"]), node["far"], ~nearer)):
            if down:
                go = own
            else:
                gap = np.maximum(np.maximum(low - d, d - high), 0.0)
                go = gap * self.factor <= self.reach(asked) + SLACK
            self.visit(side, asked[go], away[go], down)

    def scan(self, start: int, end: int, asked: np.ndarray, away: np.ndarray) -> None:
        """Scores the points of a leaf whose lower bound lets them be among the best."""
        bound = np.zeros((end - start, len(asked)), np.float32)
        gap = np.empty_like(bound)
        for own, points in zip(np.ascontiguousarray(away.T), self.paths[start:end].T[: away.shape[1]], strict=True):
            np.subtract(points[:, None], own, out=gap)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
        limit = self.reach(asked) / self.factor + self.rounding
        wanted, scores = self.wanted[asked], np.full((len(asked), end - start), -np.inf)
        for p, near in enumerate(bound <= limit.astype(np.float32)):
            q = np.flatnonzero(near)
            scores[q, p] = wanted[q] @ self.data[start + p]
            self.scored += len(q)
        self.offer(asked, scores, start)

    def offer(self, asked: np.ndarray, scores: np.ndarray, start: int) -> None:
        """Takes ``scores`` of the points from ``start`` on into the lists of the best."""
        some = scores.max(1, initial=-np.inf) > self.scores[asked].min(1) - SLACK
        asked, scores = asked[some], scores[some]
        if not len(asked):
            return
        places = np.where(np.isinf(scores), -1, np.arange(start, start + scores.shape[1]))
        scores = np.concatenate([self.scores[asked], scores], 1)
        at = np.concatenate([self.at[asked], places], 1)
        top = np.argpartition(scores, scores.shape[1] - self.keep, axis=1)[:, -self.keep :]
        self.scores[asked] = np.take_along_axis(scores, top, 1)
        self.at[asked] = np.take_along_axis(at, top, 1)


def exact_scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the same order wherever a point lies."""
    return (points * query).sum(1)


def searching(longest: float, keep: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                objs, data = numbers(row["block_objs"], row["block_data"])
                nodes = np.frombuffer(row["nodes"], NODE)
                paths = np.frombuffer(row["paths"], np.float32).reshape(len(objs), -1)
                asked, wanted = numbers(row["query_objs"], row["query_data"])
                # A few more than asked for: near ties are settled by the exact scores.
                found = Search(data, nodes, paths, longest, wanted, keep + 4, factor)
                out = []
                for i, q in enumerate(asked):
                    at = found.at[i][found.at[i] >= 0]
                    scores = exact_scores(data[at], wanted[i])
                    top = best(scores, objs[at], keep)
                    out.append((int(q), objs[at][top].tobytes(), scores[top].tobytes()))
                columns = list(zip(*out, strict=True)) or [()] * 3
                kinds = [pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["qobj", "objs", "scores"])

    return run


def best_of(keep: int):
    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        objs = np.concatenate([np.frombuffer(x, np.int64) for x in lists["objs"]])
        scores = np.concatenate([np.frombuffer(x, np.float64) for x in lists["scores"]])
        top = best(scores, objs, keep)
        return pd.DataFrame({"qobj": key[0], "obj": objs[top], "score": scores[top]})

    return run


def index(objs: DataFrame, count: int) -> tuple[DataFrame, float]:
    """The trees of all shards over ``objs`` (obj, vector), and the greatest length."""
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    longest = float(np.sqrt(objs.agg(F.max(squares)).first()[0] or 0.0)) * (1 + 1e-12)
    packed = blocks(objs, count, SHARD_ROWS, "block")
    return staged(packed.mapInArrow(indexing(longest), INDEX), "trees"), longest


def nearest(vectors: DataFrame, is_query, keep: int, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``keep`` largest inner products found per query.

    ``vectors`` has id and vector; rows for which ``is_query`` holds are queries, every row
    but the query's own is a candidate, and every row is in the index. Scores are the double
    inner products of the vectors as given. Ties go to the smaller id. Vectors that are null,
    zero or hold a null or non-finite component take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    wide = F.transform("vector", lambda x: x.cast("double"))
    good = vectors.filter(finite(F.col("vector"))).select("id", wide.alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    objs = staged(objects(good, keep + 1), "objects")
    asked = good.filter(is_query).select(F.col("id").alias("query_id"), "vector")
    asked = staged(asked.join(objs.select("obj", "vector"), "vector").select(F.col("obj").alias("qobj"), "query_id").distinct(), "asked")
    n, n_asked = objs.count(), asked.select("qobj").distinct().count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees, longest = index(objs.select("obj", "vector"), n)
    ask = objs.join(asked.select(F.col("qobj").alias("obj")).distinct(), "obj")
    right = staged(blocks(ask, n_asked, QUERY_ROWS, "query"), "query-blocks")
    both = pairs(trees, right, count_of(n, SHARD_ROWS), parallelism(spark))
    lists = both.mapInArrow(searching(longest, keep + 1, factor), FOUND)
    found = lists.groupBy("qobj").applyInPandas(best_of(keep + 1), "qobj long, obj long, score double")
    return ranked(found, objs, asked, keep)
