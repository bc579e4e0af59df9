"""Sums per lane, node, feature and bin over the rows of one task.

Spark deals out the rows and adds up what its tasks found; a task holds a slab of rows as arrays
and goes over it lane by lane. These functions are shipped to the executors by value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A slab ends at so many rows, or bytes of Arrow data; so many cells go into one batch.
SLAB_ROWS = 1 << 17
SLAB_BYTES = 64 << 20
BATCH_CELLS = 200_000

Slab = dict[str, np.ndarray]
# The rows of a slab that count in a lane, the whole numbers each adds to the sums, and, where
# every row adds its one number to one of the sums only, which of them.
Adds = Callable[[Slab, int], tuple[np.ndarray, list[np.ndarray], np.ndarray | None]]


# ---- what a row adds -------------------------------------------------------------


@dataclass
class Lanes:
    """Lanes of ``width`` to a run; ``folds`` is 0 where there is only the fit to all rows."""

    folds: int
    width: int

    def rows(self, slab: Slab, lane: int, times: np.ndarray | None = None) -> np.ndarray:
        """The rows that a lane's run trains on, drawn at least once."""
        run = lane // self.width
        counts = np.ones(len(slab["bins"]), bool) if times is None else times > 0
        if run:
            counts &= slab["folds"][:, (run - 1) // self.folds] != (run - 1) % self.folds
        return np.flatnonzero(counts)

    def drawn(self, slab: Slab, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a lane and how often each is drawn; a run's first tree takes every row once."""
        tree = lane % self.width
        times = slab["draws"][:, (tree - 1) % slab["draws"].shape[1]] if tree else np.ones(len(slab["bins"]), np.int64)
        rows = self.rows(slab, lane, times)
        return rows, times[rows].astype(np.float64)


def class_counts(lanes: Lanes) -> Adds:
    """How often a row is drawn, for its class ``y``."""

    def adds(slab: Slab, lane: int):
        rows, times = lanes.drawn(slab, lane)
        return rows, [times], slab["y"][rows]

    return adds


def count_and_sum(lanes: Lanes) -> Adds:
    """How often a row is drawn, and its ``units`` as often."""

    def adds(slab: Slab, lane: int):
        rows, times = lanes.drawn(slab, lane)
        return rows, [times, times * slab["units"][rows]], None

    return adds


def whole(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    down = np.trunc(x)
    return down + np.sign(x) * (np.abs(x - down) >= 0.5)


def what_is_left(lanes: Lanes, unit: int) -> Adds:
    """One, the residual and the curvature of a lane's class, from the ``chances`` of all lanes."""

    def adds(slab: Slab, lane: int):
        rows = lanes.rows(slab, lane)
        chance = slab["chances"][rows, lane]
        mine = (slab["y"][rows] == lane % lanes.width).astype(np.float64)
        return rows, [np.ones(len(rows)), whole(unit * (mine - chance)), whole(unit * chance * (1 - chance))], None

    return adds


def given(n: int) -> Adds:
    """Columns ``s0``, ``s1``, ... with one number a lane, where ``counted``."""

    def adds(slab: Slab, lane: int):
        rows = np.flatnonzero(slab["counted"][:, lane])
        return rows, [slab[f"s{i}"][rows, lane].astype(np.float64) for i in range(n)], None

    return adds


# ---- slabs -----------------------------------------------------------------------


def as_array(column: pa.Array) -> np.ndarray:
    """A column of numbers as a vector, of arrays of equal length as a matrix."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slab_of(batches: Sequence[pa.RecordBatch]) -> Slab:
    return {name: as_array(pa.concat_arrays([b.column(name) for b in batches])) for name in batches[0].schema.names}


def slabs(batches: Iterable[pa.RecordBatch]) -> Iterator[Slab]:
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= SLAB_ROWS or size >= SLAB_BYTES:
            yield slab_of(held)
            held, rows, size = [], 0, 0
    if held:
        yield slab_of(held)


# ---- trees -----------------------------------------------------------------------


def nodes_of(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """The nodes that rows are at after so many splits of one tree."""
    flat, start = bins.reshape(-1), rows * bins.shape[1]
    at = np.ones(len(rows), np.int64)
    for _ in range(steps):
        split = feature[at]
        at = np.where(split < 0, at, 2 * at + (flat[start + np.maximum(split, 0)] > cut[at]))
    return at


def lane_sums(bins: np.ndarray, rows: np.ndarray, local: np.ndarray, nodes: int, width: int, values, slot, sums: int, chosen) -> np.ndarray:
    """Sums by (node, feature, bin, sum) of the rows of a lane; ``bins`` has a row per feature, from 0.

    ``chosen`` has the features that each node looks at; without it all nodes look at all.
    """
    features = len(bins)
    size = nodes * width
    out = np.zeros((features, size, sums))
    own = local * width
    flat = bins.reshape(-1)
    for j in range(features if chosen is None else chosen.shape[1]):
        # Without ``chosen`` the cells of feature j, else those of all features.
        if chosen is None:
            cell, into = own + bins[j][rows], out[j]
        else:
            feature = chosen[local, j]
            cell, into = feature * size + own + flat[feature * bins.shape[1] + rows], out.reshape(-1, sums)
        if slot is not None:
            into += np.bincount(cell * sums + slot, values[0], into.size).reshape(into.shape)
        else:
            for i, value in enumerate(values):
                into[:, i] += np.bincount(cell, value, len(into))
    return out.reshape(features, nodes, width, sums).transpose(1, 0, 2, 3)


def cells(lanes: int, level: int, feature: np.ndarray, cut: np.ndarray, sums: int, adds: Adds, chosen: dict[int, np.ndarray]):
    """For mapInArrow: (lane, node, feature, bin, s0, s1, ...) of one level of every lane's tree."""
    first = 1 << level

    def found(slab: Slab) -> Iterator[np.ndarray]:
        lowest = int(slab["bins"].min(initial=0))
        bins = np.ascontiguousarray((slab["bins"].T - lowest).astype(np.int64))
        width = int(bins.max(initial=0)) + 1
        for lane in range(lanes):
            rows, values, slot = adds(slab, lane)
            local = nodes_of(slab["bins"], rows, feature[lane], cut[lane], level) - first
            here = local >= 0
            if not here.all():
                rows, local, values = rows[here], local[here], [v[here] for v in values]
                slot = None if slot is None else slot[here]
            if not len(rows):
                continue
            few = chosen[lane][first : 2 * first] if lane in chosen else None
            total = lane_sums(bins, rows, local, first, width, values, slot, sums, few)
            node, f, b = np.nonzero(total.any(axis=3))
            key = np.stack([np.full(len(node), lane), node + first, f, b + lowest], 1)
            yield np.concatenate([key, total[node, f, b].astype(np.int64)], 1)

    names = ["lane", "node", "feature", "bin", *[f"s{i}" for i in range(sums)]]

    def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole_part = np.concatenate(parts)
        return pa.record_batch([pa.array(c, pa.int32() if i < 4 else pa.int64()) for i, c in enumerate(whole_part.T.copy())], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for slab in slabs(batches):
            for part in found(slab):
                parts.append(part)
                n += len(part)
                if n >= BATCH_CELLS:
                    yield batch(parts)
                    parts, n = [], 0
        if parts:
            yield batch(parts)

    return run


def stepping(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int):
    """For mapInArrow: rows with ``margins`` moved by the leaves of one tree a lane."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("margins")
            bins, moved = as_array(batch.column("bins")), as_array(batch.column("margins")).copy()
            rows = np.arange(len(bins))
            for lane in range(moved.shape[1]) if len(bins) else ():
                moved[:, lane] += value[lane][nodes_of(bins, rows, feature[lane], cut[lane], depth)]
            ends = np.arange(len(bins) + 1, dtype=np.int32) * (moved.shape[1] if len(bins) else 0)
            yield batch.set_column(at, "margins", pa.ListArray.from_arrays(ends, moved.reshape(-1)))

    return run
