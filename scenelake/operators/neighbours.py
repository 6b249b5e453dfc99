"""Nearest neighbours of points by a tree of boxes, outliers of a cloud, and the alignment of two clouds.

A cloud's space is cut at medians of a sample until a box holds a few hundred
places, so boxes are small where points are dense, and none is empty. A point first
asks the points of its own box, a group of bounded matrices. Its k-th distance there
bounds the true one: only the boxes that reach into this distance are asked as well,
most often none or one, and the lists of a point are put together. So there are two
rounds, however dense or wide a cloud is, and no round compares all points with all.

Mean distances need no neighbour's place, so their boxes are larger: few points are
near enough to a border to ask further boxes, and a group cuts its points again, into
parts of ``PART``, each of which is compared with the parts in its reach. The points
go through as they are, and their copies are put together in the group.

Where a place has more copies than a box may have points, points at one place are
one row with a number, so a place that very many points share costs nothing. The
driver gets the boxes' corners alone, of which there are at most about ``BOXES``.

Defined results:
- points with a null or non-finite coordinate have no neighbours and are none;
- ties at the k-th distance do not change a mean of distances; where a nearest
  point itself is given, ties go to the least coordinates;
- fewer than k other points: all of them; a cloud of one point has none;
- a null cloud key is a cloud; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from ..plans.stages import SENT, dropped, sent_if_few, written

AXES = ("x", "y", "z")
#: Places of a box, about; more if there were more than BOXES boxes. Each box is cut at the medians of some 32 of them.
FULL, BOXES, SAMPLED = 512, 300_000, 32
#: For mean distances there are some SHARES boxes, but of 8 to 64 times FULL points. Their parts have PART places.
SHARES, PART = 256, 128
#: Up to this many places the cuts are made at the medians of all.
WHOLE = 200_000
#: Boxes are looked up below one of 2 ** TOPS boxes of their cloud.
TOPS = 8
#: Numbers of a matrix of distances.
MATRIX = 1 << 21


def _is_finite(axes: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)) for c in axes])


def _finite(points: DataFrame) -> DataFrame:
    return points.where(_is_finite([F.col(c) for c in AXES]))


def places(points: DataFrame, cloud: str, number: str | None = None) -> DataFrame:
    """``cloud``, ``x``, ``y``, ``z`` and the number ``n`` of points at each place; a row is one point, or as many as ``number`` says."""
    named = points.select(F.col(cloud).alias("cloud"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in AXES], (F.col(number) if number else F.lit(1)).cast("long").alias("n"))
    return _finite(named).groupBy("cloud", *AXES).agg(F.sum("n").alias("n"))


def _full(total: int, k: int) -> int:
    """Places of a box that is asked for neighbours themselves."""
    return max(FULL, 4 * k, total // BOXES)


def _wide(total: int, k: int) -> int:
    """Points of a box that is asked for mean distances."""
    return max(min(max(total // SHARES, 8 * FULL), 64 * FULL), 4 * k, total // BOXES)


def _leaves(held: DataFrame, k: int, fill=_full) -> tuple[DataFrame, int]:
    """A row for each box: its cloud ``g``, number ``cell``, the box ``top`` above it, and its corners ``lx`` to ``uz``, the upper ones outside. And the size of a box."""
    clouds = written(held.groupBy("cloud").agg(F.count("*").alias("n")), "clouds")
    total = clouds.agg(F.sum("n")).first()[0] or 0
    full = fill(total, k)
    share = 1.0 if total <= WHOLE else min(1.0, SAMPLED / full)
    unit = F.pmod(F.xxhash64(*AXES), F.lit(1 << 20)) / float(1 << 20)
    some = clouds.select("cloud", *[F.lit(float("nan")).alias(c) for c in AXES])  # for the clouds of which the sample has none
    sample = held.where(unit < share).select("cloud", *AXES).unionByName(some)
    names = ["g", "top", *[f"l{c}" for c in AXES], *[f"u{c}" for c in AXES]]

    def cut(table: pa.Table) -> pa.Table:
        points = _columns(table)
        found, waiting = [], [(points[~np.isnan(points[:, 0])], np.full(3, -np.inf), np.full(3, np.inf), 0, 0)]
        while waiting:
            p, low, high, depth, top = waiting.pop()
            axis = int(np.argmax(np.ptp(p, 0))) if len(p) else 0
            line = np.sort(p[:, axis])
            if len(p) / share <= full or line[0] == line[-1]:
                found.append((top, low, high))
                continue
            at = line[len(line) // 2] if line[len(line) // 2] > line[0] else line[np.searchsorted(line, line[0], "right")]
            left = p[:, axis] < at
            inner, outer = high.copy(), low.copy()
            inner[axis] = outer[axis] = at
            tops = (2 * top + 1, 2 * top + 2) if depth < TOPS else (top, top)
            waiting += [(p[left], low, inner, depth + 1, tops[0]), (p[~left], outer, high, depth + 1, tops[1])]
        corners = np.array([np.concatenate([low, high]) for _, low, high in found])
        cloud = pa.array([table["cloud"][0].as_py()] * len(found), table.schema.field("cloud").type)
        return pa.Table.from_arrays([cloud, pa.array([t for t, _, _ in found], pa.int64()), *map(pa.array, corners.T)], names)

    kind = held.schema["cloud"].dataType.simpleString()
    boxes = sample.groupBy("cloud").applyInArrow(cut, f"g {kind}, top long, " + ", ".join(f"{c} double" for c in names[2:]))
    leaves = written(boxes.withColumn("cell", F.monotonically_increasing_id()), "leaves")
    dropped(clouds)
    return leaves, full


def _placed(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """``points`` with the number ``cell`` of their box; those of clouds without boxes are left out."""
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= F.col(f"l{c}")) & (F.col(c) < F.col(f"u{c}")) for c in AXES])
    cell = F.col("cloud").eqNullSafe(F.col("g")) & inside
    if leaves.groupBy("g", "top").count().where("count > 1").isEmpty():
        return points.join(sent_if_few(leaves, 2 * BOXES), cell).select(*points.columns, "cell")
    corners = [*[F.min(f"l{c}").alias(f"l{c}") for c in AXES], *[F.max(f"u{c}").alias(f"u{c}") for c in AXES]]
    tops = leaves.groupBy(F.col("g").alias("t"), F.col("top").alias("above")).agg(*corners)
    met = points.join(sent_if_few(tops, 2 * BOXES), F.col("cloud").eqNullSafe(F.col("t")) & inside).select(*points.columns, "above")
    return met.join(sent_if_few(leaves, 2 * BOXES), cell & (F.col("above") == F.col("top"))).select(*points.columns, "cell")


class Index:
    """The places of ``held`` in boxes, to be asked again and again for up to ``k`` neighbours."""

    def __init__(self, held: DataFrame, k: int, fill=_full):
        self.leaves, self.full = _leaves(held, k, fill)
        self.held = written(_placed(held, self.leaves), "held")
        corners = [*[F.min(c).alias(f"l{c}") for c in AXES], *[F.max(c).alias(f"u{c}") for c in AXES]]
        ends = [F.col(f"{s}{c}").alias(f"{s}{s}{c}") for s in "lu" for c in AXES]
        of = self.leaves.select("cell", F.min("cell").over(Window.partitionBy("g")).alias("code"), *ends)  # a row for each box
        table = self.held.groupBy("cell").agg(*corners, F.count("*").alias("rows")).join(of, "cell").orderBy("code", "cell").toArrow()
        self.cells, self.codes = table["cell"].to_numpy(), table["code"].to_numpy()
        self.low, self.high, self.inner, self.outer = (np.stack([table[f"{s}{c}"].to_numpy() for c in AXES], 1).reshape(-1, 3) for s in ("l", "u", "ll", "uu"))
        self.most = max(table["rows"].to_pylist(), default=0)

    def drop(self) -> None:
        """Delete the files of the index."""
        dropped(self.leaves, self.held)


def _near(a: np.ndarray, h: np.ndarray, n: np.ndarray, k: int, same: bool):
    """Distances, indexes and numbers of the nearest of the places ``h``, sorted by their coordinates, for a part of the places ``a`` at a time."""
    most = min(k + same, len(h))
    step = max(1, MATRIX // len(h))
    for first in range(0, len(a), step):
        part = a[first : first + step]
        d = np.sqrt(sum((part[:, i, None] - h[None, :, i]) ** 2 for i in range(3)))
        if most == 1:
            at = d.argmin(1)[:, None]
        elif most == len(h):
            at = np.broadcast_to(np.arange(len(h)), d.shape)
        else:
            at = np.argpartition(d, most - 1, axis=1)[:, :most]
            last = np.take_along_axis(d, at, 1).max(1)
            for row in np.flatnonzero((d <= last[:, None]).sum(1) > most):
                at[row] = np.argsort(d[row], kind="stable")[:most]
        near = np.take_along_axis(d, at, 1)
        order = np.lexsort((at, near), axis=1)
        at, near = np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)
        number = n[at]
        if same:
            number = number - (h[at] == part[:, None]).all(2)
        yield first, part, near, at, number


def _lists(mask: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """List columns of the values of each row that the mask keeps."""
    ends = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
    return [pa.ListArray.from_arrays(ends, v[mask]) for v in values]


def _columns(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in AXES], 1)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h = _columns(table)
    order = np.lexsort(h.T[::-1])
    return h[order], table["n"].to_numpy()[order]


def _asked(asked: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """``asked`` with ``near``, the sorted array of the nearest places' ``d``, ``hx``, ``hy``, ``hz`` and ``m``."""
    key = ["cloud", *AXES, "n"]
    lists = ["d", *[f"h{c}" for c in AXES], "m"]
    kind = asked.schema["cloud"].dataType.simpleString()
    shape = f"cloud {kind}, x double, y double, z double, n long, " + ", ".join(f"{c} array<{'long' if c == 'm' else 'double'}>" for c in lists)
    cells, codes, low, high = index.cells, index.codes, index.low, index.high
    place = np.argsort(cells)

    def found(near, spot, number, keep, h):
        return _lists(keep, near, *[h[spot][..., i] for i in range(3)], number)

    def own(asks: pa.Table, held: pa.Table) -> pa.Table:
        h, n = _sorted(held)
        a, out = _columns(asks), []
        me = place[np.searchsorted(cells, asks["cell"][0].as_py(), sorter=place)] if asks.num_rows else 0
        span = slice(*np.searchsorted(codes, [codes[me], codes[me] + 1]))
        rivals = np.arange(span.start, span.stop)
        rivals = rivals[rivals != me]
        for first, part, near, spot, number in _near(a, h, n, k, same):
            past = np.cumsum(number, 1)
            take = np.clip(k - (past - number), 0, number)
            reach = np.where(past[:, -1] >= k, np.where(take > 0, near, 0).max(1), np.inf)
            gap = np.maximum(np.maximum(low[rivals] - part.max(0), part.min(0) - high[rivals]), 0)
            close = rivals[np.sqrt((gap * gap).sum(1)) * (1 - 1e-12) <= reach.max()]
            gap = np.sqrt(sum(np.maximum(np.maximum(low[close, i] - part[:, i, None], part[:, i, None] - high[close, i]), 0) ** 2 for i in range(3)))
            hit = gap * (1 - 1e-12) <= reach[:, None]
            rows = asks.slice(first, len(part)).select(key).combine_chunks()
            to = _lists(hit, np.broadcast_to(cells[close], hit.shape))[0]
            columns = [*found(near, spot, number, take > 0, h), pa.array(reach), to]
            out.append(pa.Table.from_arrays([*rows.columns, *columns], [*key, *lists, "reach", "cells"]))
        return pa.concat_tables(out) if out else empty

    def other(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return none
        h, n = _sorted(held)
        out, reach = [], asks["reach"].to_numpy()
        for first, part, near, spot, number in _near(_columns(asks), h, n, k, False):
            rows = asks.slice(first, len(part)).select(key).combine_chunks()
            keep = near <= reach[first : first + len(part), None]
            out.append(pa.Table.from_arrays([*rows.columns, *found(near, spot, number, keep, h)], [*key, *lists]))
        return pa.concat_tables(out)

    none = to_arrow_schema(StructType.fromDDL(shape)).empty_table()
    whole = StructType.fromDDL(shape).add("reach", DoubleType()).add("cells", ArrayType(LongType()))
    empty = to_arrow_schema(whole).empty_table()
    placed = _placed(asked.select(*key), index.leaves)
    by_cell = index.held.select("cell", *AXES, "n").groupBy("cell")
    first = written(placed.groupBy("cell").cogroup(by_cell).applyInArrow(own, whole), "near")
    still = first.where(F.size("cells") > 0)
    asks = still.select(*key, "reach", F.explode("cells").alias("cell"))
    more = asks.groupBy("cell").cogroup(by_cell).applyInArrow(other, StructType.fromDDL(shape))
    zipped = F.arrays_zip(*lists)
    joined = still.select(*key, zipped.alias("near")).unionByName(more.select(*key, zipped.alias("near"))).groupBy(*key)
    joined = joined.agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    known = first.where(F.size("cells") == 0).select(*key, zipped.alias("near"))
    return known.unionByName(joined)


def nearest(asked: DataFrame, held: DataFrame | Index, k: int, same: bool = False) -> DataFrame:
    """The k nearest places of ``held`` for each place of ``asked``, with ranks and multiplicities.

    Both have ``cloud``, ``x``, ``y``, ``z``, ``n`` as :func:`places` gives them; ``held`` may be
    an :class:`Index`. Rows: the asking place, ``hx``, ``hy``, ``hz``, ``d``, ``take`` (how many of
    the k stand there). ``same``: both are one cloud, and a point is not its own neighbour.
    """
    index = held if isinstance(held, Index) else Index(held, k)
    before = lambda i: F.aggregate(F.slice("near", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["m"])
    take = lambda x, i: F.greatest(F.least(x["m"], F.lit(k) - before(i)), F.lit(0)).alias("take")
    rows = F.transform("near", lambda x, i: F.struct(*[x[f"h{c}"].alias(f"h{c}") for c in AXES], x["d"].alias("d"), take(x, i)))
    return _asked(asked, index, k, same).select("cloud", *AXES, F.inline(rows)).where("take > 0")


class _Parts:
    """Places cut at medians into parts, to be compared with the places in their reach; ``number`` copies of a place count, up to ``k``."""

    def __init__(self, p: np.ndarray, number: np.ndarray, k: int):
        self.order, ends, waiting = np.arange(len(p)), [], [(0, len(p))]
        while waiting:
            a, b = waiting.pop()
            if b - a <= max(PART, 3 * k):
                ends.append((a, b))
                continue
            span = self.order[a:b]
            own = p[span]
            m = (b - a) // 2
            self.order[a:b] = span[np.argpartition(own[:, np.argmax(np.ptp(own, 0))], m)]
            waiting += [(a, a + m), (a + m, b)]
        self.ends, self.p = sorted(ends), p[self.order]
        starts = [a for a, _ in self.ends]
        self.low, self.high = (f.reduceat(self.p, starts) if len(p) else self.p for f in (np.minimum, np.maximum))
        number = np.minimum(number[self.order], k)
        self.number = number if (number > 1).any() else None

    def around(self, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
        """The places within reach of a box, copies after one another."""
        spans = [slice(*self.ends[i]) for i in np.flatnonzero(_gap(self.low, self.high, low, high) <= reach)]
        p = np.concatenate([self.p[:0], *[self.p[x] for x in spans]])
        near = _gap(p, p, low, high) <= reach
        return p[near] if self.number is None else np.repeat(p[near], np.concatenate([self.number[:0], *[self.number[x] for x in spans]])[near], 0)


def _gap(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between boxes, a little less than computed ones of their points."""
    square = 0.0
    for i in range(3):
        gap = np.maximum(np.maximum(low[..., i] - b[..., i], a[..., i] - high[..., i]), 0)
        square = square + gap * gap
    return np.sqrt(square) * (1 - 1e-12)


def _least(a: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each of the places ``a`` to ``h``, sorted; infinite ones where there are fewer."""
    out = np.full((len(a), k), np.inf)
    step = max(1, MATRIX // max(1, len(h)))
    for first in range(0, len(a) if len(h) else 0, step):
        part = a[first : first + step]
        d = np.zeros((len(part), len(h)))
        for i in range(3):
            side = part[:, i, None] - h[None, :, i]
            side *= side
            d += side
        least = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if len(h) > k else d, axis=1)
        out[first : first + step, : least.shape[1]] = np.sqrt(least)
    return out


def _once(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of points, their numbers, and the place of each point."""
    order = np.lexsort(p.T)
    new = np.concatenate([[True], (p[order[1:]] != p[order[:-1]]).any(1)])
    place = np.empty(len(p), np.int64)
    place[order] = np.cumsum(new) - 1
    return p[order[new]], np.bincount(place, n).astype(np.int64), place


def _means(index: Index, k: int) -> DataFrame:
    """The points of an index, without their cell, and the mean distance ``mean`` to the k nearest other points."""
    cells, codes, low, high = index.cells, index.codes, index.low, index.high
    place = np.argsort(cells)
    columns = [f for f in index.held.schema.fields if f.name != "cell"]
    names = [f.name for f in columns]
    ended = StructType([*columns]).add("mean", DoubleType())
    begun = StructType([*ended.fields]).add("home", LongType()).add("at", LongType()).add("reach", DoubleType()).add("near", ArrayType(DoubleType())).add("cells", ArrayType(LongType()))
    heard = "home long, at long, near array<double>"
    none = to_arrow_schema(StructType.fromDDL(heard)).empty_table()

    def own(table: pa.Table) -> pa.Table:
        home = table["cell"][0].as_py()
        me = place[np.searchsorted(cells, home, sorter=place)]
        rivals = np.arange(*np.searchsorted(codes, [codes[me], codes[me] + 1]))
        rivals = rivals[rivals != me]
        p, n, at = _once(_columns(table), table["n"].to_numpy())
        parts = _Parts(p, n, k + 1)  # a point finds itself as well
        near, asks, asked = np.empty((len(p), k)), [at[:0]], [cells[:0]]
        for (a, b), inner, outer in zip(parts.ends, parts.low, parts.high):
            part = parts.p[a:b]
            copies = part if parts.number is None else np.repeat(part, parts.number[a:b], 0)
            most = _least(part, copies, k + 1)[:, -1].max()
            near[a:b] = _least(part, parts.around(inner, outer, most), k + 1)[:, 1:]
            close = rivals[_gap(low[rivals], high[rivals], inner, outer) <= near[a:b, -1].max()]
            if len(close):
                i, j = np.nonzero(_gap(low[close], high[close], part[:, None], part[:, None]) <= near[a:b, -1:])
                asks.append(parts.order[a + i])
                asked.append(cells[close[j]])
        near[parts.order] = near.copy()
        told = np.isfinite(near)
        total = told.sum(1)
        mean = np.where(told, near, 0.0).sum(1) / np.maximum(total, 1)
        asks, asked = np.concatenate(asks), np.concatenate(asked)
        asked, number = asked[np.argsort(asks, kind="stable")], np.bincount(asks, minlength=len(p))
        row = number[at] > 0
        lists = _lists(told[at] & row[:, None], near[at])[0]
        ends = np.concatenate([[0], np.cumsum(number[at])])
        spot = np.arange(ends[-1]) + np.repeat((np.cumsum(number) - number)[at] - ends[:-1], number[at])
        to = pa.ListArray.from_arrays(ends.astype(np.int32), asked[spot])
        more = [pa.array(mean[at], mask=row | (total == 0)[at]), pa.array(np.full(len(at), home)), pa.array(np.arange(len(at))), pa.array(near[at, -1]), lists, to]
        return pa.Table.from_arrays([*table.select(names).columns, *more], begun.names)

    def other(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return none
        p, n, _ = _once(_columns(held), held["n"].to_numpy())
        parts, askers = _Parts(p, n, k), _Parts(_columns(asks), np.ones(asks.num_rows, np.int64), 1)
        reach = asks["reach"].to_numpy()[askers.order]
        near = np.empty((asks.num_rows, k))
        for (a, b), inner, outer in zip(askers.ends, askers.low, askers.high):
            near[a:b] = _least(askers.p[a:b], parts.around(inner, outer, reach[a:b].max()), k)
        keep = (near <= reach[:, None]) & np.isfinite(near)
        some = keep.any(1)
        of = [asks[c].to_numpy()[askers.order][some] for c in ("home", "at")]
        return pa.Table.from_arrays([*map(pa.array, of), *_lists(keep[some], near[some])], none.column_names)

    def all_in_all(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return empty
        place = np.argsort(mine["at"].to_numpy())
        row, d = [], []
        for t in (mine, told):
            lists = t["near"].combine_chunks()
            rows = place[np.searchsorted(mine["at"].to_numpy(), t["at"].to_numpy(), sorter=place)]
            row.append(np.repeat(rows, lists.value_lengths().to_numpy()))
            d.append(lists.flatten().to_numpy())
        row, d = np.concatenate(row), np.concatenate(d)
        order = np.lexsort((d, row))
        row, d = row[order], d[order]
        number = np.bincount(row, minlength=mine.num_rows)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        total = np.minimum(number, k)
        mean = np.bincount(row, np.where(rank < k, d, 0.0), mine.num_rows) / np.maximum(total, 1)
        return pa.Table.from_arrays([*mine.select(names).columns, pa.array(mean, mask=total == 0)], ended.names)

    empty = to_arrow_schema(ended).empty_table()
    first = written(index.held.groupBy("cell").applyInArrow(own, begun), "near")
    still = first.where(F.size("cells") > 0)
    asks = still.select("home", "at", "reach", *AXES, F.explode("cells").alias("cell"))
    held = index.held.select("cell", *AXES, "n")
    answers = asks.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(other, heard)
    joined = still.drop("cells").groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(all_in_all, ended)
    return first.where(F.size("cells") == 0).select(*ended.names).unionByName(joined)


def mean_distances(points: DataFrame, k: int, cloud: str = "cloud") -> DataFrame:
    """``cloud``, ``x``, ``y``, ``z``, ``n`` and the mean distance ``mean`` to the k nearest other points; null where there is none."""
    return _means(Index(written(places(points, cloud), "places"), k, _wide), k)


def outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, cloud: str = "cloud") -> DataFrame:
    """``points`` with ``mean_distance``, the cloud's ``cut`` and whether the point is an ``outlier``.

    The cut is the mean of the mean distances plus ``ratio`` sample deviations of
    them. Points without neighbours or without whole coordinates have nulls and are
    no outliers.
    """
    whole = F.struct(*[F.col(c) for c in points.columns]).alias("row")
    named = points.select(F.col(cloud).alias("cloud"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in AXES], F.lit(1).cast("long").alias("n"), whole)
    index = Index(_finite(named), k, _wide)
    copies = index.most > 4 * index.full
    if copies:
        index.drop()
    means = written(mean_distances(points, k, cloud) if copies else _means(index, k).select("cloud", "n", "mean", "row"), "means")
    total, one, two = F.sum("n"), F.sum(F.col("n") * F.col("mean")), F.sum(F.col("n") * F.col("mean") * F.col("mean"))
    sums = means.where("mean is not null").groupBy(F.col("cloud").alias("c_cloud")).agg(total.alias("t"), (one / total).alias("m"), two.alias("s"))
    spread = F.sqrt(F.greatest(F.col("s") - F.col("t") * F.col("m") * F.col("m"), F.lit(0.0)) / F.greatest(F.col("t") - 1, F.lit(1)))
    cuts = sent_if_few(sums.select("c_cloud", (F.col("m") + ratio * spread).alias("cut")))
    judged = means.join(cuts, F.col("cloud").eqNullSafe(F.col("c_cloud")), "left")
    out = F.coalesce(F.col("mean_distance") > F.col("cut"), F.lit(False)).alias("outlier")
    if copies:
        judged = judged.select(F.col("cloud").alias("j_cloud"), *[F.col(c).alias(f"j_{c}") for c in AXES], F.col("mean").alias("mean_distance"), "cut")
        same = F.col(cloud).eqNullSafe(F.col("j_cloud")) & reduce(lambda a, b: a & b, [F.col(c) == F.col(f"j_{c}") for c in AXES])
        return points.join(judged, same, "left").select(*points.columns, "mean_distance", "cut", out)
    broken = points.where(~_is_finite([F.col(c).cast("double") for c in AXES])).withColumns({c: F.lit(None).cast("double") for c in ("mean_distance", "cut")})
    return judged.select("row.*", F.col("mean").alias("mean_distance"), "cut").unionByName(broken).select(*points.columns, "mean_distance", "cut", out)


# -- alignment --------------------------------------------------------------------

_TURN = [f"r{i}{j}" for i in range(3) for j in range(3)]
_SHIFT = ["tx", "ty", "tz"]


def moved(points: DataFrame, motions: DataFrame, cloud: str = "cloud") -> DataFrame:
    """Points under their cloud's motion, a row of ``r00`` to ``r22`` and ``tx``, ``ty``, ``tz`` each."""
    few = sent_if_few(motions.select(F.col("cloud").alias("m_cloud"), *_TURN, *_SHIFT))
    joined = points.join(few, F.col(cloud).eqNullSafe(F.col("m_cloud")))
    after = [
        reduce(lambda a, b: a + b, [F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate(AXES)]) + F.col(_SHIFT[i]) for i in range(3)
    ]
    return joined.select(*[after[AXES.index(c)].alias(c) if c in AXES else F.col(c) for c in points.columns])


_SUMMED = ["w", *[f"{s}{c}" for s in "ab" for c in AXES], *[f"q{i}{j}" for i in range(3) for j in range(3)], "e"]


def _paired(a: DataFrame, index: Index) -> DataFrame:
    """Weights, weighted coordinates, products and squared distances, summed over the places ``a`` and their nearest ones."""
    near = nearest(a, index, 1).toDF("p_cloud", "px", "py", "pz", "hx", "hy", "hz", "d", "take")
    same = F.col("cloud").eqNullSafe(F.col("p_cloud")) & reduce(lambda u, v: u & v, [F.col(c) == F.col(f"p{c}") for c in AXES])
    pairs = a.join(near, same).select("cloud", *AXES, F.col("n").cast("double").alias("w"), "hx", "hy", "hz", "d")
    w = F.col("w")
    terms = [w, *[w * F.col(c) for c in AXES], *[w * F.col(f"h{c}") for c in AXES], *[w * F.col(c) * F.col(f"h{e}") for c in AXES for e in AXES], w * F.col("d") * F.col("d")]
    return pairs.groupBy("cloud").agg(*[F.sum(t).alias(name) for t, name in zip(terms, _SUMMED)])


def _centred(sums: DataFrame) -> DataFrame:
    """Centroids, covariance sums and error of each cloud from rows of :func:`_paired`."""
    sums = sums.groupBy("cloud").agg(*[F.sum(c).alias(c) for c in _SUMMED]).where("w > 0")
    means = {c: F.col(c) / F.col("w") for c in _SUMMED[1:7]}
    centred = [(F.col(f"q{i}{j}") - F.col("w") * means[f"a{c}"] * means[f"b{e}"]).alias(f"s{i}{j}") for i, c in enumerate(AXES) for j, e in enumerate(AXES)]
    return sums.select("cloud", F.col("w").cast("long").alias("pairs"), *[m.alias(c) for c, m in means.items()], *centred, F.sqrt(F.col("e") / F.col("w")).alias("rmse"))


def pair_sums(source: DataFrame, target: DataFrame | Index, cloud: str = "cloud") -> DataFrame:
    """Sums over each source point and its nearest target point: ``pairs``, both centroids, the 3 x 3 covariance sums ``s00`` to ``s22`` and ``rmse``."""
    index = target if isinstance(target, Index) else Index(written(places(target, cloud), "target"), 1)
    return _centred(_paired(written(places(source, cloud), "source"), index))


def _packs(source: DataFrame, index: Index, motions: DataFrame) -> DataFrame:
    """Rows of source places with all target places around them, for many rounds.

    A row has up to about ``4 * FULL`` places of ``source`` (``sx``, ``sy``, ``sz``, ``sn``) that ``motions`` bring
    into one box of the index, and the target places ``hx``, ``hy``, ``hz`` within the corners ``e`` of that box, moved out by a
    quarter of its width.
    """
    cells, codes, low, high = index.cells, index.codes, index.low, index.high
    place = np.argsort(cells)
    span = np.sort(high - low, 1)
    margin = (np.where(span[:, 1] > 0, span[:, 1], span[:, 2]) / 4)[:, None]
    least, most = index.inner - margin, index.outer + margin
    corners = [f"e{s}{c}" for s in "lu" for c in AXES]

    def around(tables):
        for batch in tables:
            for cell in batch["cell"].to_numpy():
                me = place[np.searchsorted(cells, cell, sorter=place)]
                first, last = np.searchsorted(codes, [codes[me], codes[me] + 1])
                met = first + np.flatnonzero(((low[first:last] <= most[me]) & (high[first:last] >= least[me])).all(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(met), cell)), pa.array(cells[met]), *[pa.array(np.full(len(met), x)) for x in (*least[me], *most[me])]], ["to", "cell", *corners]
                )

    def pack(key: tuple, mine: pa.Table, held: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return none
        me = place[np.searchsorted(cells, key[0].as_py(), sorter=place)]
        h, _ = _sorted(held.append_column("n", held["x"]))
        lists = [*[mine[f"o{c}"].to_numpy() for c in AXES], mine["n"].to_numpy(), *h.T, np.concatenate([least[me], most[me]])]
        return pa.Table.from_arrays([mine["cloud"].slice(0, 1), *[pa.array([x]) for x in lists]], names)

    kept = source.withColumns({f"o{c}": F.col(c) for c in AXES})
    placed = written(_placed(moved(kept, motions), index.leaves).select("cloud", "cell", "n", *[f"o{c}" for c in AXES]), "placed")
    parts = placed.groupBy(F.col("cell").alias("p_cell")).agg(F.ceil(F.count("*") / (4 * FULL)).alias("parts")).where("parts > 1")
    dealt = placed.join(sent_if_few(parts), F.expr("cell = p_cell"), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("ox", "oy", "oz"), F.coalesce("parts", F.lit(1))))
    some = dealt.select("cell", "part").distinct().toDF("to", "part")
    met = index.leaves.select("cell").mapInArrow(around, "to long, cell long, " + ", ".join(f"{c} double" for c in corners)).join(some, "to")
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= F.col(f"el{c}")) & (F.col(c) <= F.col(f"eu{c}")) for c in AXES])
    held = met.join(index.held.select("cell", *AXES), "cell").where(inside).select("to", "part", *AXES)
    names = ["cloud", *[f"s{c}" for c in AXES], "sn", *[f"h{c}" for c in AXES], "e"]
    kind = source.schema["cloud"].dataType.simpleString()
    shape = f"cloud {kind}, " + ", ".join(f"{c} array<{'long' if c == 'sn' else 'double'}>" for c in names[1:])
    none = to_arrow_schema(StructType.fromDDL(shape)).empty_table()
    tasks = max(2 * source.sparkSession.sparkContext.defaultParallelism, len(cells) // 32)  # the rows are few for their work
    sides = [df.repartition(tasks, c, "part").groupBy(c, "part") for df, c in ((dealt, "cell"), (held, "to"))]
    packs = written(sides[0].cogroup(sides[1]).applyInArrow(pack, shape), "packs")
    dropped(placed)
    return packs


def _round(packs: DataFrame, motions: DataFrame) -> DataFrame:
    """The sums of each row of ``packs`` under its cloud's motion, and the moved places ``x``, ``y``, ``z``, ``n`` that may have a nearer target place than those of the row."""
    kind = packs.schema["cloud"].dataType.simpleString()
    shape = f"cloud {kind}, " + ", ".join(f"{c} double" for c in _SUMMED) + ", " + ", ".join(f"{c} array<double>" for c in AXES) + ", n array<long>"
    names = StructType.fromDDL(shape).names

    def run(batches):
        for batch in batches:
            turns = np.stack([batch[c].to_numpy() for c in (*_TURN, *_SHIFT)], 1)
            lists = [batch[c] for c in ("sx", "sy", "sz", "sn", "hx", "hy", "hz", "e")]
            for row, turn in enumerate(turns):
                sx, sy, sz, n, hx, hy, hz, e = (x[row].values.to_numpy() for x in lists)
                p, h = np.stack([sx, sy, sz], 1) @ turn[:9].reshape(3, 3).T + turn[9:], np.stack([hx, hy, hz], 1)
                d, at = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
                parts = _Parts(p, n, 1)
                for (a, b), low, high in zip(parts.ends, parts.low, parts.high) if len(h) else ():
                    reach = _least(parts.p[a:b], h[::8], 1).max()
                    around = np.flatnonzero(_gap(h, h, low, high) <= reach)
                    for first, part, near, spot, _ in _near(parts.p[a:b], h[around], np.ones(len(around)), 1, False) if len(around) else ():
                        of = parts.order[a + first : a + first + len(part)]
                        d[of], at[of] = near[:, 0], around[spot[:, 0]]
                done = d <= np.minimum(p - e[:3], e[3:] - p).min(1) * (1 - 1e-12)
                w, a, b = n[done].astype(float), p[done], h[at[done]]
                sums = [w.sum(), *(w @ a), *(w @ b), *((a * w[:, None]).T @ b).ravel(), w @ (d[done] ** 2)]
                rest = [*p[~done].T, n[~done]]
                yield pa.RecordBatch.from_arrays([batch["cloud"].slice(row, 1), *[pa.array([x]) for x in (*sums, *rest)]], names)

    joined = packs.join(motions.select(F.col("cloud").alias("m_cloud"), *_TURN, *_SHIFT), F.col("cloud").eqNullSafe(F.col("m_cloud"))).drop("m_cloud")
    return written(joined.mapInArrow(run, shape), "round")


def rigid_motions(sums: DataFrame) -> DataFrame:
    """The rotation and shift of each row of :func:`pair_sums` that brings the source nearest to the target, by singular values."""
    kind = sums.schema["cloud"].dataType.simpleString()

    def run(frames):
        for f in frames:
            s = f[[f"s{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(-1, 3, 3)
            u, _, vt = np.linalg.svd(s)
            flip = np.ones((len(f), 3))
            flip[:, 2] = np.sign(np.linalg.det(np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)))
            r = np.swapaxes(vt, 1, 2) * flip[:, None, :] @ np.swapaxes(u, 1, 2)
            a, b = f[["ax", "ay", "az"]].to_numpy(float), f[["bx", "by", "bz"]].to_numpy(float)
            t = b - (r @ a[:, :, None])[:, :, 0]
            out = pd.DataFrame(np.hstack([r.reshape(-1, 9), t]), columns=_TURN + _SHIFT)
            out.insert(0, "cloud", f.cloud.to_numpy())
            out["rmse"] = f.rmse.to_numpy()
            yield out

    return sums.mapInPandas(run, f"cloud {kind}, " + ", ".join(f"{c} double" for c in (*_TURN, *_SHIFT, "rmse")))


def align(source: DataFrame, target: DataFrame, rounds: int = 30, small: float = 1e-9, cloud: str = "cloud") -> DataFrame:
    """The motion of each source cloud onto its target cloud: ``r00`` to ``r22``, ``tx``, ``ty``, ``tz``, ``rmse`` and the ``rounds`` it took.

    A round pairs each point with the nearest target point, and adds the rigid
    motion of these pairs to the one so far; the state is a row a cloud. Clouds
    stop when their error falls by less than ``small``.

    Points are put beside the target points around them once, so a round reads these
    rows and shuffles sums alone. Points whose nearest target point may lie further
    away ask the boxes of the target; if these are many, points are dealt anew.
    """
    turn = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(3)} | {c: F.lit(0.0) for c in _SHIFT}
    state = source.select(F.col(cloud).alias("cloud")).distinct().withColumns(turn | {"rmse": F.lit(float("inf")), "rounds": F.lit(0), "going": F.lit(True)})
    state, held = written(state, "motions"), Index(written(places(target, cloud), "target"), 1)
    source = written(places(source, cloud), "source")
    packs, most = _packs(source, held, state), source.count() // 8
    few = state.count() <= SENT
    for _ in range(rounds):
        going = state.where("going")
        found = _round(packs, going.hint("broadcast") if few else going)
        rest = found.agg(F.sum(F.size("n"))).first()[0] or 0
        sums = found.select("cloud", *_SUMMED)
        if rest:
            asks = written(places(found.select("cloud", F.inline(F.arrays_zip(*AXES, "n"))), "cloud", "n"), "asks")
            sums = sums.unionByName(_paired(asks, held))
        step = rigid_motions(_centred(sums))
        step = step.toDF("s_cloud", *[f"s_{c}" for c in (*_TURN, *_SHIFT, "rmse")])
        joined = state.join(step, F.col("cloud").eqNullSafe(F.col("s_cloud")), "left")
        on = F.col("s_rmse").isNotNull()
        new = {
            f"r{i}{j}": reduce(lambda a, b: a + b, [F.col(f"s_r{i}{m}") * F.col(f"r{m}{j}") for m in range(3)]) for i in range(3) for j in range(3)
        }
        new |= {c: reduce(lambda a, b: a + b, [F.col(f"s_r{i}{m}") * F.col(_SHIFT[m]) for m in range(3)]) + F.col(f"s_{c}") for i, c in enumerate(_SHIFT)}
        kept = [F.when(on, new[c]).otherwise(F.col(c)).alias(c) for c in (*_TURN, *_SHIFT)]
        falls = on & (F.col("rmse") - F.col("s_rmse") > small)
        after = joined.select(
            "cloud", *kept, F.coalesce("s_rmse", "rmse").alias("rmse"), (F.col("rounds") + on.cast("int")).alias("rounds"), falls.alias("going")
        )
        after = written(after, "motions")
        dropped(state, found)
        state = after
        if state.where("going").isEmpty():
            break
        if rest > most:
            dropped(packs)
            packs = _packs(source, held, state)
    dropped(packs)
    return state.drop("going")
