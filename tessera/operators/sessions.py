"""Sessions of an entity's events, separated by inactivity.

The gaps between consecutive events of an entity form a Cartesian tree: the largest gap is the root, left and right of it come the trees of the gaps
before and after. A subtree is a run of events; its root is the largest gap inside it and the node above it the smaller of the two gaps around it. The
sessions of a threshold are exactly the subtrees with the threshold between these two, so a stored tree whose nodes carry both answers any number of gap
settings by one filter that reaches the scan, without reading an event again.

Events are range-partitioned by entity and time: an entity with any share of all rows is spread over as many partitions as it needs. Each Arrow batch of a
sorted partition is a chunk; its tree is merged into that of the chunks before along their right spine, which is all that is kept in memory. Across
partitions the trees are merged when they are cut: only the subtrees at the two ends of a partition can go on, at most two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.audit import micros
from tessera.session import written

#: Stands between events of different entities: above any threshold.
APART = 1 << 62

_COLUMNS = ["entity", "gap", "above", "first_ts", "first_id", "last_ts", "last_id", "n_events", "edge"]
_SCHEMA = "entity string, gap long, above long, first_ts long, first_id string, last_ts long, last_id string, n_events long, edge boolean"


class Spine:
    """The right spine of a growing Cartesian tree: pairs of a subtree and the gap after it, gaps falling. A subtree is [gap, first_ts, first_id, last_ts, last_id, n, edge]."""

    def __init__(self):
        self.pairs: list[tuple[list, int]] = []
        self.last: list | None = None

    def add(self, gap: int, leaf: list) -> Iterator[tuple[list, int]]:
        """Hang a leaf behind a gap; yields the subtrees that are whole now, each with the gap above it."""
        yield from self._fold(gap)
        if self.last is not None:
            self.pairs.append((self.last, gap))
        self.last = leaf

    def _fold(self, gap: int) -> Iterator[tuple[list, int]]:
        while self.pairs and self.pairs[-1][1] <= gap:
            left, g = self.pairs.pop()
            right = self.last
            for x in (left, right):
                if x[0] < g:
                    yield x, g
            self.last = [g, left[1], left[2], right[3], right[4], left[5] + right[5], left[6] or right[6]]

    def close(self) -> Iterator[tuple[list, int]]:
        """All that is left, at the end of an entity or partition."""
        yield from self._fold(APART)
        if self.last is not None:
            yield self.last, APART
        self.pairs, self.last = [], None


def _trees(floor: int):
    """Nodes of the trees of sorted batches. Events at most ``floor`` apart are one leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spine, who, open_ = Spine(), None, None  # open_: the leaf that goes on, with the gap before it
        first = True

        def out(nodes: list) -> pd.DataFrame:
            return pd.DataFrame(nodes, columns=_COLUMNS)

        for batch in batches:
            if batch.empty:
                continue
            nodes: list = []

            def take(found: Iterator[tuple[list, int]], nodes=nodes) -> None:
                nodes += [(who, x[0], above, *x[1:6], bool(x[6])) for x, above in found]

            names, ts, ids = batch["entity"].to_numpy(), batch["ts"].to_numpy(), batch["event_id"].to_numpy()
            other = np.append(True, names[1:] != names[:-1])
            gaps = np.append(APART, np.diff(ts))
            gaps[other] = APART
            if who is not None and names[0] == who:
                gaps[0] = ts[0] - open_[1][3]
                other[0] = False
            begins = np.flatnonzero(gaps > floor)
            head = int(begins[0]) if len(begins) else len(ts)
            if head:  # the open leaf goes on
                leaf = open_[1]
                leaf[3], leaf[4], leaf[5] = int(ts[head - 1]), ids[head - 1], leaf[5] + head
            ends = np.append(begins[1:], len(ts)) - 1
            for b, e in zip(begins.tolist(), ends.tolist()):
                if open_ is not None:
                    take(spine.add(*open_))
                if other[b]:
                    take(spine.close())
                    who = names[b]
                open_ = (int(gaps[b]), [-1, int(ts[b]), ids[b], int(ts[e]), ids[e], e - b + 1, first])
                first = False
            if nodes:
                yield out(nodes)
        if open_ is not None:
            nodes = [(who, x[0], above, *x[1:6], bool(x[6])) for x, above in [*spine.add(*open_)]]
            spine.last[6] = True
            nodes += [(who, x[0], above, *x[1:6], bool(x[6])) for x, above in spine.close()]
            yield out(nodes)

    return run


def gap_forest(events: DataFrame, entity: Column, ts: Column, event_id: Column, floor_micros: int = 0) -> DataFrame:
    """The stored trees of all entities, a row per node; ``cut`` takes sessions of any gap setting of at least ``floor_micros`` from them.

    Node: entity, gap (the largest inside, -1 for a leaf), above (the gap of the node above), first and last time and id, n_events, edge (whether it
    touches the first or last row of its partition). Events with a null entity, time or id take no part; repeated rows count as often as they come; no
    events give no rows. Times are timestamps without zone.
    """
    if floor_micros < 0:
        raise ValueError("gap settings must be numbers of microseconds, not negative")
    rows = events.select(entity.cast("string").alias("entity"), micros(ts).alias("ts"), event_id.cast("string").alias("event_id")).dropna()
    # the bounds of the ranges are sampled: what is sampled is stored, else all before would run twice
    rows = written(rows, "events").repartitionByRange("entity", "ts", "event_id").sortWithinPartitions("entity", "ts", "event_id")
    return written(rows.mapInPandas(_trees(floor_micros), _SCHEMA), "forest")


def cut(forest: DataFrame, gap_micros: int) -> DataFrame:
    """The sessions of one gap setting: entity, first/last time and id, n_events, duration_micros."""
    nodes = forest.where((F.col("gap") <= gap_micros) & (F.col("above") > gap_micros))
    # at most two rows a partition; a session over several partitions has one in each
    by = Window.partitionBy("entity").orderBy("first_ts", "first_id", "last_ts", "last_id")
    ends = nodes.where("edge").withColumn("_new", F.coalesce((F.col("first_ts") - F.lag("last_ts").over(by) > gap_micros).cast("int"), F.lit(1)))
    ends = ends.withColumn("_run", F.sum("_new").over(by))
    first, last = F.struct("first_ts", "first_id"), F.struct("last_ts", "last_id")
    ends = ends.groupBy("entity", "_run").agg(F.min(first).alias("f"), F.max(last).alias("l"), F.sum("n_events").alias("n_events"))
    ends = ends.select("entity", "f.*", "l.*", "n_events")
    whole = nodes.where("not edge").select("entity", "first_ts", "first_id", "last_ts", "last_id", "n_events").unionByName(ends)
    return whole.withColumn("duration_micros", F.col("last_ts") - F.col("first_ts"))


def sessions(events: DataFrame, entity: Column, ts: Column, event_id: Column, gap_micros: int | list[int]) -> DataFrame:
    """Every session for each gap setting: threshold, entity, first/last time and id, duration_micros, n_events.

    An event belongs to the session of the one before (by time, then id) if it comes at most the gap after it. Nulls, repeated rows and empty tables as
    for ``gap_forest``.
    """
    thresholds = sorted({gap_micros} if isinstance(gap_micros, int) else set(gap_micros))
    if not thresholds or thresholds[0] < 0:
        raise ValueError("gap settings must be numbers of microseconds, not negative")
    forest = gap_forest(events, entity, ts, event_id, thresholds[0])
    parts = [cut(forest, t).select(F.lit(t).cast("long").alias("threshold"), "*") for t in thresholds]
    return reduce(DataFrame.unionByName, parts)
