"""Time windows, nearest frames and monotone alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import saved, ship_package
from .evidence import top_k


def clip_windows(media: DataFrame, id_col: str, duration: str, seconds: float = 5.0) -> DataFrame:
    """Fixed windows [start, end) over each duration; the last is cut at the end."""
    n = F.ceil(F.col(duration) / seconds).cast("int")
    clips = media.where(F.col(duration) > 0).select(id_col, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("clip"))
    return clips.select(id_col, "clip", (F.col("clip") * seconds).alias("start"), F.least((F.col("clip") + 1) * seconds, F.col(duration)).alias("end"))


def nearest_frames(clips: DataFrame, frames: DataFrame, id_col: str, at: str, seconds: float = 5.0, k: int = 3) -> DataFrame:
    """The k frames of each clip nearest to its middle; ties to the earlier. Frames meet their clip by number,
    an equi-join, not by a range."""
    numbered = frames.withColumn("clip", F.floor(F.col(at) / seconds).cast("int"))
    inside = clips.join(numbered, [id_col, "clip"]).where(F.col(at) < F.col("end"))
    away = F.abs(F.col(at) - (F.col("start") + F.col("end")) / 2)
    return top_k(inside.withColumn("away", away), [id_col, "clip"], k, F.col("away"), F.col(at))


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the closed ranges of their key that hold them: ranges are dealt to the buckets they touch."""
    bucket = lambda c: F.floor(c / width)
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return points.withColumn("__bucket", bucket(F.col(at))).join(spread, [key, "__bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def best_step(scores: DataFrame, media: str, step: str, order: str, score: str, threshold: float) -> DataFrame:
    """Each medium's best step at or above the threshold; ties to the earlier step."""
    return top_k(scores.where(F.col(score) >= threshold), [media], 1, F.desc(score), F.col(order), F.col(step)).drop("rank")


def align_monotone(scores: DataFrame, timeline: str, threshold: float, parts: int | None = None) -> DataFrame:
    """(timeline, media, step, score): an assignment along time whose steps never go back.

    scores(timeline, media, at, step, step_order, score) holds the pairs of one timeline. It maximises the
    sum of (score - threshold), then the number of matches, then takes the lexicographically smallest
    orders. Media of equal time may take any steps, but later ones never an earlier step.

    Rows are dealt by ranges of timeline and time, so a long timeline is a chain of segments. A segment that
    is only a part of one is solved once for each step order that may be reached before it: what it gains
    on the way to each order behind it, and which way is the smaller of equal ones. These tables are multiplied
    along the chain (maxima of sums), which tells where the best assignment enters and leaves every segment;
    then each segment is solved for that. Only states cross the borders, and a task holds one segment's choices.
    """
    kind = scores.schema[timeline].dataType
    spark = scores.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField(timeline, kind), T.StructField("media", T.StringType()), T.StructField("step", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = scores.select(F.col(timeline).alias("timeline"), F.col("media").cast("string").alias("media"), "at", F.col("step").cast("string").alias("step"), F.col("step_order").cast("long").alias("step_order"), F.col("score").cast("double").alias("score"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = saved(rows.repartitionByRange(parts, "timeline", "at").withColumn("part", F.spark_partition_id()))
    chains = saved(dealt.groupBy("timeline").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.array_sort(F.array_append(F.collect_set(F.when(F.col("score") >= threshold, F.col("step_order"))), F.lit(-1).cast("long"))).alias("orders")))
    # a range has at most two timelines that go beyond it, so the chains of several segments are few
    long_ones = chains.where("first < last").select(F.col("timeline").alias("__t"), "orders")
    same = F.col("timeline").eqNullSafe(F.col("__t"))
    segments = saved(dealt.join(F.broadcast(long_ones), same).drop("__t"))
    short = dealt.join(F.broadcast(long_ones.select("__t")), same, "left_anti").withColumns({"enter": F.lit(-1).cast("long"), "leave": F.lit(None).cast("long")})
    sort = ["timeline", "part", "at", "media", "step_order", "step"]
    by_segment = lambda df: df.repartition(parts, "timeline", "part").sortWithinPartitions(*sort)

    tables = T.StructType([T.StructField("timeline", kind), *[T.StructField(c, T.LongType()) for c in ("part", "enter", "leave")], T.StructField("gain", T.DoubleType()), T.StructField("matches", T.LongType()), T.StructField("place", T.LongType())])
    border = T.StructType(tables.fields[:4])
    order = ["timeline", "part", "media", "at", "step_order", "step", "score"]

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(_transfers(batches, threshold), tables)

    def chained(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_written([_chain(table)], border)), schema=to_arrow_schema(border))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(_solved(batches, threshold), schema)

    found = by_segment(segments).select(*order, "orders").mapInArrow(gains, tables)
    borders = saved(found.groupBy("timeline").applyInArrow(chained, border))  # a row a segment
    mine = borders.select(F.col("timeline").alias("__t"), F.col("part").alias("__p"), "enter", "leave")
    bound = segments.join(F.broadcast(mine), same & (F.col("part") == F.col("__p"))).drop("__t", "__p", "orders")
    return by_segment(short.unionByName(bound)).select(*order, "enter", "leave").mapInArrow(solved, schema)


def _written(found, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that a generator of lists gives."""
    arrow = to_arrow_schema(schema)
    for rows in found:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], names=schema.names)


class _Solver:
    """The best assignments of a segment's media, in order of time, from one step order before it.

    A state: highest step order -> (gain, matches, last choice); a choice: (medium, order or none, step, score, choice before).
    """

    def __init__(self, threshold: float, enter: int):
        self.threshold, self.states = threshold, {enter: (0.0, 0, None)}
        self.group = self.at = self.medium = self.pending = None

    def close(self) -> None:
        if self.group is not None:
            self.states = {}
            for (_, high), value in self.group.items():
                if high not in self.states or _better(value, self.states[high]):
                    self.states[high] = value
            self.group = None

    def add(self, medium, at, order, step, score) -> None:
        if self.group is None or at != self.at:
            self.close()
            self.group = {(low, low): v for low, v in self.states.items()}  # (bound by earlier times, highest now)
            self.at, self.medium = at, None
        if medium != self.medium:
            self.pending, self.medium = self.group, medium
            self.group = {key: (gain, n, (medium, _NONE, None, None, path)) for key, (gain, n, path) in self.pending.items()}
        if score is not None and score >= self.threshold:
            for (low, high), (gain, n, path) in self.pending.items():
                if order >= low:
                    key, value = (low, max(high, order)), (gain + score - self.threshold, n + 1, (medium, order, step, score, path))
                    if key not in self.group or _better(value, self.group[key]):
                        self.group[key] = value


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _solved(batches: Iterator[pa.RecordBatch], threshold: float):
    """About 10,000 choices at once, of rows sorted by timeline, segment, time and medium, with the segment's enter and leave.

    leave is null for a timeline of one segment, which ends where it is best.
    """
    out, now, solver, leave = [], object(), None, None

    def end() -> None:
        if solver is None:
            return
        solver.close()
        best = solver.states[leave] if leave is not None else None
        for value in solver.states.values() if leave is None else ():
            if best is None or _better(value, best):
                best = value
        chosen, back = [], best[2]
        while back is not None:
            if back[2] is not None:
                chosen.append((now[0], back[0], back[2], back[3]))
            back = back[4]
        out.extend(reversed(chosen))

    for name, part, medium, at, order, step, score, enter, beyond in _rows(batches):
        if (name, part) != now:
            end()
            if len(out) > 10_000:
                yield out
                out = []
            now, leave, solver = (name, part), beyond, _Solver(threshold, enter)
        solver.add(medium, at, order, step, score)
    end()
    yield out


def _transfers(batches: Iterator[pa.RecordBatch], threshold: float):
    """(timeline, segment, enter, leave, gain, matches, place): for every order before a segment its gains on the way to those behind
    it; place tells the ways from one order apart, the lexicographically smallest first."""
    now, solvers = object(), {}

    def table() -> list[tuple]:
        out = []
        for enter, solver in solvers.items():
            solver.close()
            ways = sorted(solver.states.items(), key=cmp_to_key(lambda a, b: -1 if _smaller(a[1][2], b[1][2]) else 1))
            out += [(*now, enter, leave, gain, n, place) for place, (leave, (gain, n, _)) in enumerate(ways)]
        return out

    for name, part, medium, at, order, step, score, orders in _rows(batches):
        if (name, part) != now:
            yield table()
            now, solvers = (name, part), {enter: _Solver(threshold, enter) for enter in orders}
        for solver in solvers.values():
            solver.add(medium, at, order, step, score)
    yield table()


def _chain(table: pa.Table) -> list[tuple]:
    """(timeline, segment, enter, leave) of the best way through all segments of one timeline."""
    steps: dict[int, dict[int, list[tuple]]] = {}
    name = None
    for name, part, enter, leave, gain, n, place in _rows(table.to_batches()):
        steps.setdefault(part, {}).setdefault(enter, []).append((leave, gain, n, place))
    # a state: order -> (gain, matches, place among all ways so far)
    states, back = {-1: (0.0, 0, 0)}, []
    for part in sorted(steps):
        best: dict[int, tuple] = {}
        for enter, (gain, n, place) in states.items():
            for leave, more, matches, within in steps[part][enter]:
                value = (gain + more, n + matches, (place, within), enter)
                if leave not in best or _ahead(value, best[leave]):
                    best[leave] = value
        places = {p: i for i, p in enumerate(sorted(v[2] for v in best.values()))}
        states = {leave: (v[0], v[1], places[v[2]]) for leave, v in best.items()}
        back.append((part, {leave: v[3] for leave, v in best.items()}))
    at = None
    for order, value in states.items():
        if at is None or _ahead(value, states[at]):
            at = order
    out = []
    for part, enters in reversed(back):
        out.append((name, part, enters[at], at))
        at = enters[at]
    return out


def _ahead(a, b) -> bool:
    """More gain, or more matches, or the smaller place."""
    if abs(a[0] - b[0]) > 1e-12:
        return a[0] > b[0]
    return (-a[1], a[2]) < (-b[1], b[2])


_NONE = float("inf")


def _better(a, b) -> bool:
    if abs(a[0] - b[0]) > 1e-12:
        return a[0] > b[0]
    return _smaller(a[2], b[2]) if a[1] == b[1] else a[1] > b[1]


def _smaller(x, y) -> bool:
    """The orders of one way are lexicographically before another's: back to what both share, the earliest difference decides."""
    smaller = False
    while x is not y:
        if x[1] != y[1]:
            smaller = x[1] < y[1]
        x, y = x[4], y[4]
    return smaller


def not_increasing(frames: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """Frames whose time does not lie after the frame before."""
    from .evidence import linked

    return linked(frames, [key], at, F.col(order)).where(F.col("previous") >= F.col(at))
