"""Points against routes, crossing paths, alignment of tracks and conflicts between trajectories."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import side
from ..session import cut
from .ordered import Ordered, names, null_safe_join

LEAST_BLOCK = 64        # route points in the smallest block of a route
FAN = 32                # boxes inside of a box of the next level
FIRST_LEGS = 256        # legs of a path that are tried first for a crossing


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _around(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    """The box around points or boxes, as aggregates."""
    return [F.min(x0).alias("__x0"), F.max(x1).alias("__x1"), F.min(y0).alias("__y0"), F.max(y1).alias("__y1")]


def _levels(points: int, fan: int) -> int:
    """How many levels of boxes stand over the blocks of a route of so many points, beyond the first."""
    rows = max(LEAST_BLOCK, math.ceil(math.sqrt(points)))
    strips = math.ceil(math.sqrt(max(1, math.ceil(points / rows))))
    blocks, levels = strips * (math.ceil(points / strips / rows) + 1), 0
    while blocks > fan ** (levels + 1):
        levels += 1
    return levels


def nearest_point(points: DataFrame, route: DataFrame, by, *, place: str, x: str = "x", y: str = "y",
                  trim_ends: bool = False, fan: int = FAN) -> DataFrame:
    """Points with the nearest route point of their entity (near_<place>, near_x, near_y, near_d).

    Equal distances go to the lower place. Points without a coordinate stay, with nulls; route points
    without one are no candidates; points of an entity without a route are left out. `trim_ends` blanks
    the match at the first and last route point, where the recording has not reached or has left the route.

    A route lies in blocks of about the root of its length, made of points that lie together; `fan` blocks that are neighbours
    have a box around them, and so on, until a route has no more than `fan` boxes. A point goes down these levels, from
    boxes that may hold its nearest point to the boxes inside them, and is compared with the points of those blocks only that are
    left. A row carries `fan` boxes at most, and neither a row nor a task has a whole long route. Equal points are looked up once.
    """
    keys = names(by)
    at = [*keys, x, y]
    known = route.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, place, x, y)
    ends = route.groupBy(*keys).agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    # strips by x, blocks by y inside of a strip: boxes are small however the route winds
    block_rows = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("__size")))
    strips = F.ceil(F.sqrt(F.ceil(F.col("__size") / block_rows)))
    across_x = null_safe_join(Ordered.of(known, by, x, [y, place]).number("__nx").df, sizes, keys)
    strip = across_x.withColumn("__strip", F.floor((F.col("__nx") - 1) * strips / F.col("__size")))
    numbered = Ordered.of(strip, [*keys, "__strip"], y, [x, place]).number("__ny").df
    per_strip = F.ceil(F.ceil(F.col("__size") / strips) / block_rows) + 1
    block = F.col("__strip") * per_strip + F.floor((F.col("__ny") - 1) / block_rows)
    blocks = numbered.withColumn("__id", block.cast("long")).groupBy(*keys, "__id").agg(F.collect_list(F.struct(place, x, y)).alias("__part"), *_around(x, y, x, y))
    levels = _levels(sizes.agg(F.max("__size")).first()[0] or 0, fan)
    blocks = cut(blocks) if levels else blocks
    outside = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    across = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    reach = lambda f: lambda b: F.hypot(f(F.col(x), b["__x0"], b["__x1"]), f(F.col(y), b["__y0"], b["__y1"]))
    near = F.explode(F.transform(F.filter("__boxes", lambda b: reach(outside)(b) <= F.col("__bound") * (1 + 1e-9) + 1e-9), lambda b: b["__id"]))

    def boxes(level: int, within: Column | None) -> DataFrame:
        """The boxes of a level, by the box of the next level that they are in."""
        ids = blocks.withColumn("__id", F.floor(F.col("__id") / F.lit(fan ** level)))
        own = ids.groupBy(*keys, "__id").agg(*_around("__x0", "__y0", "__x1", "__y1"))
        parent = [] if within is None else [within.alias("__in")]
        return own.groupBy(*keys, *parent).agg(F.collect_list(F.struct("__id", "__x0", "__x1", "__y0", "__y1")).alias("__boxes"))

    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*at).distinct()
    tried = null_safe_join(spots, boxes(levels, None), keys).withColumn("__bound", F.array_min(F.transform("__boxes", reach(across))))
    tried = tried.select(*at, "__bound", near.alias("__id"))
    for level in reversed(range(levels)):
        inner = boxes(level, F.floor(F.col("__id") / F.lit(fan)))
        met = null_safe_join(tried.withColumnRenamed("__id", "__in"), inner, [*keys, "__in"])
        best = F.min(F.array_min(F.transform("__boxes", reach(across)))).over(Window.partitionBy(*at))
        tried = met.withColumn("__bound", F.least("__bound", best)).select(*at, "__bound", near.alias("__id"))
    held = null_safe_join(tried.drop("__bound"), blocks.select(*keys, "__id", "__part"), [*keys, "__id"])
    gap = lambda p: F.hypot(p[x] - F.col(x), p[y] - F.col(y))
    best = F.array_min(F.transform("__part", lambda p: F.struct(gap(p).alias("d"), p[place].alias("p"), p[x].alias("x"), p[y].alias("y"))))
    found = held.groupBy(*at).agg(F.min(best).alias("__b"))
    out = null_safe_join(null_safe_join(points, ends, keys), found, at, "left")
    if trim_ends:
        inner = (F.col("__b.p") != F.col("__first")) & (F.col("__b.p") != F.col("__last"))
        out = out.withColumn("__b", F.when(inner, F.col("__b")))
    return out.select(*points.columns, F.col("__b.p").alias(f"near_{place}"), F.col("__b.x").alias("near_x"),
                      F.col("__b.y").alias("near_y"), F.col("__b.d").alias("near_d"))


def cross_track(points: DataFrame, route: DataFrame, by, t: str, *, place: str, tie=(), min_step: float = 0.0) -> DataFrame:
    """Signed distance to the route (positive to its left) and distance travelled along it.

    Points that moved less than min_step since the last one, or whose nearest route point is an end
    of the route, are left out.
    """
    keys = names(by)
    o = Ordered.of(points, by, t, tie).prev(__px="x", __py="y")
    step = F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py"))
    moved = o.df.where(step >= min_step).drop("__px", "__py")
    around = Ordered.of(route, by, place).prev(__ax="x", __ay="y").next(__bx="x", __by="y").df
    near = nearest_point(moved, route, by, place=place, trim_ends=True).where(F.col(f"near_{place}").isNotNull())
    legs = around.select(*keys, F.col(place).alias(f"near_{place}"), "__ax", "__ay", "__bx", "__by")
    placed = near.join(legs, [*keys, f"near_{place}"])
    left = side(F.col("__ax"), F.col("__ay"), F.col("__bx"), F.col("__by"), F.col("x"), F.col("y")) > 0
    placed = placed.withColumn("deviation", F.when(left, F.col("near_d")).otherwise(-F.col("near_d")))
    o = Ordered.of(placed.drop("__ax", "__ay", "__bx", "__by"), by, t, tie).prev(__nx="near_x", __ny="near_y")
    along = F.coalesce(F.hypot(F.col("near_x") - F.col("__nx"), F.col("near_y") - F.col("__ny")), F.lit(0.0))
    return o.with_columns(__s=along).running(along=("sum", "__s")).df.drop("__s", "__nx", "__ny")


def densify(route: DataFrame, by, place: str, samples: int) -> DataFrame:
    """Inner samples of every leg of a polyline: by, place of the leg's end, sample, x, y."""
    o = Ordered.of(route, by, place).prev(__px="x", __py="y")
    legs = o.df.where(F.col("__px").isNotNull())
    legs = legs.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples - 2))))
    share = F.col("sample") / F.lit(samples - 1.0)
    return legs.select(*names(by), place, "sample", ((1 - share) * F.col("__px") + share * F.col("x")).alias("x"),
                       ((1 - share) * F.col("__py") + share * F.col("y")).alias("y"))


def segments(path: DataFrame, by, t: str, tie=()) -> DataFrame:
    """Legs of a path with both ends and times; legs without motion are dropped (they add no point)."""
    o = Ordered.of(path, by, t, tie).next(x2="x", y2="y", t2=t)
    legs = o.df.where(F.col("x2").isNotNull() & ((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))))
    return legs.select(*names(by), F.col(t).alias("t1"), "t2", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def along_line(df: DataFrame, u1: Column, v1: Column, u2: Column, v2: Column, size_u: Column, size_v: Column, cu: str, cv: str) -> DataFrame:
    """Rows of line pieces from (u1, v1) to (u2, v2), once for each grid cell on the line.

    A piece gets the cells of each column of the grid between its ends, not those of its whole box. Cells
    that the line touches within rounding are included.
    """
    slope = F.coalesce(F.try_divide(v2 - v1, u2 - u1), F.lit(0.0))
    spread = df.withColumn(cu, F.explode(_cells(F.least(u1, u2) - size_u * 1e-9, F.greatest(u1, u2) + size_u * 1e-9, size_u)))
    clip = lambda u: F.greatest(F.least(u, F.greatest(u1, u2)), F.least(u1, u2))
    at = lambda u: F.when(u1 == u2, v1).otherwise(v1 + (clip(u) - u1) * slope)
    low, high = F.col(cu) * size_u, (F.col(cu) + 1) * size_u
    far = F.when(u1 == u2, v2).otherwise(at(high))
    margin = size_v * 1e-9 + F.greatest(F.abs(v1), F.abs(v2)) * 1e-12
    return spread.withColumn(cv, F.explode(_cells(F.least(at(low), far) - margin, F.greatest(at(low), far) + margin, size_v)))


def _celled(legs: DataFrame, keys: list[str], cell: float, tag: str) -> DataFrame:
    size = F.lit(float(cell))
    known = legs.where(F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("y2").isNotNull())
    c = {k: F.col(k).cast("double") for k in ("x1", "y1", "x2", "y2")}
    legs = along_line(known, c["x1"], c["y1"], c["x2"], c["y2"], size, size, "__cx", "__cy")
    return legs.select(*keys, "__cx", "__cy", *[F.col(n).alias(f"{tag}{n}") for n in ("t1", "t2", "x1", "y1", "x2", "y2")])


def _crossings(legs_a: DataFrame, legs_b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Crossing points of two sets of legs. Legs meet in the grid cells on their lines; a crossing counts
    in the cell that holds it, or one beside it where it is on the border. A leg has a row for each of its cells, which
    its size does not tell, so neither side is broadcast."""
    pairs = null_safe_join(_celled(legs_a, keys, cell, "a").hint("merge"), _celled(legs_b, keys, cell, "b"), [*keys, "__cx", "__cy"])
    rx, ry = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1")
    sx, sy = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    qx, qy = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    turn = rx * sy - ry * sx
    pairs = pairs.withColumn("__u", F.try_divide(qx * sy - qy * sx, turn)).withColumn("__v", F.try_divide(qx * ry - qy * rx, turn))
    hit = pairs.where(F.col("__u").between(0, 1) & F.col("__v").between(0, 1))
    return hit.select(
        *keys, (F.col("ax1") + F.col("__u") * rx).alias("x"), (F.col("ay1") + F.col("__u") * ry).alias("y"),
        (F.col("at1") + F.col("__u") * (F.col("at2") - F.col("at1"))).alias("t_a"),
        (F.col("bt1") + F.col("__v") * (F.col("bt2") - F.col("bt1"))).alias("t_b"))


def conflict_point(path_a, path_b, by, t: str, cell: float, tie=()) -> DataFrame:
    """The first crossing along the first path, per entity: by, t_a, t_b, x, y.

    The first path is tried piece by piece from its start, each piece eight times as long as the one before,
    and an entity is done at its first hit. So long paths never meet leg by leg as a whole. Each piece is a written table;
    a path of up to `FIRST_LEGS` legs is one piece.
    """
    keys = names(by)
    todo = cut(Ordered.of(segments(path_a, by, t, tie), by, "t1", ["x1", "y1", "x2", "y2"]).number("__n").df)
    legs_b = segments(path_b, by, t, tie)
    longest = todo.agg(F.max("__n")).first()[0] or 0
    begin, size, done = 0, FIRST_LEGS, None
    while True:
        piece = todo.where((F.col("__n") > begin) & (F.col("__n") <= begin + size)).drop("__n")
        found = _crossings(piece, legs_b, keys, cell)
        hits = found.groupBy(*keys).agg(F.min(F.struct("t_a", "t_b", "x", "y")).alias("__c")).select(*keys, "__c.*")
        begin, size = begin + size, size * 8
        if begin >= longest:
            return hits if done is None else done.unionByName(hits)
        hits = cut(hits)
        done = hits if done is None else done.unionByName(hits)
        todo = without(todo, hits, keys)
        legs_b = without(legs_b, hits, keys)


def without(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of entities that are not in `found`; null keys are equal."""
    marked = null_safe_join(rows, found.select(*keys, F.lit(True).alias("__found")), keys, "left")
    return marked.where(F.col("__found").isNull()).drop("__found")


def offset_search(ref: DataFrame, sensor: DataFrame, by, idx: str, error, search: int | None = None) -> DataFrame:
    """Mean error of the sensor track laid over the reference at every row offset, and the best one.

    Offsets run from 0 to where the shorter sensor track ends inside the reference; `search` limits them for a caller who
    knows that the tracks begin together. `error(ref column, sensor column)` takes two functions from name to Column.
    Errors are summed per offset before they are shuffled.
    """
    keys = names(by)
    n_ref = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr"))
    n_sensor = sensor.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ns"))
    free = F.col("__nr") - F.col("__ns")
    room = null_safe_join(n_ref, n_sensor, keys).select(*keys, (free if search is None else F.least(F.lit(search), free)).alias("__room"))
    moved = null_safe_join(sensor, room.where("__room > 0"), keys).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("__room") - 1)))
    moved = moved.select(*keys, "offset", (F.col(idx) + F.col("offset")).alias("__i"),
                         *[F.col(c).alias(f"__s_{c}") for c in sensor.columns if c not in keys])
    laid = null_safe_join(moved, ref.withColumn("__i", F.col(idx)), [*keys, "__i"])
    errors = laid.groupBy(*keys, "offset").agg(F.avg(error(F.col, lambda c: F.col(f"__s_{c}"))).alias("error"))
    return errors.groupBy(*keys).agg(F.min(F.struct("error", "offset")).alias("__b")).select(
        *keys, F.col("__b.offset").cast("long").alias("offset"), F.col("__b.error").alias("error"))


def _distance(a, b) -> Column:
    return F.hypot(a("x") - b("x"), a("y") - b("y"))


def offset_room(ref: DataFrame, sensor: DataFrame, by, search: int | None = None) -> DataFrame:
    """by, n, room: the sensor track's rows and how many row offsets it has inside the reference, where there is one."""
    keys = names(by)
    n_ref = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr"))
    n_sensor = sensor.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    free = F.col("__nr") - F.col("n")
    room = null_safe_join(n_ref, n_sensor, keys).select(*keys, "n", (free if search is None else F.least(F.lit(search).cast("long"), free)).alias("room"))
    return room.where("room > 0")


TILE = 1024     # sensor rows and offsets that one tile takes


class Tiles:
    """Sensor rows against the reference rows that some offsets lay them on, a row for each part of the track and of the offsets.

    A tile holds up to `side` sensor rows and the twice as many reference rows they meet at up to `side` offsets, in arrays,
    with the reference's running sums. So the rows of a track are dealt out once for every `side` offsets, not once for each.
    """

    def __init__(self, ref: DataFrame, sensor: DataFrame, by, idx: str, search: int | None, blocks: tuple[int, ...]):
        self.keys, self.blocks = names(by), blocks
        unit = math.lcm(*blocks)
        self.side = side = unit * max(1, TILE // unit)
        room = offset_room(ref, sensor, by, search)
        gone = (F.col("x").isNull() | F.col("y").isNull()).cast("long")
        sums = Ordered.of(ref.select(*self.keys, idx, "x", "y").withColumn("__gone", gone), by, idx).running(
            __px=("sum", "x"), __py=("sum", "y"), __pn=("sum", "__gone")).df
        place = (F.col(idx) - 1).cast("long")
        part = F.floor(F.col("__p") / F.lit(side))
        parts, rooms = F.ceil(F.col("n") / F.lit(side)), F.ceil(F.col("room") / F.lit(side))
        laid = null_safe_join(sensor.select(*self.keys, place.alias("__p"), "x", "y"), room, self.keys)
        laid = laid.withColumn("__w", F.explode(F.sequence(F.lit(0).cast("long"), rooms - 1))).select(
            *self.keys, "n", "room", "__w", part.alias("__k"), F.struct((F.col("__p") % side).alias("j"), "x", "y").alias("__s"))
        # a tile begins with the row before its first, for the difference of running sums
        under = null_safe_join(sums.select(*self.keys, place.alias("__p"), "x", "y", "__px", "__py", "__pn"), room, self.keys)
        begins = F.array_compact(F.array(part - 1, part, F.when(F.col("__p") % side == side - 1, part + 1)))
        under = under.withColumn("__a", F.explode(begins)).where((F.col("__a") >= 0) & (F.col("__a") <= parts + rooms - 2))
        under = under.withColumn("__k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__a") - rooms + 1), F.least(parts - 1, F.col("__a"))))).select(
            *self.keys, "n", "room", (F.col("__a") - F.col("__k")).alias("__w"), "__k",
            F.struct((F.col("__p") - F.col("__a") * side).alias("j"), "x", "y", F.coalesce("__px", F.lit(0.0)).alias("px"),
                     F.coalesce("__py", F.lit(0.0)).alias("py"), F.col("__pn").alias("pn")).alias("__r"))
        both = laid.unionByName(under, allowMissingColumns=True)
        self.df = cut(both.groupBy(*self.keys, "__w", "__k", "n", "room").agg(
            F.sort_array(F.collect_list("__s")).alias("__s"), F.sort_array(F.collect_list("__r")).alias("__r")))

    def at(self, offsets: DataFrame | None) -> DataFrame:
        """The tiles with the offsets that are asked for, all where none are named, as `__d` from the tile's first."""
        if offsets is None:
            here = F.sequence(F.lit(0).cast("long"), F.least(F.lit(self.side).cast("long"), F.col("room") - F.col("__w") * self.side) - 1)
            return self.df.withColumn("__ds", here)
        own = offsets.select(*self.keys, F.floor(F.col("offset") / F.lit(self.side)).alias("__w"), (F.col("offset") % self.side).alias("__d"))
        return null_safe_join(self.df, own.groupBy(*self.keys, "__w").agg(F.collect_list("__d").alias("__ds")), [*self.keys, "__w"])

    def _met(self, row) -> Column:
        """The reference row at a place in the tile."""
        return F.get("__r", (row + F.col("__d") - F.col("__r")[0]["j"]).cast("int"))

    def errors(self, offsets: DataFrame) -> DataFrame:
        """by, offset, error: the mean distance of the sensor track at the offsets given."""
        rows = self.at(offsets).withColumn("__d", F.explode("__ds")).withColumn("__e", F.explode("__s"))
        rows = rows.select(*self.keys, (F.col("__w") * self.side + F.col("__d")).alias("offset"), "__e", self._met(F.col("__e.j")).alias("__m")).where("__m is not null")
        return rows.groupBy(*self.keys, "offset").agg(F.avg(F.hypot(F.col("__m.x") - F.col("__e.x"), F.col("__m.y") - F.col("__e.y"))).alias("error"))

    def bounds(self, offsets: DataFrame | None, size: int) -> DataFrame:
        """by, offset, n, least: what the mean distance at an offset is not under, from sums of `size` rows."""
        total = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda a, e: a + F.coalesce(of(e), F.lit(0.0)))
        lost = lambda rows: F.exists(rows, lambda e: e["x"].isNull() | e["y"].isNull())
        block = lambda rows: F.struct(total(rows, lambda e: e["x"].cast("double")).alias("x"), total(rows, lambda e: e["y"].cast("double")).alias("y"),
                                      rows[0]["j"].alias("lo"), F.element_at(rows, -1)["j"].alias("hi"), lost(rows).alias("lost"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__s") - 1) / F.lit(size)).cast("int")),
                             lambda m: block(F.slice("__s", m * F.lit(size) + 1, F.lit(size))))
        rows = self.at(offsets).withColumn("__b", blocks).drop("__s")
        rows = rows.withColumn("__d", F.explode("__ds")).withColumn("__e", F.explode("__b"))
        rows = rows.select(*self.keys, "n", (F.col("__w") * self.side + F.col("__d")).alias("offset"), "__e",
                           self._met(F.col("__e.hi")).alias("__last"), self._met(F.col("__e.lo") - 1).alias("__before"))
        between = lambda c: F.col(f"__last.{c}") - F.coalesce(F.col(f"__before.{c}"), F.lit(0))
        far = F.hypot(F.col("__e.x") - between("px"), F.col("__e.y") - between("py"))
        far = F.when(~F.col("__e.lost") & (between("pn") == 0), far).otherwise(0.0)
        return rows.groupBy(*self.keys, "offset", "n").agg((F.sum(far) / F.col("n")).alias("least"))

    def candidates(self) -> DataFrame:
        """by, offset, n: the offsets that can have the least mean distance."""
        left = None
        for size in self.blocks:
            bound = cut(self.bounds(left, size))
            likely = bound.groupBy(*self.keys).agg(F.min(F.struct("least", "offset"))["offset"].alias("offset"))
            reached = self.errors(likely).select(*self.keys, "error")
            left = cut(null_safe_join(bound, reached, self.keys).where(
                F.col("error").isNull() | (F.col("least") <= F.col("error") * (1 + 1e-9) + 1e-9)).select(*self.keys, "offset", "n"))
        return left


def offset_candidates(ref: DataFrame, sensor: DataFrame, by, idx: str, search: int | None = None, blocks: tuple[int, ...] = (64, 8)) -> DataFrame:
    """by, offset: the offsets that can have the least mean distance.

    The distance of two block sums is at most the sum of the distances of the blocks' rows. Sums of sensor blocks against
    sums of the reference, which are differences of its running sums, so bound the error of an offset from below with a term per block in
    place of one per row; what the best of them really has bounds the least error from above. Offsets bounded beyond that go, and the
    rest is tried with finer blocks. Rows are numbered from 1 without holes; a block with a row without place bounds nothing.
    """
    return Tiles(ref, sensor, by, idx, search, blocks).candidates()


def track_offset(ref: DataFrame, sensor: DataFrame, by, idx: str, search: int | None = None, blocks: tuple[int, ...] = (64, 8)) -> DataFrame:
    """by, offset, error: the row offset at which a sensor track with x and y has the least mean distance from a reference track.

    The answer of `offset_search` for the distance in the plane; only the offsets that block sums leave over are laid out row by row.
    """
    keys, tiles = names(by), Tiles(ref, sensor, by, idx, search, blocks)
    errors = tiles.errors(tiles.candidates())
    return errors.groupBy(*keys).agg(F.min(F.struct("error", "offset")).alias("__b")).select(*keys, F.col("__b.offset").alias("offset"), F.col("__b.error").alias("error"))


def danger_times(own: DataFrame, other: DataFrame, by, t: str, radius: float, tie=()) -> DataFrame:
    """For own path points, the times when the other track is closer than `radius`: own columns, t_from, t_to.

    The other track is linear between its rows; a standstill is one leg, however many rows it has. Points
    meet only the legs in nearby grid cells.
    """
    keys = names(by)
    o = Ordered.of(other, by, t, tie).prev(__x0="x", __y0="y").next(__x2="x", __y2="y")
    rests = (F.col("x") == F.col("__x0")) & (F.col("y") == F.col("__y0")) & (F.col("x") == F.col("__x2")) & (F.col("y") == F.col("__y2"))
    corners = o.where(~F.coalesce(rests, F.lit(False)))
    o = corners.next(__x2="x", __y2="y", __t2=t)
    legs = o.df.where((F.col("__t2") > F.col(t)) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("__x2").isNotNull() & F.col("__y2").isNotNull())
    reach, size = F.lit(float(radius)), F.lit(2.0 * radius)
    legs = legs.select(*keys, F.col("x").alias("__x1"), F.col("y").alias("__y1"), F.col(t).alias("__t1"), "__x2", "__y2", "__t2")
    # the cells on the line and those around them hold all points closer than the radius
    lined = along_line(legs, *[F.col(c).cast("double") for c in ("__x1", "__y1", "__x2", "__y2")], size, size, "__lx", "__ly")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    legs = lined.withColumn("__dx", around).withColumn("__dy", around)
    legs = legs.select(*keys, "__x1", "__y1", "__t1", "__x2", "__y2", "__t2", (F.col("__lx") + F.col("__dx")).alias("__cx"),
                       (F.col("__ly") + F.col("__dy")).alias("__cy")).distinct()
    here = own.where("x is not null and y is not null").withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
    pairs = null_safe_join(here, legs, [*keys, "__cx", "__cy"])
    px, py = F.col("__x1") - F.col("x"), F.col("__y1") - F.col("y")
    vx, vy = F.col("__x2") - F.col("__x1"), F.col("__y2") - F.col("__y1")
    a, b, c = vx * vx + vy * vy, 2 * (px * vx + py * vy), px * px + py * py - reach * reach
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    still = a == 0
    u0 = F.when(still, F.lit(0.0)).otherwise(F.try_divide(-b - root, 2 * a))
    u1 = F.when(still, F.lit(1.0)).otherwise(F.try_divide(-b + root, 2 * a))
    hit = F.when(still, c < 0).otherwise(b * b - 4 * a * c > 0)
    near = pairs.where(hit).withColumns({"__u0": F.greatest(u0, F.lit(0.0)), "__u1": F.least(u1, F.lit(1.0))})
    near = near.where(F.col("__u0") < F.col("__u1"))
    at = lambda u: F.col("__t1") + F.col(u) * (F.col("__t2") - F.col("__t1"))
    return near.select(*own.columns, at("__u0").alias("t_from"), at("__u1").alias("t_to"))


def conflict_scan(own: DataFrame, other: DataFrame, by, t: str, radius: float, horizon: float | None = None, *, unit: float = 1000.0,
                  tie=(), still: float = 0.01) -> DataFrame:
    """Time to collision of every own row (null when there is none, or none within a horizon if one is given).

    The vehicle keeps the speed `v` of the row along its own later path; a conflict is the first later
    path point at which it would arrive while the other track is closer than `radius`. A standing
    vehicle conflicts (0) when the other one is that close at that moment, which is one interpolation
    per row. Points without motion are no path points, so a parked vehicle adds none.

    In the plane of way and time a danger is an upright piece (a path point and the times when the other
    track is close), and a moving row is a straight line from its own place with the slope of its speed. Both
    meet in the cells of a grid over the dangers of the entity: a line is walked cell by cell, so a row
    is compared with the dangers on its line only. The grid has at most 64 columns, fewer for few dangers.
    """
    from .trajectory import interpolate_at

    keys = names(by)
    o = Ordered.of(own, by, t, tie).prev(__px="x", __py="y")
    step = F.coalesce(F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py")), F.lit(0.0))
    path = o.with_columns(__step=step).running(__s=("sum", "__step")).number("__i").df.drop("__px", "__py")
    points = path.where("__step > 0").select(*keys, "x", "y", "__s", "__i")
    danger = danger_times(points, other, by, t, radius, tie).select(*keys, F.col("__s").alias("__sj"), F.col("__i").alias("__j"), "t_from", "t_to")
    extent = danger.groupBy(*keys).agg(
        F.min("__sj").alias("__s0"), F.max("__sj").alias("__s1"), F.min("t_from").alias("__t0"), F.max("t_to").alias("__t1"),
        F.least(F.lit(64), F.ceil(F.sqrt(F.count(F.lit(1))) / 4)).alias("__cells"))
    wide = lambda low, high: F.greatest((F.col(high) - F.col(low)) / F.col("__cells"), F.lit(1e-6))
    grid = extent.select(*keys, "__s0", "__s1", "__t0", "__t1", wide("__s0", "__s1").alias("__ds"), wide("__t0", "__t1").cast("double").alias("__dt"))
    sized = null_safe_join(danger, grid, keys)
    spots = sized.withColumn("__cs", F.floor((F.col("__sj") - F.col("__s0")) / F.col("__ds"))).withColumn(
        "__ct", F.explode(_cells(F.col("t_from") - F.col("__t0"), F.col("t_to") - F.col("__t0"), F.col("__dt"))))
    moves = null_safe_join(path.where((F.col("v") >= still) & F.col(t).isNotNull()).select(*keys, t, "v", "__s", "__i"), grid, keys)
    when = lambda s: F.col(t) + (s - F.col("__s")) / F.col("v") * F.lit(unit)
    # the line from the row, or from where the dangers begin, to the last danger in way and time
    begin = F.greatest(F.col("__s"), F.col("__s0"), F.col("__s") + (F.col("__t0") - F.col(t)) * F.col("v") / F.lit(unit))
    end = F.least(F.col("__s1"), F.col("__s") + (F.col("__t1") - F.col(t)) * F.col("v") / F.lit(unit))
    if horizon is not None:
        end = F.least(end, F.col("__s") + F.lit(horizon / unit) * F.col("v"))
    lines = moves.withColumn("__b", begin).withColumn("__e", end).where("__b <= __e * (1 + 1e-12) + 1e-9").withColumn("__e", F.greatest("__b", "__e"))
    lined = along_line(lines, F.col("__b") - F.col("__s0"), when(F.col("__b")) - F.col("__t0"), F.col("__e") - F.col("__s0"), when(F.col("__e")) - F.col("__t0"),
                       F.col("__ds"), F.col("__dt"), "__cs", "__ct")
    met = null_safe_join(lined.select(*keys, t, "v", "__s", "__i", "__cs", "__ct"), spots.select(*keys, "__sj", "__j", "t_from", "t_to", "__cs", "__ct"), [*keys, "__cs", "__ct"])
    travel = (F.col("__sj") - F.col("__s")) / F.col("v") * F.lit(unit)
    arrives = F.col(t) + travel
    meets = (F.col("__j") > F.col("__i")) & (arrives > F.col("t_from")) & (arrives < F.col("t_to"))
    if horizon is not None:
        meets = meets & (travel <= horizon)
    moving = met.where(meets).select(*keys, "__i", travel.alias("ttc"))
    stands = path.where(F.abs(F.col("v")) < still).select(*keys, t, "__i", F.col("x").alias("__x"), F.col("y").alias("__y"))
    beside = interpolate_at(other, stands, by, t, ["x", "y"], tie=tie)
    close = F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) < radius
    hits = moving.unionByName(beside.where(close).select(*keys, "__i", F.lit(0.0).alias("ttc")))
    first = hits.groupBy(*keys, "__i").agg(F.min("ttc").alias("ttc"))
    return null_safe_join(path, first, [*keys, "__i"], "left").select(*own.columns, "ttc")


def path_driven(visits: DataFrame, edges: DataFrame, by, t: str, tie, node: str) -> DataFrame:
    """Visited nodes turned into steps along graph edges: by, t, src, dst, hops.

    A step between neighbours is one hop; otherwise the shortest way of two or three edges fills it
    (the least node ids when several are equal). Steps with no such way get hops null.
    """
    from .intervals import change_points

    keys = names(by)
    seen = change_points(visits, by, t, tie, F.col(node)).drop("previous")
    o = Ordered.of(seen, by, t, tie).prev(src=node)
    steps = o.df.where(F.col("src").isNotNull()).select(*keys, t, "src", F.col(node).alias("dst"))
    wanted = steps.select("src", "dst").distinct()
    e = edges.select("src", "dst").distinct()
    e1 = e.select(F.col("src"), F.col("dst").alias("m1"))
    e2 = e.select(F.col("src").alias("m1"), F.col("dst").alias("m2"))
    e3 = e.select(F.col("src").alias("m2"), F.col("dst"))
    one = wanted.join(e, ["src", "dst"], "left_semi").select("src", "dst", F.lit(1).alias("hops"), F.array().cast("array<string>").alias("via"))
    two = wanted.join(e1, "src").join(e2.withColumnRenamed("m2", "dst"), ["m1", "dst"]).select(
        "src", "dst", F.lit(2).alias("hops"), F.array(F.col("m1").cast("string")).alias("via"))
    three = wanted.join(e1, "src").join(e3, "dst").join(e2, ["m1", "m2"], "left_semi").select(
        "src", "dst", F.lit(3).alias("hops"), F.array(F.col("m1").cast("string"), F.col("m2").cast("string")).alias("via"))
    best = one.unionByName(two).unionByName(three).groupBy("src", "dst").agg(
        F.min(F.struct("hops", "via")).alias("__w")).select("src", "dst", F.col("__w.hops").alias("hops"), F.col("__w.via").alias("via"))
    return steps.join(best, ["src", "dst"], "left")


def path_reached(visits: DataFrame, edges: DataFrame, by, t: str, tie, node: str) -> DataFrame:
    """Visited nodes as a way through the graph that waits at branches: by, t, src, dst, hops, via.

    From a node with one way on, the next node counts when it is a neighbour. From a node with several ways on, its
    neighbours and theirs are held back, as the nearest node flickers between the branches there; the first
    visit three edges on tells the branch, and the two nodes before it (the least ids, when several ways are
    equal) are `via`. Other visits are passed over. What a visit can follow is joined to it beforehand, so the scan holds
    one entity's position only.
    """
    from . import sequential
    from .intervals import change_points

    keys = names(by)
    seen = change_points(visits.where(F.col(node).isNotNull()), by, t, tie, F.col(node)).drop("previous").select(*keys, t, *names(tie), F.col(node).alias("__at"))
    e = edges.select("src", "dst").distinct().where("src <> dst")
    nodes = seen.select("__at").distinct()
    one = e.groupBy(F.col("dst").alias("__at")).agg(F.collect_set("src").alias("__from"))
    ways = e.groupBy(F.col("src").alias("__at")).agg(F.count(F.lit(1)).alias("__ways"))
    two = e.select("src", F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), "dst"), "m")
    near = e.unionByName(two.select("src", "dst")).distinct()
    third = two.select("src", "m", F.col("dst").alias("m2")).join(e.select(F.col("src").alias("m2"), "dst"), "m2").where("src <> dst")
    third = third.join(nodes.withColumnRenamed("__at", "dst"), "dst", "left_semi").join(near, ["src", "dst"], "left_anti")
    best = third.groupBy("src", "dst").agg(F.min(F.struct("m", "m2")).alias("w"))
    far = best.groupBy(F.col("dst").alias("__at")).agg(F.to_json(F.collect_list(F.struct(F.col("src").alias("b"), "w.m", "w.m2"))).alias("__far"))
    ready = seen.join(one, "__at", "left").join(ways, "__at", "left").join(far, "__at", "left")
    kind = seen.schema["__at"].dataType.simpleString()
    tie_types = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in [t, *names(tie)])
    rows = ready.withColumn("__from", F.to_json("__from"))
    return sequential.scan(rows, by, t, tie, f"{tie_types}, src {kind}, dst {kind}, hops int, via string",
                           run=_walk, summarise=_walks, enter=_walked, start=None)


def _moves(columns, i: int) -> tuple[list, dict, bool]:
    """Nodes from which the visit is the next one, branches it settles with their ways, whether it is a branch."""
    load = lambda c: json.loads(columns[c][i]) if isinstance(columns[c][i], str) else []
    return load("__from"), {w["b"]: [w["m"], w["m2"]] for w in load("__far")}, columns["__ways"][i] > 1


def _walk(columns, state):
    """The visits that count, from the state (node, whether it is a branch still open)."""
    places, out = [], {"src": [], "dst": [], "hops": [], "via": []}
    at, waits = state if state is not None else (None, False)
    for i, v in enumerate(columns["__at"].tolist()):
        before, far, branch = _moves(columns, i)
        if at is None:
            at, waits = v, branch
            continue
        if waits and at in far or not waits and v != at and at in before:
            places.append(i)
            way = far[at] if waits else []
            for name, value in (("src", at), ("dst", v), ("hops", len(way) + 1), ("via", "-".join(map(str, way)))):
                out[name].append(value)
            at, waits = v, branch and not waits
    return places, {n: np.array(x, dtype=object) for n, x in out.items()}


def _walks(columns) -> str:
    """Where every state ends; states that no visit moves are left out."""
    first, ends = None, {}                              # current state: the states it began as
    for i, v in enumerate(columns["__at"].tolist()):
        before, far, branch = _moves(columns, i)
        if first is None:
            first = json.dumps([v, bool(branch)])
        moved = []
        for state, target in [([p, False], [v, bool(branch)]) for p in before if p != v] + [([b, True], [v, False]) for b in far]:
            name = json.dumps(state)
            moved += [(target, began) for began in [*ends.pop(name, []), *([name] if not any(name in x for x in ends.values()) else [])]]
        for target, began in moved:
            ends.setdefault(json.dumps(target), []).append(began)
    return json.dumps({"ends": {began: end for end, all_ in ends.items() for began in all_}, "first": first})


def _walked(text: str, state):
    maps = json.loads(text)
    if state is None:
        state = json.loads(maps["first"])
    return json.loads(maps["ends"].get(json.dumps(list(state)), json.dumps(list(state))))
