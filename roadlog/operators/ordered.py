"""Event-time order inside an entity, split so that no task holds a hot entity whole.

`Window.partitionBy(entity)` puts an entity into one task. That is right while entities are
recordings of bounded length, and wrong when one of them holds a third of the data. `Ordered`
gives the usual ordered columns (previous row, running total, last known value, row and time
frames) in two ways with equal results:

* no entity is over the row budget: one plain window, one shuffle;
* some entity is over it: the entity's time axis is cut into chunks under the budget, windows
  run per (entity, chunk), and what a chunk needs from its neighbours is taken from a summary of
  one row per chunk, or, for frames, from a few rows copied over the chunk border.

The choice is made from row counts per entity, in one pass over the log. `planned` makes it once for a log and
all operators that are built inside of it. Null entities are one entity, rows without a time stand before all
others of their entity, and both hold whether or not an entity is cut.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
ROWS_CONF, ROWS_DEFAULT = "spark.roadlog.chunkRows", 4_000_000
MARKS = 1000        # quantiles of time that tell how dense an entity is


def names(value: str | Sequence[str] | None) -> list[str]:
    """A column list from one name, several names or nothing."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


_LIMIT: ContextVar[int | None] = ContextVar("limit", default=None)


@contextmanager
def row_limit(rows: int) -> Iterator[None]:
    """Operators built inside take `rows` as the budget of a chunk, whatever the session says."""
    token = _LIMIT.set(rows)
    try:
        yield
    finally:
        _LIMIT.reset(token)


def row_budget(df: DataFrame) -> int:
    return _LIMIT.get() or int(df.sparkSession.conf.get(ROWS_CONF, str(ROWS_DEFAULT)))


def for_python(df: DataFrame, *columns: str) -> DataFrame:
    """Spread groups that go to Python over all shuffle partitions, however small their bytes are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


class Plan:
    """The chunk width of a log, measured when it is first needed."""

    def __init__(self, log: Callable[[], DataFrame], by: Sequence[str], t: str):
        self._log, self.by, self.t = log, list(by), t
        self._found: DataFrame | None = None
        self._width: list[float | None] = []
        self._one = threading.Lock()

    @property
    def log(self) -> DataFrame:
        if self._found is None:
            self._found = self._log()
        return self._found

    def fits(self, df: DataFrame, by: Sequence[str], t: str) -> bool:
        """Whether an operator orders rows of this log: the same time, by the same or by parts of its entities."""
        return t == self.t and set(self.by) <= set(by) and df.schema[t].dataType == self.log.schema[self.t].dataType

    def width(self) -> float | None:
        with self._one:
            if not self._width:
                self._width.append(measure_width(self.log, self.by, self.t, row_budget(self.log)))
            return self._width[0]


_PLANS: ContextVar[tuple[Plan, ...]] = ContextVar("plans", default=())


@contextmanager
def planned(log: Callable[[], DataFrame], by, t: str) -> Iterator[None]:
    """Operators built inside take the chunk width of this log, which is measured once at most.

    `log` has the entities and times of the rows from which all tables used inside are derived without more rows; for
    grids over it see `gridded`.
    """
    token = _PLANS.set((Plan(log, names(by), t), *_PLANS.get()))
    try:
        yield
    finally:
        _PLANS.reset(token)


class Grid(Plan):
    """The chunk width of a grid over the tracks of a log: its rows are as far apart as the grid is wide."""

    def __init__(self, log: Callable[[], DataFrame], by: Sequence[str], t: str, step: float, name: str, unit: float):
        super().__init__(log, by, t)
        self.step, self.name, self.unit = step, name, unit

    def fits(self, df: DataFrame, by: Sequence[str], t: str) -> bool:
        return t == self.name and set(self.by) <= set(by)

    def width(self) -> float | None:
        if not self._width:
            budget = row_budget(self.log)
            spans = self.log.groupBy(*self.by).agg((F.max(self.t) - F.min(self.t)).alias("__span"))
            longest = spans.agg(F.max("__span")).first()[0]
            self._width.append(None if longest is None or longest <= budget * self.step else budget * self.unit)
        return self._width[0]


@contextmanager
def gridded(log: DataFrame, by, t: str, step: float, name: str = "t", unit: float | None = None) -> Iterator[None]:
    """Operators built inside order a grid of `step` over the tracks of a log by the column `name`.

    The grid has more rows than the log, so the log's own width is none for it, and it is not made a second time to be counted: a
    chunk has as many grid points as the budget. `unit` is how far `name` advances from a grid point to the next.
    """
    token = _PLANS.set((Grid(lambda: log, names(by), t, step, name, step if unit is None else unit), *_PLANS.get()))
    try:
        yield
    finally:
        _PLANS.reset(token)


def chunk_width(df: DataFrame, by: Sequence[str], t: str) -> float | None:
    """Width of the time chunks that keep every (entity, chunk) near the row budget; None when nothing is cut.

    The finest chunk is one instant of one entity. The width decides only how work is spread, never a result.
    """
    for plan in _PLANS.get():
        if plan.fits(df, by, t):
            return plan.width()
    return measure_width(df, by, t, row_budget(df))


def measure_width(df: DataFrame, by: Sequence[str], t: str, budget: int) -> float | None:
    """The chunk width: the least time that any budget of rows of an entity takes; None without an entity over it.

    One count per entity tells whether there is such an entity. Only then, quantiles of time of those entities
    show where they are dense.
    """
    rows = df.select(*by, F.col(t).alias("__t")).where(F.col("__t").isNotNull() & ~F.isnan(F.col("__t").cast("double")))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > budget)
    if sizes.isEmpty():
        return None
    shares = F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)])
    hot = null_safe_join(rows, sizes, by).groupBy(*by, "__n").agg(F.percentile_approx("__t", shares, F.lit(20 * MARKS)).alias("__q"))
    step = F.least(F.greatest(F.floor(F.lit(budget * MARKS) / F.col("__n")), F.lit(1)), F.lit(MARKS)).cast("int")
    gaps = F.transform(F.sequence(F.lit(0), F.lit(MARKS) - step), lambda i: F.get("__q", i + step) - F.get("__q", i))
    found = hot.agg(F.min(F.array_min(F.filter(gaps, lambda g: g > 0))).alias("__w"), F.count(F.lit(1)).alias("__hot")).first()
    if not found["__hot"] or found["__w"] is None or not math.isfinite(found["__w"]):
        return None
    whole = df.schema[t].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return max(1, math.floor(found["__w"])) if whole else float(found["__w"])


def chunk_of(t: str, width: float) -> Column:
    """Chunk number of a row, in the order of times: null without a time, the last for a time that is no number."""
    return F.when(F.isnan(F.col(t).cast("double")), F.lit(2**63 - 1)).otherwise(F.floor(F.col(t) / F.lit(width)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the key columns are those of `left`."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


class Ordered:
    """Rows of each entity in (t, tie) order, to which ordered columns are added step by step.

    `tasks` says over how many tasks the chunks of a cut log are dealt, for callers whose entities are never null: what a chunk
    takes from others then joins the rows where they are, without another shuffle.
    """

    def __init__(self, df: DataFrame, by, t: str, tie=(), width: float | None = None, tasks: int | None = None):
        self.by, self.t, self.tie, self.width, self.tasks = names(by), t, names(tie), width, tasks
        if width is not None and CHUNK not in df.columns:
            chunk = chunk_of(t, width)
            df = df.withColumn(CHUNK, chunk if tasks is None else F.coalesce(chunk, F.lit(-(2**63))))
        self._df = df

    @classmethod
    def of(cls, df: DataFrame, by, t: str, tie=()) -> Ordered:
        """Order `df`, cutting hot entities when there are any."""
        return cls(df, by, t, tie, chunk_width(df, names(by), t))

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Row-wise change (columns, filters) that leaves the order columns as they are."""
        return Ordered(change(self._df), self.by, self.t, self.tie, self.width, self.tasks)

    def with_columns(self, **columns: Column) -> Ordered:
        return self.map(lambda df: df.withColumns(columns))

    def where(self, condition: Column) -> Ordered:
        return self.map(lambda df: df.where(condition))

    # -- windows -----------------------------------------------------------------

    @property
    def _part(self) -> list[str]:
        return self.by if self.width is None else [*self.by, CHUNK]

    def _up(self):
        return Window.partitionBy(*self._part).orderBy(self.t, *self.tie)

    def _down(self):
        return Window.partitionBy(*self._part).orderBy(
            F.col(self.t).desc(), *[F.col(c).desc() for c in self.tie]
        )

    def _rank(self) -> Column:
        return F.struct(self.t, *self.tie)

    def _stitch(self, local, totals, carry, combine) -> Ordered:
        """Per-chunk columns, plus what the other chunks of the entity pass on.

        local: window columns inside the chunk. totals: aggregates giving one row per chunk.
        carry: columns over the chunk rows of an entity. combine: final columns from both.
        """
        part = self._part
        chunks = self._df.groupBy(*part).agg(*[c.alias(n) for n, c in totals.items()])
        chunks = chunks.select(*part, *[c.alias(n) for n, c in carry.items()])
        if self.tasks is None:
            body = null_safe_join(self._df.withColumns(local), chunks, part, "left")
        else:
            body = self._df.repartition(self.tasks, *part).withColumns(local).join(chunks, part, "left")
        body = body.withColumns(combine)
        keep = [c for c in self._df.columns if c not in combine]
        return self.map(lambda _: body.select(*keep, *combine))

    def _neighbour(self, step: int, columns) -> Ordered:
        values = F.struct(*[as_column(c).alias(n) for n, c in columns.items()])
        shift = F.lag if step < 0 else F.lead
        if self.width is None:
            found = self._df.withColumn("__near", shift(values).over(self._up()))
            found = found.withColumns({n: F.col("__near")[n] for n in columns})
            return self.map(lambda _: found.drop("__near"))
        edge = F.max_by(values, self._rank()) if step < 0 else F.min_by(values, self._rank())
        across = Window.partitionBy(*self.by).orderBy(CHUNK)
        near = F.coalesce(F.col("__near"), F.col("__edge"))
        return self._stitch(
            {"__near": shift(values).over(self._up())},
            {"__own": edge},
            {"__edge": shift("__own").over(across)},
            {n: near[n] for n in columns},
        )

    def prev(self, **columns) -> Ordered:
        """Values of the previous row (null on the first)."""
        return self._neighbour(-1, columns)

    def next(self, **columns) -> Ordered:
        """Values of the next row (null on the last)."""
        return self._neighbour(1, columns)

    def running(self, peers: bool = False, **specs: tuple[str, str | Column]) -> Ordered:
        """Running aggregates up to and with the row: name=(kind, expression).

        kind is sum, count, min, max, or last (last value that is not null). With `peers` all rows of
        the same time count as one place.
        """
        return self._scan(specs, forward=False, peers=peers)

    def ahead(self, **columns: str | Column) -> Ordered:
        """First value that is not null at the row or after it."""
        return self._scan({n: ("last", c) for n, c in columns.items()}, forward=True)

    def number(self, name: str, backward: bool = False) -> Ordered:
        """Row number from 1, from the front or from the back."""
        return self._scan({name: ("count", F.lit(1))}, forward=backward)

    def scans(self, running: dict, before: dict, ahead: dict) -> Ordered:
        """Running aggregates, last values before the row and next values in one step, so that rows are dealt once for all of them.

        running: name to (kind, expression). before and ahead: name to an expression; the last value of the rows before that is
        not null, and the first one at the row or after it.
        """
        last = lambda columns: {n: ("last", c) for n, c in columns.items()}
        up, down = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (self._up(), self._down()))
        parts = [self._parts(running, False, up), self._parts(last(before), False, self._up().rowsBetween(Window.unboundedPreceding, -1)),
                 self._parts(last(ahead), True, down)]
        return self._added(*({n: c for part in parts for n, c in part[i].items()} for i in range(4)))

    def _scan(self, specs, forward: bool, peers: bool = False) -> Ordered:
        window = self._down() if forward else self._up()
        frame = window.rowsBetween(Window.unboundedPreceding, 0)
        if peers:
            frame = Window.partitionBy(*self._part).orderBy(self.t).rangeBetween(Window.unboundedPreceding, 0)
        return self._added(*self._parts(specs, forward, frame))

    def _added(self, local, totals, carry, combine) -> Ordered:
        if self.width is None:
            return self.map(lambda df: df.withColumns(local))
        return self._stitch(local, totals, carry, combine)

    def _parts(self, specs, forward: bool, frame) -> tuple[dict, dict, dict, dict]:
        """What `_stitch` takes; the columns themselves where nothing is cut."""
        inside = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
                  "last": lambda c: F.last(c, ignorenulls=True)}
        if self.width is None:
            return {n: inside[k](as_column(c)).over(frame) for n, (k, c) in specs.items()}, {}, {}, {}
        pick = F.min_by if forward else F.max_by
        chunk_order = F.col(CHUNK).desc() if forward else F.col(CHUNK)
        before = (
            Window.partitionBy(*self.by).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
        )
        local, totals, carry, combine = {}, {}, {}, {}
        for name, (kind, value) in specs.items():
            column = as_column(value)
            here, own, past = f"__l_{name}", f"__t_{name}", f"__c_{name}"
            local[here] = inside[kind](column).over(frame)
            if kind == "last":
                totals[own] = pick(column, F.when(column.isNotNull(), self._rank()))
                carry[past] = F.last(own, ignorenulls=True).over(before)
                combine[name] = F.coalesce(here, past)
            else:
                totals[own] = inside[kind](column)
                carry[past] = (F.sum if kind in ("sum", "count") else inside[kind])(own).over(before)
                if kind in ("sum", "count"):
                    both = F.col(here) + F.col(past)
                    combine[name] = F.coalesce(both, here, past)
                else:
                    combine[name] = (F.least if kind == "min" else F.greatest)(here, past)
        return local, totals, carry, combine

    # -- frames ------------------------------------------------------------------

    def rows(self, before: int, after: int, **columns: Callable) -> Ordered:
        """Aggregates over the rows from `before` back to `after` ahead; name=function(Window)."""
        if self.width is None:
            frame = self._up().rowsBetween(-before, after)
            return self.map(lambda df: df.withColumns({n: f(frame) for n, f in columns.items()}))
        size = max(row_budget(self._df), 4 * (before + after + 1))
        numbered = self.number("__n")._df.withColumn("__b", F.floor((F.col("__n") - 1) / size))
        place = (F.col("__n") - 1) % size
        copies = F.array_compact(F.array(
            F.col("__b"),
            F.when(place >= size - before, F.col("__b") + 1),
            F.when((place < after) & (F.col("__b") > 0), F.col("__b") - 1),
        ))
        spread = numbered.withColumn("__to", F.explode(copies))
        frame = Window.partitionBy(*self.by, "__to").orderBy("__n").rowsBetween(-before, after)
        framed = spread.withColumns({n: f(frame) for n, f in columns.items()})
        framed = framed.where(F.col("__to") == F.col("__b")).drop("__n", "__b", "__to")
        return self.map(lambda _: framed)

    def span(self, back: float, forth: float = 0, **columns: Callable) -> Ordered:
        """Aggregates over the rows with time in [t - back, t + forth]; name=function(Window)."""
        # range frames over whole-number times need whole-number bounds
        back, forth = (int(x) if float(x).is_integer() else x for x in (back, forth))
        if self.width is None:
            frame = Window.partitionBy(*self.by).orderBy(self.t).rangeBetween(-back, forth)
            return self.map(lambda df: df.withColumns({n: f(frame) for n, f in columns.items()}))
        width = max(self.width, back, forth)
        block = F.floor(F.col(self.t) / F.lit(width))
        first = F.floor((F.col(self.t) - F.lit(forth)) / F.lit(width))
        last = F.floor((F.col(self.t) + F.lit(back)) / F.lit(width))
        spread = self._df.withColumn("__b", block).withColumn("__to", F.explode(F.coalesce(F.sequence(first, last), F.array(block))))
        frame = Window.partitionBy(*self.by, "__to").orderBy(self.t).rangeBetween(-back, forth)
        framed = spread.withColumns({n: f(frame) for n, f in columns.items()})
        framed = framed.where(F.col("__to").eqNullSafe(F.col("__b"))).drop("__b", "__to")
        return self.map(lambda _: framed)

    def islands(self, name: str, starts: Column) -> Ordered:
        """Number the stretches of rows that begin where `starts` holds."""
        return self.running(**{name: ("sum", F.when(starts, 1).otherwise(0).cast("long"))})
