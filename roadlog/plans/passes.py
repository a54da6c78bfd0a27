"""One pass over each view for all anchors and metrics.

Rules name what they need of a view as SQL expressions. The views are read once each: their rows, with these expressions
evaluated, become a table of the view. The rows of a run are ordered view by view, as an anchor or a cell of a metric looks at
one view only: everything that rules ask of the order (the last row of a filter, running counts, the row a second later) is taken
for all rules of the view together, a window for each depth of dependence, and no row carries columns of other views. Anchors
come first, by their dependence on one another, as columns of the run; one aggregate per run and view then holds the cells.

Where nothing is asked of the order, rows are not ordered: they are aggregated per run as they are. `Ordered` does the ordering, so a
hot run is cut; the view's rows are then written before each step, as it reads them twice. Runs without an id have no verdicts, so
their rows are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordered, measure_width, row_budget
from ..session import cut, together

S = 1_000_000_000
RUN, T, SEQ, SIDE, AT = "run_id", "t", "seq", "side", "at"
TASK_ROWS = 100_000     # rows of whole runs that a task orders; they carry the columns of the view's rules


class Book:
    """The expressions that rules ask of the views: a short name for each, by view."""

    def __init__(self) -> None:
        self.wanted: dict[str, dict[str, str]] = {}
        self.probed: dict[str, str] = {}

    def use(self, view: str) -> None:
        self.wanted.setdefault(view, {})

    def name(self, view: str, text: str) -> str:
        """The name of a value of the view's own rows, null on rows of other views."""
        texts = self.wanted.setdefault(view, {})
        return f"v_{view}.{texts.setdefault(text, f'c{len(texts)}')}"

    def column(self, view: str, text: str) -> Column:
        return F.col(self.name(view, text))

    def probe(self, view: str) -> str:
        """Ask for a second row a second after each row of the view; the name under which the view has them."""
        self.use(view)
        self.probed[f"{view}_probed"] = view
        return f"{view}_probed"


def tagged(book: Book, views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of the views that rules ask for, each view written once: view, run_id, t, seq and a struct of the view's values."""
    def written(view: str, texts: dict[str, str]) -> DataFrame:
        fields = [F.expr(text).alias(name) for text, name in texts.items()] or [F.lit(True).alias("c0")]
        rows = views[view].where(F.col(RUN).isNotNull())
        kept = cut(rows.select(RUN, F.col(T).cast("long").alias(T), F.col(SEQ).cast("long").alias(SEQ), F.struct(*fields).alias(f"v_{view}")))
        return kept.select(F.lit(view).alias("view"), "*")

    spark = next(iter(views.values())).sparkSession
    return dict(zip(book.wanted, together(spark, [lambda v=v, texts=texts: written(v, texts) for v, texts in book.wanted.items()])))


class Steps:
    """Columns over the order of a run, collected first and then added together, one step per depth of dependence."""

    def __init__(self, prefix: str):
        self.prefix, self.seen = prefix, {}
        self.running_, self.ahead_, self.span_, self.before_, self.late_, self.later_ = {}, {}, {}, {}, {}, {}

    def _name(self, step: dict, kind: str, column: Column, spec: object) -> Column:
        key = (id(step), kind, str(column))
        if key not in self.seen:
            self.seen[key] = f"__{self.prefix}_{len(self.seen)}"
            step[self.seen[key]] = spec
        return F.col(self.seen[key])

    def running(self, kind: str, column: Column) -> Column:
        """Running sum, count, min, max or last value up to and with the row."""
        return self._name(self.running_, kind, column, (kind, column))

    def ahead(self, column: Column) -> Column:
        """The next value that is not null."""
        return self._name(self.ahead_, "", column, column)

    def within(self, back: int, column: Column) -> Column:
        """How many values the time from `back` before the row up to it has."""
        return self._name(self.span_, str(back), column, (back, column))

    def before(self, column: Column) -> Column:
        """The last value before the row that is not null."""
        return self._name(self.before_, "", column, column)

    def late(self, kind: str, column: Column) -> Column:
        """A running column over columns that look at the row before."""
        return self._name(self.late_, kind, column, (kind, column))

    def later(self, kind: str, column: Column) -> Column:
        """A running column over such running columns."""
        return self._name(self.later_, kind, column, (kind, column))

    def apply(self, o: Ordered) -> Ordered:
        for running, before, ahead in ((self.running_, self.before_, self.ahead_), (self.late_, {}, {}), (self.later_, {}, {})):
            if running or before or ahead:
                o = _settled(o).scans(running, before, ahead)
        for back in sorted({b for b, _ in self.span_.values()}):
            frames = {n: (lambda w, c=c: F.count(c).over(w)) for n, (b, c) in self.span_.items() if b == back}
            o = o.span(back, 0, **frames)
        return o

    def names(self) -> list[str]:
        return list(self.seen.values())


def _settled(o: Ordered) -> Ordered:
    """With cut runs a step reads its rows twice, so they are written before."""
    return o if o.width is None else o.map(cut)


class Log:
    """The written rows of all views, whose row counts tell how each view's rows are dealt and cut."""

    def __init__(self, rows: dict[str, DataFrame]):
        self.rows = rows
        self.budget = row_budget(next(iter(rows.values())))
        spark = next(iter(rows.values())).sparkSession
        counts = dict(zip(rows, together(spark, [df.count for df in rows.values()])))
        self.sizes = {view: (n, n) for view, n in counts.items()}       # rows, and no fewer than the rows of any run
        large = {view: rows[view] for view, n in counts.items() if n > self.budget}
        if large:
            every = reduce(DataFrame.unionByName, [df.select("view", RUN, T) for df in large.values()])
            runs = every.groupBy("view", RUN).agg(F.count(T).alias("__timed"))
            self.sizes |= {r.view: (counts[r.view], r.most) for r in runs.groupBy("view").agg(F.max("__timed").alias("most")).collect()}
        self.widths: dict[str, float | None] = {}

    def times(self) -> DataFrame:
        """Runs and times of the view with most rows of a run: what rules order is one view, or few."""
        largest = max(self.rows, key=lambda view: self.sizes.get(view, (0, 0))[1])
        return self.rows[largest].select(RUN, T)

    def width(self, view: str) -> float | None:
        """The chunk width of a view; None where no run has more rows of it than the budget."""
        if view not in self.widths:
            hot = self.sizes.get(view, (0, 0))[1] > self.budget
            self.widths[view] = measure_width(self.rows[view], [RUN], T, self.budget) if hot else None
        return self.widths[view]

    def ordered(self, view: str, probed: bool, anchors: DataFrame | None, needed, steps: Steps | None = None, where: str | None = None) -> Ordered:
        """A view's rows in the order of time, with the anchors needed as columns; as they are where `steps` asks nothing of the order.

        `where` is a condition over the view's own values: only such rows are taken."""
        asked = steps is None or bool(steps.names())
        width = self.width(view) if asked else None
        rows = self.rows[view] if where is None else self.rows[view].where(where)
        o = timeline(rows, {view} if probed else set(), width, self.sizes.get(view, (0, 0))[0], asked)
        if not needed:
            return o
        return o.map(lambda df: df.join(anchors.select(RUN, *dict.fromkeys(needed)), RUN, "left"))


_MEASURE = object()


def timeline(rows: DataFrame, probed: set[str], width=_MEASURE, n: int | None = None, asked: bool = True) -> Ordered:
    """Rows of views in the order of time; probes stand a second after their row, before what happens then.

    `width` and `n` are the chunk width and the number of rows where they are known. Rows of whose order nothing is `asked` stay where they are.
    """
    if not asked:
        return Ordered(placed(rows, probed), RUN, T, (SIDE, SEQ))
    if width is _MEASURE:
        width = measure_width(rows, [RUN], T, row_budget(rows))
    n = rows.count() if n is None else n
    spread = placed(rows, probed)
    return Ordered(spread if width is not None else by_run(spread, n), RUN, T, (SIDE, SEQ), width, tasks(rows, n))


def placed(rows: DataFrame, probed: set[str]) -> DataFrame:
    """Rows at their time and, of the views that are probed, once more a second later."""
    values = [c for c in rows.columns if c.startswith("v_")]
    if not probed:
        return rows.select("view", RUN, F.col(T).alias(AT), T, F.lit(1).alias(SIDE), SEQ, *values)
    here = F.struct(F.lit(1).alias(SIDE), F.col(T).alias("__t"))
    both = F.array(here, F.struct(F.lit(0).alias(SIDE), (F.col(T) + S).alias("__t")))
    places = F.when(F.col("view").isin(sorted(probed)), both).otherwise(F.array(here))
    return rows.select("*", F.explode(places).alias("__p")).select(
        "view", RUN, F.col(T).alias(AT), F.col("__p.__t").alias(T), F.col(f"__p.{SIDE}").alias(SIDE), SEQ, *values)


def by_run(rows: DataFrame, n: int) -> DataFrame:
    """Runs dealt over as many tasks as their rows need.

    The rows of the pass are mostly nulls: small when they are shuffled and wide when they are sorted, so partitions chosen by
    their shuffled bytes are too large for a task. The windows and aggregates per run need no other shuffle.
    """
    return rows.repartition(tasks(rows, n), RUN)


def tasks(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))


def per_run(o: Ordered, cells: dict[str, Column]) -> DataFrame:
    """One row per run with aggregates over its rows."""
    return o.df.groupBy(RUN).agg(*[column.alias(name) for name, column in cells.items()])


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row per run of tables that have no column in common but the run."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != RUN]
    return every.groupBy(RUN).agg(*columns) if columns else every.distinct()
