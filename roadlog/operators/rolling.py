"""Row and time frames over ordered signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, as_column, chunk_width, names


def _full_mean(column: Column, frame, n: int) -> Column:
    return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))


def rolling_mean(df: DataFrame, by, t: str, tie, value, n: int, *, full: bool = True, centered: bool = False,
                 name: str = "mean") -> DataFrame:
    """Mean over n rows: trailing or centred, null until the frame is full unless full=False."""
    before, after = ((n - 1) // 2, n // 2) if centered else (n - 1, 0)
    column = as_column(value)
    compute = (lambda w: _full_mean(column, w, n)) if full else (lambda w: F.avg(column).over(w))
    return Ordered.of(df, by, t, tie).rows(before, after, **{name: compute}).df


def message_frequency(df: DataFrame, by, t: str, tie, n: int, unit: float) -> DataFrame:
    """Instantaneous frequency 1/gap and its mean over the last n gaps."""
    o = Ordered.of(df, by, t, tie).prev(__pt=t)
    o = o.with_columns(frequency=F.try_divide(F.lit(float(unit)), F.col(t) - F.col("__pt")))
    o = o.rows(n - 1, 0, frequency_mean=lambda w: _full_mean(F.col("frequency"), w, n))
    return o.df.drop("__pt")


def sliding_frequency(df: DataFrame, by, t: str, window: float, unit: float) -> DataFrame:
    """Messages per unit in the window that ends at each row; `warm` once a whole window has passed.

    On whole-number times the count is the rows so far less the rows that have left the window, two
    running counts, so its cost does not grow with the number of rows in a window.
    """
    if df.schema[t].dataType.simpleString() == "bigint" and float(window).is_integer():
        keys, size = names(by), int(window)
        row = F.struct(*df.columns)
        leaving = df.select(*keys, (F.col(t) + F.lit(size + 1)).alias(t), F.lit(1).alias("__gone"))
        both = df.select(*keys, t, F.lit(0).alias("__gone"), row.alias("__row")).unionByName(leaving, allowMissingColumns=True)
        o = Ordered(both, by, t, (), chunk_width(df, keys, t))
        one = lambda gone: ("sum", F.when(F.col("__gone") == gone, 1).otherwise(0).cast("long"))
        o = o.running(peers=True, __in=one(0), __out=one(1), __t0=("min", F.when(F.col("__gone") == 0, F.col(t))))
        rows = o.df.where("__gone = 0").withColumn("n_window", F.col("__in") - F.col("__out"))
        rows = rows.select("__row.*", "n_window", "__t0")
    else:
        rows = Ordered.of(df, by, t).span(window, 0, n_window=lambda w: F.count(F.lit(1)).over(w)).running(__t0=("min", t)).df
    return rows.withColumn("frequency", F.col("n_window") / F.lit(window / unit)).withColumn(
        "warm", F.col(t) - F.col("__t0") >= F.lit(window)).drop("__t0")


def resetting_sum(df: DataFrame, by, t: str, tie, max_gap: float) -> DataFrame:
    """Running sum of gaps that returns to 0 at every gap over max_gap (and on the first row)."""
    o = Ordered.of(df, by, t, tie).prev(__pt=t).with_columns(gap=F.col(t) - F.col("__pt"))
    goes_on = F.coalesce(F.col("gap") <= max_gap, F.lit(False))
    # the sum inside a stretch is the time since the stretch began
    o = o.running(__from=("last", F.when(~goes_on, F.col(t))))
    return o.df.withColumn("duration", F.col(t) - F.col("__from")).drop("__pt", "__from")


def missing_durations(df: DataFrame, by, t: str) -> DataFrame:
    """Time to the next distinct time at which the entity is seen (null on the last)."""
    seen = df.select(*names(by), t).distinct()
    return Ordered.of(seen, by, t).next(__nt=t).with_columns(missing=F.col("__nt") - F.col(t)).df.drop("__nt")


def fill_gaps(df: DataFrame, by, t: str, step: float, tolerance: float) -> DataFrame:
    """Distinct times of an entity plus one filler a step after every time with a longer gap.

    The last gap is left out: its closing time may not be complete yet.
    """
    keys = names(by)
    seen = df.select(*keys, t).distinct()
    o = Ordered.of(seen, by, t).next(__n1=t).next(__n2="__n1")
    gap = F.col("__n1") - F.col(t)
    fillers = o.df.where((gap > step + tolerance) & F.col("__n2").isNotNull()).select(
        *keys, (F.col(t) + F.lit(step)).alias(t), F.lit(True).alias("filler"))
    return seen.withColumn("filler", F.lit(False)).unionByName(fillers)


def unwrap(df: DataFrame, by, t: str, tie, angle, period: float, discont: float, name: str = "unwrapped") -> DataFrame:
    """Angle without jumps: steps of at least `discont` are replaced by their smallest equal turn."""
    o = Ordered.of(df, by, t, tie).with_columns(__a=as_column(angle).cast("double")).prev(__pa="__a")
    step = F.col("__a") - F.col("__pa")
    half = period / 2.0
    shifted = F.pmod(step + F.lit(half), F.lit(float(period))) - F.lit(half)
    wrapped = F.when((shifted == -half) & (step > 0), F.lit(half)).otherwise(shifted)
    fix = F.when(F.abs(step) >= discont, wrapped - step).otherwise(F.lit(0.0))
    o = o.running(__fix=("sum", F.coalesce(fix, F.lit(0.0))))
    return o.df.withColumn(name, F.col("__a") + F.col("__fix")).drop("__a", "__pa", "__fix")


def gradient(df: DataFrame, by, t: str, tie, value, unit: float, name: str = "gradient") -> DataFrame:
    """Derivative on uneven times: second order inside, one-sided at the ends."""
    o = Ordered.of(df, by, t, tie).with_columns(__v=as_column(value).cast("double"))
    o = o.prev(__pt=t, __pv="__v").next(__nt=t, __nv="__v")
    back = (F.col(t) - F.col("__pt")) / F.lit(unit)
    ahead = (F.col("__nt") - F.col(t)) / F.lit(unit)
    rise_back = F.try_divide(F.col("__v") - F.col("__pv"), back)
    rise_ahead = F.try_divide(F.col("__nv") - F.col("__v"), ahead)
    inner = F.try_divide(back * rise_ahead + ahead * rise_back, back + ahead)
    value_ = F.when(F.col("__pt").isNull(), rise_ahead).when(F.col("__nt").isNull(), rise_back).otherwise(inner)
    return o.df.withColumn(name, value_).drop("__v", "__pt", "__pv", "__nt", "__nv")


def path_length(df: DataFrame, by, t: str, tie, x, y, name: str = "downtrack") -> DataFrame:
    """Distance travelled since the first point."""
    o = Ordered.of(df, by, t, tie).with_columns(__x=as_column(x).cast("double"), __y=as_column(y).cast("double"))
    o = o.prev(__px="__x", __py="__y")
    step = F.coalesce(F.hypot(F.col("__x") - F.col("__px"), F.col("__y") - F.col("__py")), F.lit(0.0))
    o = o.with_columns(step=step).running(**{name: ("sum", "step")})
    return o.df.drop("__x", "__y", "__px", "__py")


def subtracks(df: DataFrame, by, t: str, tie, distance, max_gap: float, max_jump: float) -> DataFrame:
    """Number the stretches between breaks: a gap over max_gap or a jump over max_jump.

    `distance(previous, current)` takes two functions from column name to Column.
    """
    needed = [c for c in df.columns if c not in names(by)]
    o = Ordered.of(df, by, t, tie).prev(**{f"__p_{c}": c for c in needed})
    jump = distance(lambda c: F.col(f"__p_{c}"), F.col)
    broke = F.coalesce((F.col(t) - F.col(f"__p_{t}") > max_gap) | (jump > max_jump), F.lit(False))
    return o.islands("track", broke).df.drop(*[f"__p_{c}" for c in needed])


def drop_ends(df: DataFrame, by, t: str, tie, first: int = 0, last: int = 0) -> DataFrame:
    """All but the first and last rows of every entity."""
    o = Ordered.of(df, by, t, tie).number("__n").number("__m", backward=True)
    return o.df.where((F.col("__n") > first) & (F.col("__m") > last)).drop("__n", "__m")


def nth(df: DataFrame, by, t: str, tie, n: int) -> DataFrame:
    """The n-th row of every entity that has one."""
    return Ordered.of(df, by, t, tie).number("__n").df.where(F.col("__n") == n).drop("__n")


def extra_instances(df: DataFrame, by, t: str, tie) -> DataFrame:
    """Rows after the first for the same entity and time, without exact repeats."""
    keys = [*names(by), t]
    first = df.groupBy(*keys).agg(F.min(F.struct(*names(tie))).alias("__first"))
    joined = df.join(first, keys).where(F.struct(*names(tie)) != F.col("__first"))
    return joined.drop("__first").distinct()


def relative_time(df: DataFrame, by, t: str, name: str = "t_rel") -> DataFrame:
    """Time since the first row of the entity, from one pre-aggregated row per entity."""
    first = df.groupBy(*names(by)).agg(F.min(t).alias("__t0"))
    return df.join(first, names(by)).withColumn(name, F.col(t) - F.col("__t0")).drop("__t0")


def second_rows(df: DataFrame, by, t: str, unit: int) -> DataFrame:
    """Row count per entity and whole unit of time."""
    return df.groupBy(*names(by), F.floor(F.col(t) / F.lit(unit)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
