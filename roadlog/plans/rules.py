"""The rules that metrics are made of.

A rule of `PASS` takes the scope of its use case and returns value and verdict as columns over the cells of a run; it
adds no read of its own. A rule of `APART` joins or orders rows in a way the pass has no step for: it names what it needs and
returns a function that reads that from the written rows.

Times in views are ns, limits are seconds. `window` is a pair of anchors with optional margins in seconds: (from, to) or
(from, to, after from, before to); either anchor may be None. A verdict is null where the run lacks the rows or anchors to
judge; where they are there and the event asked for never came, it is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import METRES_TO_FEET
from ..operators import intervals, trajectory
from ..operators.hysteresis import hysteresis_changes
from ..operators.matching import alternating_pairs, ordinal_pairs
from ..operators.ordered import Ordered
from .passes import AT, RUN, S, SEQ, Log, Steps, T


def within(value: Column, low=None, high=None, below=None) -> Column:
    """Whether a value lies in a band; `below` is a limit it must not reach. Null without a value."""
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    if below is not None:
        ok = ok & (value < below)
    return F.when(value.isNotNull(), ok)


def due(seen: Column, ok: Column) -> Column:
    """The verdict where there was something to judge; false where what should have come did not."""
    return F.when(seen, F.coalesce(ok, F.lit(False)))


def _order() -> Column:
    return F.struct(T, SEQ)


class Moves:
    """Stretches of rows that rise (sign 1) or fall (-1) from row to row of a selection."""

    def __init__(self, steps: Steps, on: Column, value: Column, sign: int):
        self.steps = steps
        was = steps.before(F.when(on, F.struct(value.alias("v"))))
        self.moves = on & F.coalesce((value - was["v"]) * sign > 0, F.lit(False))
        self.rest = on & ~self.moves
        n = steps.running("count", F.when(on, 1))
        self.length = n - F.coalesce(steps.late("last", F.when(self.rest, n)), F.lit(0))

    def hit(self, k: int) -> Column:
        """Rows that are the k-th move of their stretch."""
        return self.moves & (self.length == k)

    def base(self) -> Column:
        """Time of the row before the stretch."""
        return self.steps.late("last", F.when(self.rest, F.col(AT)))

    def start(self) -> Column:
        """Time of the first row that moved."""
        return self.steps.later("last", F.when(self.hit(1), F.col(AT)))


# -- gaps and shares of time


def _gap(p, view, where, window) -> Column:
    on = p.on(view, where, window)
    return F.when(on, F.col(AT) - p.steps(view).before(F.when(on, F.col(AT))))


def gap_share(p, view, limit, share, where=None, window=None):
    """Share of time in gaps shorter than a limit."""
    gap = _gap(p, view, where, window)
    value = F.try_divide(F.coalesce(p.agg(view, F.sum(F.when(gap < limit * S, gap))), F.lit(0)) * 100.0, p.agg(view, F.sum(gap)))
    return value, within(value, low=share)


def gap_max(p, view, limit, where=None, window=None):
    """No gap reaches a limit."""
    value = p.agg(view, F.max(_gap(p, view, where, window))) / F.lit(S)
    return value, within(value, below=limit)


def time_share(p, view, holds, share, window=None):
    """Share of time for which a condition holds; a gap counts to the row that ends it."""
    gap = _gap(p, view, None, window)
    on = F.coalesce(p.column(view, holds), F.lit(False))
    value = F.try_divide(F.coalesce(p.agg(view, F.sum(F.when(on, gap))), F.lit(0)) * 100.0, p.agg(view, F.sum(gap)))
    return value, within(value, low=share)


# -- counts of rows


def _counts(p, view, where, window, *holds) -> list[Column]:
    """Rows of the selection, and those of them that meet each condition."""
    on = p.on(view, where, window)
    return [p.agg(view, F.count_if(on)), *[p.agg(view, F.count_if(on & F.coalesce(p.column(view, h), F.lit(False)))) for h in holds]]


def always(p, view, holds, where=None, window=None):
    """A condition holds on every row; value is the share in percent."""
    n, hits = _counts(p, view, where, window, holds)
    return F.when(n > 0, hits * 100.0 / n), F.when(n > 0, hits == n)


def never(p, view, holds, where=None, window=None):
    """A condition holds on no row; value is the number of rows where it does."""
    return count_limit(p, view, holds, 0, where, window)


def count_limit(p, view, holds, most, where=None, window=None):
    """A condition holds on at most so many rows."""
    n, hits = _counts(p, view, where, window, holds)
    return F.when(n > 0, hits), F.when(n > 0, hits <= most)


def exists(p, view, holds, where=None, window=None):
    """A condition holds on some row; value is the number of rows where it does."""
    n, hits = _counts(p, view, where, window, holds)
    return F.when(n > 0, hits), F.when(n > 0, hits > 0)


def both(p, view, one, two, where=None, window=None):
    """Each of two conditions holds on some row; value is the lesser number of rows."""
    n, a, b = _counts(p, view, where, window, one, two)
    return F.when(n > 0, F.least(a, b)), F.when(n > 0, (a > 0) & (b > 0))


def exists_as(p, view, holds, unless, where=None, window=None):
    """A condition holds on some row, or on none in runs whose parameter `unless` is true."""
    n, hits, other = _counts(p, view, where, window, holds, unless)
    return F.when(n > 0, hits), F.when(n > 0, F.when(other > 0, hits == 0).otherwise(hits > 0))


def mean_frequency(p, view, hz, where=None, window=None):
    """Mean frequency over the rows."""
    on = p.on(view, where, window)
    at = F.when(on, F.col(AT))
    value = F.try_divide(p.agg(view, F.count_if(on)) - 1.0, (p.agg(view, F.max(at)) - p.agg(view, F.min(at))) / F.lit(S))
    return value, within(value, low=hz)


def _frequencies(p, view, seconds, where, window) -> Column:
    """Frequency over the last seconds, on rows that have so many before them."""
    on = p.on(view, where, window)
    at = F.when(on, F.col(AT))
    n = p.steps(view).within(int(seconds * S), at)
    return F.when(on & (F.col(AT) - p.steps(view).running("min", at) >= int(seconds * S)), n / F.lit(float(seconds)))


def window_frequency(p, view, seconds, hz, where=None, window=None):
    """Frequency in every full window of some seconds stays over a limit."""
    value = p.agg(view, F.min(_frequencies(p, view, seconds, where, window)))
    return value, within(value, low=hz)


def window_band(p, view, seconds, low, high, where=None, window=None):
    """Share of full windows whose frequency lies in a band; all have to."""
    rate = _frequencies(p, view, seconds, where, window)
    n, hits = p.agg(view, F.count(rate)), p.agg(view, F.count_if(rate.between(low, high)))
    return F.when(n > 0, hits * 100.0 / n), F.when(n > 0, hits == n)


# -- values and their change


def section(p, view, value, begins, ends, low=None, high=None, window=None):
    """Mean rate of change between the first row that begins a section and the first end after it."""
    on, row = p.on(view, None, window), F.struct(F.col(AT).alias("t"), p.column(view, value).cast("double").alias("v"))
    begin = on & F.coalesce(p.column(view, begins), F.lit(False))
    opened = p.steps(view).running("min", F.when(begin, F.col(AT)))
    end = on & F.coalesce(p.column(view, ends) & (F.col(AT) > opened), F.lit(False))
    a, b = p.agg(view, F.min_by(row, F.when(begin, _order()))), p.agg(view, F.min_by(row, F.when(end, _order())))
    rate = F.try_divide(b["v"] - a["v"], (b["t"] - a["t"]) / F.lit(S))
    return rate, within(rate, low, high)


def second_rate(p, view, value, limit, window=None, signed=False):
    """Change over the next second stays under a limit on every row; `signed` looks at rises alone."""
    probed = p.book.probe(view)
    here, on = p.column(view, value).cast("double"), p.on(view, None, window, probed=probed)
    then = p.steps(probed).ahead(F.when(on, F.struct(F.col(AT).alias("t"), here.alias("v"))))
    rate = (then["v"] - here) / ((then["t"] - F.col(AT)) / F.lit(S))
    worst = p.agg(probed, F.max(F.when(p.on(view, None, window, side=0, probed=probed), rate if signed else F.abs(rate))))
    return worst, within(worst, high=limit)


def _first(p, view, values: dict[str, Column], on: Column) -> Column:
    """Values of the first row of a selection."""
    return p.agg(view, F.min_by(F.struct(*[c.alias(n) for n, c in values.items()]), F.when(on, _order())))


def _at(p, view, value, at, where=None) -> Column:
    """A value of the first row at or after an anchor."""
    return _first(p, view, {"v": p.column(view, value)}, p.on(view, where, (at, None)))["v"]


def value_at(p, view, value, at, low=None, high=None, where=None):
    """A value at the first row at or after an anchor lies in a band."""
    found = _at(p, view, value, at, where)
    return found, within(found, low, high)


def value_gap(p, view, value, at, other_view, other_value, other_at, low=None, high=None, scale=1.0):
    """A value at an anchor less another value at another anchor lies in a band. Judged where the other anchor is."""
    gap = (_at(p, view, value, at) - _at(p, other_view, other_value, other_at)) * F.lit(scale)
    return gap, due(p.anchor(other_at).isNotNull(), within(gap, low, high))


def moved_feet(p, at, since, place_view, place, low=None, high=None):
    """The way in feet from one anchor to another."""
    return value_gap(p, place_view, place, at, place_view, place, since, low, high, METRES_TO_FEET)


def needed_deceleration(p, view, value, target, at, place_view, place, to, limit):
    """The deceleration that brings the speed at an anchor to a target on the way to another anchor stays under a limit."""
    speed = _at(p, view, value, at)
    way = _at(p, place_view, place, to) - _at(p, place_view, place, at)
    needed = F.try_divide(speed * speed - F.lit(target * target), 2 * way)
    return needed, within(F.abs(needed), high=limit)


def stop_short(p, view, x, y, goal_x, goal_y, front, at, start, limit):
    """The front of the vehicle stops before a line and less than `limit` metres from it; value is that distance.

    The line is passed where the vehicle stands farther from its start than the line is.
    """
    place = {"x": p.column(view, x), "y": p.column(view, y), "gx": p.column(view, goal_x), "gy": p.column(view, goal_y), "front": p.column(view, front)}
    there, begin = (_first(p, view, place, p.on(view, None, (a, None))) for a in (at, start))
    gap = F.hypot(there["x"] - there["gx"], there["y"] - there["gy"])
    before = F.hypot(there["x"] - begin["x"], there["y"] - begin["y"]) < F.hypot(there["gx"] - begin["x"], there["gy"] - begin["y"])
    value = F.when(before, gap - there["front"]).otherwise(gap + there["front"])
    return value, F.when(value.isNotNull(), before & (value >= 0) & (value < limit))


def route(p, view, column, which, members, relation, where=None):
    """The first or last route contains all, or avoids all, of the lanes that `members` names in the run
    manifest; value is how many it has."""
    order = F.when(p.on(view, where), _order())
    one = p.agg(view, (F.min_by if which == "first" else F.max_by)(p.column(view, column), order))
    has = F.size(F.array_intersect(one, F.col(members)))
    passed = has == F.size(F.array_distinct(members)) if relation == "contains" else has == 0
    return F.when(one.isNotNull(), has), F.when(one.isNotNull(), passed)


# -- stretches


class _Stretches:
    """Stretches of rows of a selection that hold a condition."""

    def __init__(self, p, view, holds, where, window):
        self.on = p.on(view, where, window)
        self.holds = F.coalesce(p.column(view, holds), F.lit(False))
        self.held_before = F.coalesce(p.steps(view).before(F.when(self.on, F.struct(self.holds.alias("h"))))["h"], F.lit(False))
        self.begun = p.steps(view).late("last", F.when(self.on & self.holds & ~self.held_before, F.col(AT)))


def held(p, view, holds, seconds, window=None):
    """A condition holds without interruption for some time."""
    s = _Stretches(p, view, holds, None, window)
    value = p.agg(view, F.max(F.when(s.on & s.holds, F.col(AT) - s.begun))) / F.lit(S)
    return value, due(p.agg(view, F.count_if(s.on)) > 0, value >= seconds)


def interval_length(p, view, holds, seconds, window=None):
    """Every stretch of a condition ends soon enough; value is the longest, up to the row that leaves it."""
    s = _Stretches(p, view, holds, None, window)
    value = p.agg(view, F.max(F.when(s.on & (s.holds | s.held_before), F.col(AT) - s.begun))) / F.lit(S)
    return value, within(value, high=seconds)


def row_run(p, view, holds, k, window=None):
    """A condition holds on `k` rows in a row; value is the longest such run."""
    on = p.on(view, None, window)
    hit = F.coalesce(p.column(view, holds), F.lit(False))
    n = p.steps(view).running("count", F.when(on, 1))
    length = n - F.coalesce(p.steps(view).late("last", F.when(on & ~hit, n)), F.lit(0))
    rows = p.agg(view, F.count_if(on))
    value = F.when(rows > 0, F.coalesce(p.agg(view, F.max(F.when(on & hit, length))), F.lit(0)))
    return value, F.when(rows > 0, value >= k)


def _settled(p, view, holds, where, window) -> tuple[Column, Column]:
    """How many rows a selection has, and from when on a condition holds up to its last row."""
    s = _Stretches(p, view, holds, where, window)
    last = p.agg(view, F.max_by(F.struct(s.holds.alias("h"), s.begun.alias("t")), F.when(s.on, _order())))
    return p.agg(view, F.count_if(s.on)), F.when(last["h"], last["t"])


def steady_before(p, view, holds, event, seconds, begin=None):
    """A condition holds for some time up to an anchor."""
    rows, since = _settled(p, view, holds, None, (begin, event))
    value = (p.anchor(event) - since) / F.lit(S)
    return value, due(rows > 0, value >= seconds)


def settle(p, view, holds, seconds, window, where=None):
    """From the window's begin, a condition holds for good soon enough."""
    rows, since = _settled(p, view, holds, where, window)
    value = (since - p.anchor(window[0])) / F.lit(S)
    return value, due(rows > 0, value <= seconds)


def steady_to(p, view, holds, to, last, seconds):
    """Of the last seconds before an anchor, a condition is met early enough; value is the time left then."""
    on = p.on(view, None, (to, to, -last, 0))
    first = p.agg(view, F.min(F.when(on & F.coalesce(p.column(view, holds), F.lit(False)), F.col(AT))))
    value = (p.anchor(to) - first) / F.lit(S)
    return value, due(p.agg(view, F.count_if(on)) > 0, value >= seconds)


def begins_within(p, view, value, sign, k, window, seconds=None, below=None):
    """The first k rises (or falls) in a row start soon after the window's begin."""
    on = p.on(view, None, window)
    moves = Moves(p.steps(view), on, p.column(view, value), sign)
    base = p.agg(view, F.min_by(F.when(moves.hit(k), moves.base()), F.when(moves.hit(k), _order())))
    wait_ = (base - p.anchor(window[0])) / F.lit(S)
    return wait_, due(p.agg(view, F.count_if(on)) > 0, within(wait_, high=seconds, below=below))


# -- anchors


def wait(p, since, view, holds, seconds=None, low=0.0, below=None):
    """The first row meeting a condition at or after an anchor comes soon enough."""
    hit = p.agg(view, F.min(F.when(p.on(view, holds, (since, None)), F.col(AT))))
    value = (hit - p.anchor(since)) / F.lit(S)
    return value, due(p.anchor(since).isNotNull(), within(value, low, seconds, below))


def anchor_gap(p, first, second, low=None, high=None, below=None):
    """Seconds between two anchors lie in a band."""
    value = (p.anchor(second) - p.anchor(first)) / F.lit(S)
    return value, due(p.anchor(first).isNotNull(), within(value, low, high, below))


def none_after(p, view, holds, since, seconds, to=None):
    """No row meets a condition later than some seconds after an anchor; value is the number of rows that do."""
    late = p.on(view, None, (since, to)) & (F.col(AT) > p.anchor(since) + int(seconds * S))
    hits = p.agg(view, F.count_if(late & F.coalesce(p.column(view, holds), F.lit(False))))
    seen = p.anchor(since).isNotNull()
    return F.when(seen, hits), F.when(seen, hits == 0)


def lane_speed(p, view, across, lane, left, taken, begin, low, high):
    """The speed across in a lane change lies in a band: from the last row in a lane before the anchor `left` to the anchor `taken`."""
    row = F.struct(F.col(AT).alias("t"), p.column(view, across).cast("double").alias("v"))
    before = p.on(view, f"{lane} IS NOT NULL", (begin, left)) & (F.col(AT) < p.anchor(left))
    a = p.agg(view, F.max_by(row, F.when(before, _order())))
    b = _first(p, view, {"t": F.col(AT), "v": p.column(view, across).cast("double")}, p.on(view, None, (taken, None)))
    speed = F.abs(F.try_divide(b["v"] - a["v"], (b["t"] - a["t"]) / F.lit(S)))
    return speed, within(speed, low, high)


# -- sequences of values


def follows(p, view, column, one, two, where=None, window=None):
    """A value is followed by another; value is how often."""
    on = p.on(view, where, window)
    now = p.column(view, column)
    was = p.steps(view).before(F.when(on, F.struct(now.alias("x"))))["x"]
    hits = p.agg(view, F.count_if(on & F.coalesce((was == F.lit(one)) & (now == F.lit(two)), F.lit(False))))
    rows = p.agg(view, F.count_if(on))
    return F.when(rows > 0, hits), F.when(rows > 0, hits > 0)


def listed(p, view, column, where, members, window=None):
    """The values that begin on rows that meet a condition are the list `members` of the run manifest; value is how many they are."""
    on = p.on(view, None, window)
    now = p.column(view, column)
    was = p.steps(view).before(F.when(on, F.struct(now.alias("x"))))
    begins = on & (was.isNull() | ~now.eqNullSafe(was["x"])) & F.coalesce(p.column(view, where), F.lit(False))
    n = p.steps(view).late("count", F.when(begins, 1))
    right = F.coalesce(F.get(p.column(view, members), (n - 1).cast("int")) == now, F.lit(False))
    found, fits, rows = p.agg(view, F.count_if(begins)), p.agg(view, F.count_if(begins & right)), p.agg(view, F.count_if(on))
    return F.when(rows > 0, found), F.when(rows > 0, (found == fits) & (found == F.size(members)))


def merge_start(p, view, planner, merging, x, y, since, place_view, low=None, high=None):
    """The first point of a merging planner after an anchor lies in a band of feet from where the vehicle was then."""
    place = _first(p, place_view, {"x": p.column(place_view, x), "y": p.column(place_view, y)}, p.on(place_view, None, (since, None)))
    test = f"{planner} IN ({', '.join(repr(m) for m in merging)})"
    point = _first(p, view, {"x": p.column(view, x), "y": p.column(view, y)}, p.on(view, test, (since, None)))
    value = F.hypot(point["x"] - place["x"], point["y"] - place["y"]) * trajectory.MERGE_FEET
    return value, due(place.isNotNull(), within(value, low, high))


# -- rules with a read of their own


class Reader:
    """The written rows of a view, limited to a window of the run's anchors."""

    def __init__(self, log: Log, per_run: DataFrame, scope):
        self.log, self.per_run, self.scope = log, per_run, scope

    def __call__(self, view: str, where: Column | None = None, window: tuple | None = None, **columns: Column) -> DataFrame:
        df = self.log.rows[view]
        if where is not None:
            df = df.where(F.coalesce(where.cast("boolean"), F.lit(False)))
        df = df.select(RUN, T, SEQ, *[c.alias(n) for n, c in columns.items()])
        begin, finish = (self.scope.anchors.get(n) for n in (window or (None, None))[:2])
        bounds = [n for n in dict.fromkeys((begin, finish)) if n]
        if bounds:
            df = df.join(self.per_run.select(RUN, *bounds), RUN)
            margins = window[2:] or (0, 0)
            if begin:
                df = df.where(F.col(T) >= F.col(begin) + int(margins[0] * S))
            if finish:
                df = df.where(F.col(T) <= F.col(finish) - int(margins[1] * S))
            df = df.drop(*bounds)
        return df


def _judged(df: DataFrame, value: Column, low=None, high=None) -> DataFrame:
    return df.select(RUN, value.alias("value"), within(value, low, high).alias("passed"))


def order(p, view, column, values, window=None):
    """Values follow one another as a list of the run manifest says; value is how often."""
    now = p.column(view, column)
    p.on(view, None, window)

    def judge(read, runs):
        df = read(view, None, window, level=now)
        found = intervals.listed_sequence(df, RUN, T, SEQ, "level", runs.select(RUN, values), values)
        hits = found.groupBy(RUN).agg(F.count(F.lit(1)).alias("__n"))
        return _judged(df.select(RUN).distinct().join(hits, RUN, "left"), F.coalesce("__n", F.lit(0)).cast("double"), low=1)
    return judge


def complete(p, view, part, n, window=None):
    """All n distinct parts were received."""
    piece = p.column(view, part)
    return lambda read, runs: _judged(read(view, None, window, part=piece).groupBy(RUN).agg(F.count_distinct("part").cast("double").alias("__n")), F.col("__n"), low=n)


def acked(p, view, key, acks, seconds, where=None):
    """Every message is acknowledged soon enough; value is the longest wait, null when one has none."""
    sent_key, got_key = p.column(view, key), p.column(acks, key)
    test = p.column(view, where) if where else None

    def judge(read, runs):
        sent = read(view, test, None, __k=sent_key).groupBy(RUN, "__k").agg(F.min(T).alias("__t0"))
        got = read(acks, None, None, __k=got_key).groupBy(RUN, "__k").agg(F.min(T).alias("__t1"))
        pairs = sent.join(got, [RUN, "__k"], "left").withColumn("__w", (F.col("__t1") - F.col("__t0")) / F.lit(S))
        lost, worst = F.count_if(F.col("__w").isNull()), F.max(F.abs("__w"))
        return pairs.groupBy(RUN).agg(F.when(lost == 0, worst).alias("value"), F.coalesce((lost == 0) & (worst <= seconds), F.lit(False)).alias("passed"))
    return judge


def paired_wait(p, calls, responses, seconds):
    """Every call has its response soon enough; value is the longest wait."""
    p.book.use(calls)
    p.book.use(responses)

    def judge(read, runs):
        pairs = ordinal_pairs(read(calls), read(responses), RUN, T, tie=SEQ)
        return _judged(pairs.groupBy(RUN).agg((F.max("delay") / F.lit(S)).alias("v")), F.col("v"), high=seconds)
    return judge


def _with_target(p, view, value, target):
    """Rows with a value, its target and the greatest target of the run."""
    v, g = p.column(view, value), p.column(view, target)
    top = p.agg(view, F.max(g))
    return lambda read: read(view, None, None, v=v, g=g).join(read.per_run.select(RUN, top.alias("top")), RUN)


def plateau_error(p, view, value, target, tolerance, skip):
    """Where the target is at its maximum (after the first rows), the value stays near it."""
    rows = _with_target(p, view, value, target)

    def judge(read, runs):
        o = Ordered.of(rows(read).withColumn("on", F.col("g") == F.col("top")), RUN, T, SEQ)
        o = o.prev(was="on").islands("isl", F.col("on") & ~F.coalesce("was", F.lit(False)))
        used = Ordered.of(o.df.where("on"), [RUN, "isl"], T, SEQ).number("n").df.where(F.col("n") > skip)
        return _judged(used.groupBy(RUN).agg(F.max(F.abs(F.col("top") - F.col("v"))).alias("x")), F.col("x"), high=tolerance)
    return judge


def turn_speed(p, view, value, target, share):
    """In slow stretches between two plateaus without a stop, the speed stays over a share of the top."""
    rows = _with_target(p, view, value, target)

    def judge(read, runs):
        o = Ordered.of(rows(read), RUN, T, SEQ).prev(pt=T).next(nt=T)
        edge = F.bool_or((F.col("g") == 0) | F.col("pt").isNull() | F.col("nt").isNull())
        spans = intervals.runs(o.df, RUN, T, SEQ, F.col("g") < F.col("top"), edge=edge, low=F.min(F.col("v") / F.col("top")))
        return _judged(spans.where("not edge").groupBy(RUN).agg(F.min("low").alias("x")), F.col("x"), low=share)
    return judge


def arrival_distance(p, view, call, answer, x, y, most):
    """Distance between every goal and the position reported on arrival."""
    columns = {"x": p.column(view, x), "y": p.column(view, y), "c": p.column(view, call), "a": p.column(view, answer)}

    def judge(read, runs):
        pairs = alternating_pairs(read(view, None, None, **columns), RUN, T, SEQ, F.col("c"), F.col("a"), ["x", "y"]).where("t_answer is not null")
        far = F.max(F.hypot(F.col("x_call") - F.col("x_answer"), F.col("y_call") - F.col("y_answer")))
        return _judged(pairs.groupBy(RUN).agg(far.alias("x")), F.col("x"), high=most)
    return judge


def hysteresis_count(p, view, value, band, low, high):
    """Number of accepted changes of a level."""
    level = p.column(view, value)

    def judge(read, runs):
        found = hysteresis_changes(read(view, None, None, v=level), RUN, T, SEQ, F.col("v"), band)
        return _judged(found.groupBy(RUN).agg(F.count(F.lit(1)).cast("double").alias("x")), F.col("x"), low, high)
    return judge


def merge_end(p, view, plan, target, planner, merging, x, y, window, place_view, low, high):
    """Where planned merges end, every plan's distance in feet from where the vehicle is at the window's end lies in a band;
    value is the greatest."""
    columns = {"plan": p.column(view, plan), "at": p.column(view, target), "x": p.column(view, x), "y": p.column(view, y), "planner": p.column(view, planner)}
    place = _first(p, place_view, {"x": p.column(place_view, x), "y": p.column(place_view, y)}, p.on(place_view, None, (window[1], None)))

    def judge(read, runs):
        points = read(view, None, window, **columns)
        ends = trajectory.merge_distance(points, [RUN, "plan"], "at", SEQ, "planner", merging, (0.0, 0.0), least_step=0.001 * S)
        feet = F.hypot(F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")) * trajectory.MERGE_FEET
        found = ends.join(read.per_run.select(RUN, place.alias("p")), RUN).groupBy(RUN).agg(F.max(feet).alias("v"), F.min(feet).alias("least"))
        out = points.select(RUN).distinct().join(found, RUN, "left")
        return out.select(RUN, F.col("v").alias("value"), F.coalesce((F.col("least") >= low) & (F.col("v") <= high), F.lit(False)).alias("passed"))
    return judge


PASS = {f.__name__: f for f in (
    gap_share, gap_max, time_share, always, never, count_limit, exists, both, exists_as, mean_frequency, window_frequency, window_band,
    section, second_rate, value_at, value_gap, moved_feet, needed_deceleration, stop_short, route, held, interval_length, row_run,
    steady_before, settle, steady_to, begins_within, wait, anchor_gap, none_after, lane_speed, follows, listed, merge_start)}
APART = {f.__name__: f for f in (order, complete, acked, paired_wait, plateau_error, turn_speed, arrival_distance, hysteresis_count, merge_end)}
