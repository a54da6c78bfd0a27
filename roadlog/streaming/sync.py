"""Step synchronisation of several tools: complete steps, their lag and the delay of every tool.

A step is (entity, sim_time); every tool logs the system time at which it got the step. Step T is in
step with T + step when the first tool to get T + step did so after the last tool got T (within a
tolerance). Both forms keep the first report of a tool per step: the least system time, on a stream of those
that came together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import rolling
from ..operators.ordered import names

# state with keys, timers and a time to live needs this provider
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def complete_steps(steps: DataFrame, by, n_sources: int) -> DataFrame:
    """Steps that all sources reported, with the first and last system time."""
    keys = [*names(by), "sim_time"]
    first = steps.groupBy(*keys, "source").agg(F.min("system_time").alias("system_time"))
    full = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("system_time").alias("lo"), F.max("system_time").alias("hi"))
    return full.where(F.col("__n") == n_sources).drop("__n")


def _with_following(full: DataFrame, by, step: int) -> DataFrame:
    following = full.select(*names(by), (F.col("sim_time") - step).alias("sim_time"), F.col("lo").alias("first_next"))
    return full.join(following, [*names(by), "sim_time"])


def sync_check(steps: DataFrame, by, n_sources: int, step: int = 100, tolerance: int = 10) -> DataFrame:
    """by, sim_time, last_here, first_next, lag, synced for every step whose follower is complete too."""
    pairs = _with_following(complete_steps(steps, by, n_sources), by, step)
    lag = F.col("first_next") - F.col("hi")
    return pairs.select(*names(by), "sim_time", "first_next", F.col("hi").alias("last_here"), lag.alias("lag"), (lag > -tolerance).alias("synced"))


def source_delays(steps: DataFrame, by, n_sources: int, step: int = 100, master: str | None = None) -> DataFrame:
    """Delay of every source since the first one got the step; the master's time until the next step."""
    keys = [*names(by), "sim_time"]
    pairs = _with_following(complete_steps(steps, by, n_sources), by, step)
    first = steps.groupBy(*keys, "source").agg(F.min("system_time").alias("system_time"))
    joined = first.join(pairs, keys)
    delay = F.when(F.col("source").eqNullSafe(F.lit(master)), F.col("first_next") - F.col("system_time")).otherwise(F.col("system_time") - F.col("lo"))
    return joined.select(*keys, "source", delay.alias("delay"))


def missing_steps(steps: DataFrame, by, step: float, tolerance: float) -> DataFrame:
    """The step after every gap in an entity's steps; the last gap is left out."""
    filled = rolling.fill_gaps(steps, by, "sim_time", step, tolerance)
    return filled.where("filler").drop("filler")


class StepJudge(StatefulProcessor):
    """State of one entity: a map from open step to the reports for it, and the marks that say what is closed.

    A batch reads and writes only the steps that it reports and their neighbours. The other open steps are looked
    through only when the newest confirmed step leaves the oldest of them behind, or a step far ahead waits.
    """

    def __init__(self, columns: list[str], n_sources: int, step: int, tolerance: int, late: int, silence_ms: int):
        self.columns, self.n_sources, self.step, self.tolerance, self.late, self.silence_ms = columns, n_sources, step, tolerance, late, silence_ms
        self.confirmed = min(2, n_sources)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what a timer should have given up is dropped a day later at the latest
        self.open = handle.getMapState("open", "sim_time long", "sources array<string>, times array<long>", ttlDurationMs=self.silence_ms + DAY_MS)
        self.marks = handle.getValueState("marks", "newest long, closed long, oldest long, ahead boolean, timer long")

    def handleInputRows(self, key, rows, timerValues):
        newest, closed, oldest, ahead, timer = self.marks.get() if self.marks.exists() else (None, None, None, False, None)
        earlier, now = {}, {}
        for part in rows:
            for sim, source, system in zip(part["sim_time"].tolist(), part["source"].tolist(), part["system_time"].tolist()):
                if sim not in now:
                    earlier[sim] = self._reports(sim)
                    if earlier[sim] is None and closed is not None and sim <= closed:
                        continue
                    now[sim] = dict(earlier[sim] or {})
                if source not in (earlier[sim] or {}):              # what came in an earlier batch was first
                    now[sim][source] = min(system, now[sim].get(source, system))
        for sim in list(now):
            for neighbour in (sim - self.step, sim + self.step):
                if neighbour not in now and (found := self._reports(neighbour)) is not None:
                    now[neighbour] = earlier[neighbour] = found
        out, done = [], set()
        for sim in sorted(now):
            here, following = now[sim], now.get(sim + self.step, {})
            if len(here) == self.n_sources and len(following) == self.n_sources:
                first_next, last_here = min(following.values()), max(here.values())
                out.append([*key, sim, first_next, last_here, first_next - last_here, first_next - last_here > -self.tolerance, False])
                done.add(sim)
        sure = [s for s, v in now.items() if len(v) >= self.confirmed]
        newest = max([*sure, *([newest] if newest is not None else [])], default=None)
        for sim, reports in now.items():
            if sim in done:
                if earlier[sim] is not None:
                    self.open.removeKey((sim,))
            elif reports != earlier[sim]:
                self.open.updateValue((sim,), (list(reports), list(reports.values())))
        left = [s for s in now if s not in done]
        oldest = min([*left, *([oldest] if oldest is not None else [])], default=None)
        ahead = ahead or any(newest is None or s > newest for s in left)
        if newest is not None:
            if (oldest is not None and oldest < newest - self.late) or ahead:
                lost, oldest, ahead = self._left_behind(newest, {s for s, v in earlier.items() if v is None})
                out += [[*key, s, None, None, None, None, True] for s in lost]
            closed = max([newest - self.late, *([closed] if closed is not None else [])])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(timer)
        self.marks.update((newest, closed, oldest, ahead, timer))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All sources of the entity fell silent: what is open is given up."""
        lost = sorted(s for s, in self.open.keys())
        self.open.clear()
        if self.marks.exists():
            newest, closed, _, _, _ = self.marks.get()
            self.marks.update((newest, max([*lost, *([closed] if closed is not None else [])], default=None), None, False, None))
        yield self._frame([[*key, s, None, None, None, None, True] for s in lost])

    def close(self) -> None:
        pass

    def _reports(self, sim: int) -> dict[str, int] | None:
        found = self.open.getValue((sim,)) if self.open.containsKey((sim,)) else None
        return None if found is None else dict(zip(*found))

    def _left_behind(self, newest: int, fresh: set[int]) -> tuple[list[int], int | None, bool]:
        """Gives up steps; returns them, the oldest step that stays and whether one is ahead of the newest."""
        lost, oldest, ahead = [], None, False
        for (sim,), (sources, _) in list(self.open.iterator()):
            if sim < newest - self.late or (len(sources) < self.confirmed and sim > newest + self.late and sim not in fresh):
                lost.append(sim)
                self.open.removeKey((sim,))
            else:
                oldest = sim if oldest is None else min(oldest, sim)
                ahead = ahead or sim > newest
        return sorted(lost), oldest, ahead

    def _frame(self, rows: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.columns)
        return frame.astype({"first_next": "Int64", "last_here": "Int64", "lag": "Int64", "synced": "boolean", "incomplete": "boolean"})


def sync_check_stream(steps: DataFrame, by, n_sources: int, step: int = 100, tolerance: int = 10, *, late: int = 60_000,
                      silence_ms: int = 3_600_000) -> DataFrame:
    """The same check on a stream: a pair of steps is emitted when both are complete.

    State per entity holds the steps still open, each under a key of its own. A step is closed when its pair was judged.
    One whose sim_time is `late` behind the newest is given up, so state stays bounded when a source stops: it is emitted
    with `incomplete` true and without a verdict. The newest step is one that at least two sources have reported (where there
    are two), so a single time stamp that is wrong gives up nothing; such a step itself is given up when it lies
    `late` away from all that two sources reported since. A report for a step that was closed opens it no more. An entity
    without any report for `silence_ms` of wall-clock time has all its open steps given up by a timer, and its map of steps has a
    time to live, so entities that end leave no steps behind.
    """
    keys = names(by)
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key_types = ", ".join(f"`{k}` {steps.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{key_types}, sim_time long, first_next long, last_here long, lag long, synced boolean, incomplete boolean"
    columns = [*keys, "sim_time", "first_next", "last_here", "lag", "synced", "incomplete"]
    judge = StepJudge(columns, n_sources, step, tolerance, late, silence_ms)
    return steps.groupBy(*keys).transformWithStateInPandas(judge, out, "Append", "ProcessingTime")
