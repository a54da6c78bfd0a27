"""Pairing messages: requests with responses, sources with targets, keys with first occurrences."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequential
from .asof import asof_join
from .ordered import Ordered, names


def guarded_join(left: DataFrame, right: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Equi join in which a key with more than one right row raises an error at run time.

    The right side is reduced to one row per key before the join, so a repeated key cannot
    multiply the left side.
    """
    single = right.groupBy(*on).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*take)).alias("__one"))
    joined = left.join(single, on)
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one match for a key"))).otherwise(F.col("__one"))
    return joined.withColumn("__one", checked).select(*left.columns, *[F.col("__one")[c].alias(c) for c in take])


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fifo_match(source: DataFrame, target: DataFrame, by, t: str, *, source_tie=(), target_tie=(),
               keep_source: tuple[str, ...] = (), keep_target: tuple[str, ...] = ()) -> DataFrame:
    """Each target takes the oldest unused source of equal key that is not later.

    Returns every target with t_source and delay, null when unmatched. Matched targets are the ones
    at which the running surplus of targets over sources does not reach a new maximum; the r-th
    matched target takes the r-th source, so the pairing is an equi join on (key, rank).
    """
    keys = names(by)
    s = source.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__side"),
                      F.struct(*[F.col(c) for c in names(source_tie)], F.lit(0)).alias("__tie"),
                      F.struct(F.col(t).alias("t_source"), *keep_source).alias("__s"))
    g = target.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"),
                      F.struct(F.col(t).alias(t), *keep_target).alias("__g"),
                      *[F.col(c).alias(f"__g{i}") for i, c in enumerate(names(target_tie))])
    s = s.withColumn("__st", F.col("__tie")).drop("__tie")
    both = s.unionByName(g, allowMissingColumns=True)
    o = Ordered.of(both, by, "__t", ["__side", "__st", *[f"__g{i}" for i in range(len(names(target_tie)))]])
    o = o.running(__n_src=("sum", F.when(F.col("__side") == 0, 1).otherwise(0).cast("long")),
                  __n_tgt=("sum", F.when(F.col("__side") == 1, 1).otherwise(0).cast("long")))
    o = o.with_columns(__d=F.col("__n_tgt") - F.col("__n_src")).running(__m=("max", "__d"))
    o = o.with_columns(__lost=F.greatest(F.lit(0), "__m")).prev(__plost="__lost")
    ranked = o.df
    sources = ranked.where(F.col("__side") == 0).select(*keys, F.col("__n_src").alias("__rank"), "__s")
    lost = F.col("__lost") > F.coalesce(F.col("__plost"), F.lit(0))
    targets = ranked.where(F.col("__side") == 1).select(
        *keys, "__g", F.when(~lost, F.col("__n_tgt") - F.col("__lost")).alias("__rank"))
    pairs = targets.join(sources, [*keys, "__rank"], "left")
    return pairs.select(*keys, "__g.*", "__s.*").withColumn("delay", F.col(t) - F.col("t_source"))


def fifo_match_bounded(source: DataFrame, target: DataFrame, by, t: str, max_delay: int, *, source_tie=(),
                       target_tie=(), keep_target: tuple[str, ...] = ()) -> DataFrame:
    """As fifo_match, but only sources with 0 <= delay < max_delay count; older ones stay unused.

    With L sources expired before a target, R sources up to it and p sources used or expired so
    far, the target takes source max(p + 1, L + 1) when that is at most R. That recurrence is a
    clamp, so a whole chunk of targets is one clamp and chunks compose.
    """
    keys = names(by)
    arrive = source.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__kind"))
    expire = source.select(*keys, (F.col(t) + F.lit(max_delay)).alias("__t"), F.lit(0).alias("__kind"))
    wanted = target.select(*keys, F.col(t).alias("__t"), F.lit(2).alias("__kind"),
                           F.struct(F.col(t).alias(t), *keep_target).alias("__g"),
                           *[F.col(c).alias(f"__g{i}") for i, c in enumerate(names(target_tie))])
    both = arrive.unionByName(expire).unionByName(wanted, allowMissingColumns=True)
    tie = ["__kind", *[f"__g{i}" for i in range(len(names(target_tie)))]]
    one = lambda kind: ("sum", F.when(F.col("__kind") == kind, 1).otherwise(0).cast("long"))
    o = Ordered.of(both, by, "__t", tie).running(__R=one(1), __L=one(0), __k=one(2))
    targets = o.df.where(F.col("__kind") == 2).select(*keys, "__t", "__k", "__L", "__R", "__g")
    picked = sequential.scan(
        targets.select(*keys, "__t", "__k", "__L", "__R"), keys, "__t", ["__k"], "__k long, __rank long",
        run=_clamp_run, summarise=_clamp_map, enter=_clamp_enter, start=0)
    ranked = Ordered.of(source, by, t, source_tie).number("__rank").df
    ranked = ranked.select(*keys, F.col("__rank").cast("long").alias("__rank"), F.col(t).alias("t_source"))
    pairs = targets.select(*keys, "__k", "__g").join(picked, [*keys, "__k"]).join(ranked, [*keys, "__rank"], "left")
    return pairs.select(*keys, "__g.*", "t_source").withColumn("delay", F.col(t) - F.col("t_source"))


def _clamp_run(rows: dict, state):
    used, ranks = int(state), np.empty(len(rows["__L"]), dtype=object)
    for i, (low, high) in enumerate(zip(rows["__L"].tolist(), rows["__R"].tolist())):
        pick = max(used, low) + 1
        ranks[i] = pick if pick <= high else None
        used = min(pick, high)
    return np.arange(len(ranks)), {"__rank": ranks}


def _clamp_map(rows: dict) -> str:
    # x -> min(max(x + a, b), c), composed over the rows
    a, b, c = 0, -(1 << 62), 1 << 62
    for low, high in zip(rows["__L"].tolist(), rows["__R"].tolist()):
        a, b, c = a + 1, min(max(b + 1, low + 1), high), min(max(c + 1, low + 1), high)
    return json.dumps([a, b, c])


def _clamp_enter(text: str, state) -> int:
    a, b, c = json.loads(text)
    return min(max(int(state) + a, b), c)


def ordinal_pairs(calls: DataFrame, responses: DataFrame, by, t: str, *, tie=()) -> DataFrame:
    """k-th call with k-th counted response; a response counts only while a call is unanswered.

    Calls without a response get an infinite delay.
    """
    keys = names(by)
    c = calls.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__side"), *names(tie))
    r = responses.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), *names(tie))
    o = Ordered.of(c.unionByName(r), by, "__t", ["__side", *names(tie)])
    one = lambda side: ("sum", F.when(F.col("__side") == side, 1).otherwise(0).cast("long"))
    o = o.running(__C=one(0), __A=one(1)).with_columns(__d=F.col("__A") - F.col("__C")).running(__m=("max", "__d"))
    o = o.with_columns(__U=F.greatest(F.lit(0), "__m")).prev(__pU="__U")
    counted = F.col("__U") <= F.coalesce(F.col("__pU"), F.lit(0))
    called = o.df.where(F.col("__side") == 0).select(*keys, F.col("__C").alias("ordinal"), F.col("__t").alias("t_call"))
    answered = o.df.where((F.col("__side") == 1) & counted).select(
        *keys, (F.col("__A") - F.col("__U")).alias("ordinal"), F.col("__t").alias("t_response"))
    paired = called.join(answered, [*keys, "ordinal"], "left")
    wait = (F.col("t_response") - F.col("t_call")).cast("double")
    return paired.withColumn("delay", F.coalesce(wait, F.lit(float("inf"))))


def request_chain(df: DataFrame, by, t: str, steps: list[tuple[str, Column, str]], tie=()) -> DataFrame:
    """One row per entity with the time t_<name> of each step: the first (or last) row that meets the
    step's condition later than the step before it. Null from the first missing step on.

    Steps taken with "first" share one ordered pass; a "last" step needs the whole log, so its time
    is one aggregate row per entity that is joined back for the steps after it.
    """
    keys = names(by)
    rows, times, since = df, df.select(*keys).distinct(), None
    i = 0
    while i < len(steps):
        batch = [steps[i]]
        while batch[-1][2] == "first" and i + len(batch) < len(steps) and steps[i + len(batch)][2] == "first":
            batch.append(steps[i + len(batch)])
        i += len(batch)
        o = Ordered.of(rows, by, t, tie) if len(batch) > 1 else None
        aggregates, bound = [], since
        for place, (name, condition, which) in enumerate(batch):
            ok = condition if bound is None else condition & (F.col(t) > F.col(bound))
            hit = F.when(ok, F.col(t))
            aggregates.append((F.min if which == "first" else F.max)(hit).alias(f"t_{name}"))
            if place + 1 < len(batch):
                bound = f"__at_{name}"
                o = o.running(**{bound: ("min", hit)})
        found = (rows if o is None else o.df).groupBy(*keys).agg(*aggregates)
        times = times.join(found, keys, "left")
        if i < len(steps):
            since = f"__since_{batch[-1][0]}"
            rows = df.join(found.select(*keys, F.col(f"t_{batch[-1][0]}").alias(since)), keys)
    return times


def first_by_key(df: DataFrame, key, t: str, tie=()) -> DataFrame:
    """The first row of every key."""
    keys = names(key)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(t, *names(tie))).alias("__f")
    return df.groupBy(*keys).agg(first).select(*keys, "__f.*")


def lookup_first(requests: DataFrame, answers: DataFrame, key, t: str, *, tie=(), columns: list[str]) -> DataFrame:
    """Every request with the first answer of its key; `known` is false when there is none."""
    keys = names(key)
    first = first_by_key(answers.select(*keys, F.col(t).alias("__t"), *names(tie), *[c for c in columns if c != t]), keys, "__t", tie)
    taken = first.select(*keys, F.col("__t").alias("t_answer"), *[c for c in columns if c != t], F.lit(True).alias("known"))
    return requests.join(taken, keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def complete_parts(df: DataFrame, by, part: str, n: int) -> DataFrame:
    """Whether all n distinct parts of a message were received."""
    return df.groupBy(*names(by)).agg(F.count_distinct(part).alias("n_parts")).withColumn("complete", F.col("n_parts") == n)


def counts_around(sent: DataFrame, acks: DataFrame, key, t: str) -> DataFrame:
    """Transmissions before and from the first acknowledgement on; all before when there is none."""
    keys = names(key)
    first = acks.groupBy(*keys).agg(F.min(t).alias("t_ack"))
    seen = sent.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("__n")).join(first, keys, "left")
    before = F.col("t_ack").isNull() | (F.col(t) < F.col("t_ack"))
    return seen.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(before, F.col("__n"))), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum(F.when(~before, F.col("__n"))), F.lit(0)).alias("n_after"), F.max("t_ack").alias("t_ack"))


def hop_latency(hops: list[tuple[str, DataFrame]], key, t: str) -> DataFrame:
    """First time of a key at every hop and the latency from hop to hop; kept when the first hop saw it."""
    keys = names(key)
    out = None
    for name, df in hops:
        first = df.groupBy(*keys).agg(F.min(t).alias(f"t_{name}"))
        out = first if out is None else out.join(first, keys, "left")
    for (a, _), (b, _) in zip(hops, hops[1:]):
        out = out.withColumn(f"{a}_to_{b}", F.col(f"t_{b}") - F.col(f"t_{a}"))
    return out


def drop_repeats(df: DataFrame, key, t: str, channel: str, period: float, tie=()) -> DataFrame:
    """One row per message sent over several channels within `period`, with the latest time and channel.

    A message copies a kept one when it has the same key and another channel within the period;
    the kept one then takes the later time and channel and may absorb further copies. So a row is a
    copy exactly when the row before it went over another channel within the period, and a kept row
    ends at the last channel change that it reaches by steps of at most the period.
    """
    keys = names(key)
    here = F.struct(F.col(t).alias("t"), F.col(channel).alias("c"))
    o = Ordered.of(df, key, t, tie).prev(__p=here)
    change = F.col("__p").isNull() | ~F.col("__p.c").eqNullSafe(F.col(channel))
    o = o.with_columns(__head=change, __copy=change & F.col("__p").isNotNull() & (F.col(t) - F.col("__p.t") <= period))
    # the next channel change after the row
    o = o.ahead(__h=F.when(F.col("__head"), here)).next(__nh="__h")
    o = o.with_columns(__on=F.coalesce(F.col("__nh.t") - F.col(t) <= period, F.lit(False)))
    # where a chain of channel changes ends, seen from the change at or after the row
    o = o.ahead(__end=F.when(F.col("__head") & ~F.col("__on"), here)).next(__nend="__end")
    final = F.when(~F.col("__on"), here).otherwise(F.col("__nend"))
    kept = o.df.where(~F.col("__copy")).withColumn("__z", final)
    return kept.select(*keys, F.col("__z.t").alias(t), F.col("__z.c").alias(channel), F.col(t).alias("t_first"))


def contains_all(df: DataFrame, whole: str, members: str) -> Column:
    """True when the array `members` lies wholly in the array `whole`."""
    return F.size(F.array_except(members, whole)) == 0


def next_after(events: DataFrame, other: DataFrame, by, t: str, *, tie=(), columns: list[str]) -> DataFrame:
    """First message of another topic at or after each event, with the time to it."""
    right = other.withColumn("t_next", F.col(t))
    joined = asof_join(events, right, by, t, direction="forward", columns=["t_next", *columns], right_tie=tie)
    return joined.withColumn("wait", F.col("t_next") - F.col(t))


def alternating_pairs(df: DataFrame, by, t: str, tie, call: Column, answer: Column, columns: list[str]) -> DataFrame:
    """Calls paired with answers where a call waits for its answer: further calls are ignored until
    the first answer, and answers without an open call are ignored too.

    Returns by, ordinal, t_call, t_answer and <column>_call, <column>_answer; answer null when open.
    """
    keys = names(by)
    side = F.when(call, 0).when(answer, 1)
    o = Ordered.of(df.withColumn("__side", side).where(F.col("__side").isNotNull()), by, t, tie)
    heads = o.prev(__was="__side").where(F.col("__was").isNull() | (F.col("__was") != F.col("__side")))
    heads = heads.next(**{f"__n_{c}": c for c in [t, *columns]})
    calls = heads.where(F.col("__side") == 0).number("ordinal").df
    return calls.select(*keys, "ordinal", F.col(t).alias("t_call"), F.col(f"__n_{t}").alias("t_answer"),
                        *[x for c in columns for x in (F.col(c).alias(f"{c}_call"), F.col(f"__n_{c}").alias(f"{c}_answer"))])
