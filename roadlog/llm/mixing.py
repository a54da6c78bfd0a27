"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in a shuffled order that depends on ids alone. A document's
virtual finish time is the queue's tokens up to and with it, divided by the target of its source;
when a queue is through it starts again, up to `cap` times. All items in the order of their finish
times, cut where the running total reaches the budget, are the mix.

No window covers a whole source or the whole table. A queue is cut into slots by the leading digits of
the shuffle key, a slot of about `slot_rows` documents; sums per slot give the offset of each slot. The
global order is cut into ranges of finish time the same way, and only the range that holds the end of
the budget is sorted whole.

Cases: a null text has size 0 and is never taken; null sources are one source, sorted last; rows that
share id and size are ordered arbitrarily among themselves, which gives the same rows; an empty table
gives no rows; columns other than those named are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlog.llm.common import WORD, cut, pieces

SLOT_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words and the shuffle key of each document."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col).cast("string")).alias("size"), key.alias("u"))


def source_sizes(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, n_rows."""
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights for the sources by code point, null last, from a repeating cycle."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (at % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """The target of each source: `share` of all tokens by weight, none above `cap` times its size.

    The excess of capped sources goes to the others by weight, which is filling to one level:
    target = min(cap * size, level * weight). Sources in the order in which they fill up give the level.
    """
    room = F.col("source_size") * cap
    fills = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    steps = (sources
             .withColumn("__all", F.sum("source_size").over(whole) * float(min(share, cap)))
             .withColumn("__full", F.sum(room).over(fills.rowsBetween(Window.unboundedPreceding, 0)) - room)
             .withColumn("__open", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("__level", (F.col("__all") - F.col("__full")) / F.col("__open")))
    level = F.min(F.when(F.col("__level") <= room / F.col("weight"), F.struct(room / F.col("weight"), F.col("__level").alias("level")))).over(whole)
    return (steps.withColumn("__at", level)
            .withColumn("target", F.least(room.cast("double"), F.coalesce(F.col("__at.level") * F.col("weight"), room.cast("double"))))
            .withColumnRenamed("__all", "budget")
            .drop("__full", "__open", "__level", "__at"))


def queued(rows: DataFrame, sources: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Each document with `upto`, the tokens of its source's queue up to and with it."""
    joined = rows.join(sources.select(F.col("source").alias("__s"), "source_size", "n_rows", "target"),
                       F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    part = F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("double") * F.ceil(F.col("n_rows") / slot_rows) / 2.0 ** 32)
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    slotted = joined.withColumn("__q", named).withColumn("__slot", part.cast("long"))
    sums = slotted.groupBy("__q", "__slot").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__q").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__q", "__slot", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__q", "__slot").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (slotted.join(offsets, ["__q", "__slot"], "left")
            .withColumn("upto", F.col("__offset") + F.sum("size").over(inside))
            .drop("__slot", "__offset"))


def finish(copy: int) -> Column:
    """Virtual finish time of a document's copy; a source without tokens finishes at once."""
    return F.when(F.col("target") > 0, (F.col("source_size") * copy + F.col("upto")) / F.col("target")).otherwise(0.0)


def mix(rows: DataFrame, sources: DataFrame, cap: int = 2, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Documents with `copies`, how often the mix takes them. `rows` as of `sized`, `sources` as of `targets`."""
    table = cut(queued(rows, sources, slot_rows))
    n = table.count()
    if n == 0:
        return table.withColumn("copies", F.lit(0)).drop("u", "upto", "n_rows", "__q")
    ranges = pieces(n, slot_rows)
    item = F.struct(*[F.expr("__t.finish"), F.col("__q"), F.col("u"), F.col("doc_id"), F.col("size"), F.expr("__t.copy")])
    items = (table.filter("size > 0")
             .withColumn("__t", F.explode(F.array(*[F.struct(finish(c).alias("finish"), F.lit(c).alias("copy")) for c in range(cap)])))
             .withColumn("__range", F.floor(F.expr("__t.finish") * ranges).cast("long")))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sums = items.groupBy("__range").agg(F.sum("size").alias("tokens"))
    total = sources.agg(F.max("budget")).first()[0]
    end = (sums.withColumn("running", F.sum("tokens").over(upto)).filter(F.col("running") > total)
           .orderBy("__range").select("__range", (F.col("running") - F.col("tokens")).alias("before")).first())
    if end is None:
        return table.withColumn("copies", F.lit(cap)).drop("u", "upto", "n_rows", "__q")
    inside = Window.orderBy("__item").rowsBetween(Window.unboundedPreceding, 0)
    last = (items.filter(F.col("__range") == end["__range"]).withColumn("__item", item)
            .withColumn("running", F.sum("size").over(inside) + end["before"]).filter(F.col("running") <= total)
            .agg(F.max("__item").alias("item")).select("item.*").first())

    def taken(copy: int) -> Column:
        at = F.floor(finish(copy) * ranges).cast("long")
        early = at < end["__range"]
        if last[0] is None:
            return early.cast("int")
        mine = [finish(copy), F.col("__q"), F.col("u"), F.col("doc_id"), F.col("size"), F.lit(copy)]
        within = F.lit(True)
        for column, bound in reversed(list(zip(mine, last))):
            within = (_below(column, bound) | (column.eqNullSafe(F.lit(bound)) & within))
        return (early | ((at == end["__range"]) & within)).cast("int")

    copies = sum((taken(c) for c in range(1, cap)), taken(0))
    return table.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).drop("u", "upto", "n_rows", "__q")


def _below(column: Column, bound: object) -> Column:
    """column < bound in the order of a sort, where null comes first."""
    if bound is None:
        return F.lit(False)
    return F.coalesce(column < F.lit(bound), F.lit(True))
