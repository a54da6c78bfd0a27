"""How far the sources of a language differ in their words, by sorting pointers to word starts.

A task cuts its Arrow batches into slices of bounded size. A slice is one buffer of UTF-8 bytes; every word start in it
is a pointer, and the pointers are sorted by the word they point at, eight bytes at a time: pointers that agree so far
are sorted on by their next eight bytes, the others are done. Equal runs of sorted pointers are the slice's words; a run
gives the occurrences and the documents of the word for each language and source. Words become strings only here, one
per run and source.

Runs of all slices are added up by language and word. A word that every document has arrives once per slice and
source, never once per document. Shares, divergences and ranks are whole numbers throughout.

Cases: null text, lang and source count as ''; rows that share an id are documents of their own; a language without kept words
gives its pairs the value 0; a source alone in its language has no pairs; a word may be as long as a text; a text longer
than a slice is a slice of its own; ties are ranked by the item's UTF-8 bytes; an empty table gives no rows; columns other
than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import cut, field

LEAST_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
SLICE_BYTES = 8 << 20
CELLS = 100_000
LONG_WORD = 64

_LETTERS = np.array([b if b >= 0x80 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
_LETTERS[65:91] += 32
_RUNS = T.StructType([field("lang", "string"), field("source", "string"), field("term", "string"), field("n", "long"), field("docs", "long")])
_SUMS = T.StructType([field("lang", "string"), field("source", "string"), field("item", "string"), field("value", "long")])
# keeps the first k of eight bytes, k = 0..8
_FRONT = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)


def word_starts(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word; `letters` is 0 between words, `offsets` are where texts begin."""
    inside = np.zeros(len(letters) + 1, bool)
    inside[:-1] = letters != 0
    fresh = np.zeros(len(letters) + 1, bool)
    fresh[offsets] = True
    fresh[0] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (fresh | ~before))
    ends = np.flatnonzero(before & (fresh | ~inside))
    return starts, ends - starts


def _eight(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Bytes `depth` to `depth + 8` of each word as one number; zeros after its end. `letters` has eight bytes more than text."""
    windows = np.lib.stride_tricks.sliding_window_view(letters, 8)
    left = np.clip(lengths - depth, 0, 8)
    at = np.minimum(starts + depth, len(windows) - 1)
    return windows[at].view(">u8").ravel().astype(np.uint64) & _FRONT[left]


def sort_pointers(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by word, and the number of the equal run that each pointer in that order is in."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _eight(letters, starts, lengths, 0)
    order = np.argsort(key)
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    depth, active = 8, np.arange(len(order))
    while True:
        active = _unsettled(active, first, lengths[order[active]] > depth)
        if not len(active):
            break
        mine = order[active]
        run = np.cumsum(first[active])
        if depth < LONG_WORD:
            key = _eight(letters, starts[mine], lengths[mine], depth)
            by = np.lexsort((key, run))
            differs = key[by][1:] != key[by][:-1]
        else:                                       # few words are that long: compare what is left of them at once
            rest = [letters[s + depth:s + n].tobytes() for s, n in zip(starts[mine].tolist(), lengths[mine].tolist())]
            by = np.array(sorted(range(len(rest)), key=lambda k: (run[k], rest[k])))
            differs = np.array([rest[a] != rest[b] for a, b in zip(by[1:], by[:-1])], bool)
        order[active] = mine[by]
        first[active[1:]] |= differs                # runs keep their places, so a border between runs is marked already
        if depth >= LONG_WORD:
            break
        depth += 8
    return order, np.cumsum(first) - 1


def _unsettled(active: np.ndarray, first: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Of the places in `active` (whole runs), those in runs of several pointers of which one at least goes on."""
    if not len(active):
        return active
    begin = np.flatnonzero(first[active])
    size = np.diff(np.append(begin, len(active)))
    more = np.logical_or.reduceat(goes_on, begin) & (size > 1)
    return active[np.repeat(more, size)]


def _strings(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words as an Arrow array, copied out of the buffer."""
    ends = np.cumsum(lengths)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    large = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters[take].tobytes()))
    return large.cast(pa.string())


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts in them."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole texts of about `size` bytes; a longer text is a slice of its own."""
    offsets = _buffers(batch.column(0))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _combined(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """The number of each row's pair of values, and the pairs."""
    a, b = left.dictionary_encode(), right.dictionary_encode()
    both = a.indices.to_numpy().astype(np.int64) * len(b.dictionary) + b.indices.to_numpy()
    pairs, number = np.unique(both, return_inverse=True)
    names = [(a.dictionary[int(x) // len(b.dictionary)].as_py(), b.dictionary[int(x) % len(b.dictionary)].as_py()) for x in pairs]
    return number, names


def slice_runs(part: pa.RecordBatch) -> pa.RecordBatch:
    """The equal runs of one slice (text, lang, source): a row per word, language and source; the word '' stands for the group itself."""
    held, offsets = _buffers(part.column(0))
    letters = np.zeros(len(held) + 8, np.uint8)
    letters[:-8] = _LETTERS[held]
    starts, lengths = word_starts(letters[:-8], offsets)
    order, run = sort_pointers(letters, starts, lengths)
    doc = np.searchsorted(offsets, starts[order], "right") - 1
    group, names = _combined(part.column(1), part.column(2))
    held_by, times = np.unique(run * part.num_rows + doc, return_counts=True)       # word and document
    cell = held_by // part.num_rows * len(names) + group[held_by % part.num_rows]
    cells, at, docs = np.unique(cell, return_inverse=True, return_counts=True)      # word and group
    n = np.bincount(at, weights=times, minlength=len(cells)).astype(np.int64)
    lead = order[np.flatnonzero(np.diff(run, prepend=-1))]
    terms = _strings(letters, starts[lead], lengths[lead]).take(pa.array(cells // len(names)))
    which = np.concatenate((cells % len(names), np.arange(len(names))))
    marks = np.zeros(len(names), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in names], pa.string()).take(pa.array(which)), pa.array([x for _, x in names], pa.string()).take(pa.array(which)),
         pa.concat_arrays([terms, pa.array([""] * len(names), pa.string())]), pa.array(np.concatenate((n, marks))), pa.array(np.concatenate((docs, marks)))],
        schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))


def runs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n, docs of every slice of the table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_bytes):
                yield slice_runs(part)

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate((text_col, lang_col, source_col))]
    return docs.select(*filled).mapInArrow(work, _RUNS)


def kept_terms(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Runs added up: lang, source, term, n, lang_n, lead, for the words in `least_docs` documents of their language.

    `lead` marks one row per word of a language. The rows of the word '' name the groups. One shuffle by language and
    word serves the sums and the test.
    """
    word = Window.partitionBy("lang", "term")
    summed = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (summed.withColumns({"df": F.sum("docs").over(word), "lang_n": F.sum("n").over(word), "lead": F.min("source").over(word) == F.col("source")})
            .filter((F.col("df") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "lead"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 2) / total) in exact arithmetic; null without kept words."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(total > 0, F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 2), wide(total))).cast("long")


def group_totals(kept: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per language and source: total and lang_total, the divisors of shares; none, the share of a word that the
    source lacks; shards, how many parts the words of the language make, of about `cells` words times sources each."""
    word = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum(F.when(F.col("lead") & word, 1).otherwise(0)).alias("words"), F.sum("n").alias("lang_n"),
                                     F.sum(F.when(~word, 1).otherwise(0)).alias("sources"))
    total, lang_total = F.col("n") + 2 * F.col("words"), F.col("lang_n") + 2 * F.col("words")
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") * F.col("sources") / cells)).cast("int")
    return groups.join(langs, "lang").select("lang", "source", total.alias("total"), lang_total.alias("lang_total"),
                                             share(F.lit(0), total).alias("none"), shards.alias("shards"))


def _pair_sums(words: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergences of all pairs of sources of one language, added up over the words of one part."""
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    none = pc.fill_null(groups.column("none"), 1).to_numpy()
    terms = words.column("term").combine_chunks().dictionary_encode()
    shares = np.tile(none, (len(terms.dictionary), 1))
    if len(terms):
        shares[terms.indices.to_numpy(), pc.index_in(words.column("source"), names).to_numpy()] = words.column("p").to_numpy()
    one, two, value = [], [], []
    for k in range(len(names) - 1):
        p, q = shares[:, k:k + 1], shares[:, k + 1:]
        sums = ((p - q) ** 2 // (p + q)).sum(axis=0)
        rest = np.arange(k + 1, len(names))
        one += [np.full(len(rest), k), rest]
        two += [rest, np.full(len(rest), k)]
        value += [sums, sums]
    joined = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    first = joined(one)
    lang = pa.array([groups.column("lang")[0].as_py()] * len(first), pa.string())
    return pa.table({"lang": lang, "source": names.take(first), "item": names.take(joined(two)), "value": joined(value)})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          slice_bytes: int = SLICE_BYTES, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other sources by divergence (part
    `pair`), and the `top` words that it uses more than the language does (part `term`)."""
    kept = cut(kept_terms(runs(docs, text_col, lang_col, source_col, slice_bytes), least_docs))
    totals = cut(group_totals(kept, cells))
    words = kept.filter((F.col("term") != "") & (F.col("n") > 0)).join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))

    q = share(F.col("lang_n"), F.col("lang_total"))
    terms = words.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                             F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    parts = words.select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "source", "term", "p")
    spread = totals.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "none")
    sums = parts.groupBy("lang", "shard").cogroup(spread.groupBy("lang", "shard")).applyInArrow(_pair_sums, _SUMS)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return terms.unionByName(pairs).select("lang", "source", "part", "item", "value", "rank")
