"""Ranked search of many items at once, the other way round: documents stream through an index of the items.

The items' terms are numbered and inverted: each term lists the items that hold it. A first pass over the documents
counts their terms and writes those counts that some item asks for, with the document's length; document frequencies are
added up from that table. In the second pass each task streams these counts through the inverted index: a document's term
adds its weight to all items on the term's list, and every item keeps its best documents in a heap of `top`. A task returns
heaps of bounded size; heaps are merged in two steps, first within groups of tasks.

The index that goes to the tasks is bounded: items fall into blocks of about `BLOCK_POSTINGS` pairs of item and term, one
block at a time is inverted and sent, and any number of blocks is worked off. Terms of an item count once; rows that
share an item's id are one item with the terms of all of them, so copies of an item do not grow a block.

Cases: a null or empty text has no terms, as a document and as an item; a document without terms counts for nothing;
each row of documents is a document, also where ids repeat; equal scores are ordered by id, null ids last; an item without a
document above 0 has no rows; long documents are counted whole; empty tables give no rows; columns other than id and text
are not read. Document ids are whole numbers, item ids of any type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import cut, field, pieces, sliced

TOP = 10
BLOCK_POSTINGS = 400_000
LENGTH_SHARE = 90                    # how much of a term's damping follows the document's length, in hundredths
SLAB = 2_000_000
MERGE_GROUPS = 64

# terms are runs of ASCII letters and digits and of all other characters beyond ASCII; letters A-Z count as a-z
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_NO_ID = np.iinfo(np.int64).max
_COUNTED = T.StructType([field("doc_id", "long"), field("n", "long"), field("terms", "int[]"), field("tfs", "int[]")])
_HEAPS = T.StructType([field("item", "int"), field("doc_id", "long"), field("score", "long")])


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the terms of each item, once each."""
    out = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), field("term", "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = [sorted(set(terms_of(x))) for x in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([t.decode() for x in found for t in x], pa.string())],
                                                 ["item_id", "term"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, out).distinct()


class Inverted:
    """The items of one block: numbered terms, and for each term the numbers of the items that hold it."""

    def __init__(self, pairs: pa.Table):
        ids, terms = pairs.column("item_id").combine_chunks(), pairs.column("term").combine_chunks().dictionary_encode()
        coded = ids.dictionary_encode(null_encoding="encode")
        self.ids = coded.dictionary
        self.terms = {t.encode(): k for k, t in enumerate(terms.dictionary.to_pylist())}
        term = terms.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.items = coded.indices.to_numpy()[order].astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.terms))))).astype(np.int64)


def counts(docs: DataFrame, index: Inverted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs: the length of each document and its counts of indexed terms; documents without terms are left out."""
    known = index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sizes, at, terms, tfs, keep = [], [0], [], [], []
                for text in part.column(1).to_pylist():
                    found = terms_of(text)
                    keep.append(bool(found))
                    if found:
                        held = [(known[t], c) for t, c in Counter(found).items() if t in known]
                        sizes.append(len(found))
                        terms += [t for t, _ in held]
                        tfs += [c for _, c in held]
                        at.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep, pa.bool_())), pa.array(sizes, pa.int64()), *lists],
                                                 ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, _COUNTED)


class Heaps:
    """For each item its best documents so far, `top` at most: highest score, then smallest id."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    def push(self, scores: np.ndarray, doc: np.ndarray, nameless: np.ndarray) -> None:
        """A score for each document (row) and item (column); 0 stands for none."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[row, item]))
        doc, nameless = np.concatenate((self.doc, doc[row])), np.concatenate((self.nameless, nameless[row]))
        order = np.lexsort((doc, nameless, -score, item))
        item = item[order]
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        stay = place < self.top
        self.item, self.score, self.doc, self.nameless = item[stay], score[order][stay], doc[order][stay], nameless[order][stay]
        full = place == self.top - 1
        self.least[item[full]] = np.maximum(1, score[order][full])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.item.astype(np.int32)), pa.array(self.doc, mask=self.nameless), pa.array(self.score)],
                                          ["item", "doc_id", "score"])


def _slabs(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose costs add up to `most`; one document at least."""
    upto = np.concatenate(([0], np.cumsum(cost)))
    at = 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield at, end
        at = end


def stream(counted: DataFrame, index: Inverted, weights: np.ndarray, docs: int, length: int, top: int = TOP, slab: int = SLAB) -> DataFrame:
    """item, doc_id, score: the heaps of each task, from the counts of the documents, the terms' weights, the
    number of documents with terms and their length in all."""
    items, offsets, n_items = index.items, index.offsets, len(index.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n_items, top)
        for batch in batches:
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = pc.fill_null(batch.column(0), _NO_ID).to_numpy()
            damp = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // length for n in batch.column(1).to_pylist()], np.int64)
            terms, tfs = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            held = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(held)), held)
            value = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * damp[row]))
            lists = offsets[terms + 1] - offsets[terms]
            edge = np.concatenate(([0], np.cumsum(held)))
            cost = np.bincount(row, weights=lists, minlength=len(held)).astype(np.int64) + n_items
            for begin, end in _slabs(cost, slab):
                mine = slice(edge[begin], edge[end])
                size = lists[mine]
                upto = np.cumsum(size)
                place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(offsets[terms[mine]] - (upto - size), size)
                scores = np.zeros((end - begin) * n_items, np.int64)
                np.add.at(scores, np.repeat((row[mine] - begin) * n_items, size) + items[place], np.repeat(value[mine], size))
                heaps.push(scores.reshape(end - begin, n_items), doc[begin:end], nameless[begin:end])
        yield heaps.batch()

    return counted.mapInArrow(run, _HEAPS)


def merged(heaps: DataFrame, by: str, top: int = TOP) -> DataFrame:
    """The best documents of each item with their rank; heaps of groups of tasks are merged first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = Window.partitionBy(by, "__group").orderBy(*order)
    some = (heaps.withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
            .withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top).drop("__group")


def weights_of(counted: DataFrame, docs: int, terms: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for each term of the block."""
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("count").to_numpy()
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    pairs = cut(item_terms(items, item_id, item_text))
    blocks = pieces(pairs.count(), block_postings)
    out = []
    for block in range(blocks):
        held = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not len(held) and (out or block < blocks - 1):
            continue
        index = Inverted(held)
        counted = cut(counts(docs, index, id_col, text_col))
        n, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        heaps = stream(counted, index, weights_of(counted, n, len(index.terms)), n, length or 1, top)
        best = cut(merged(heaps, "item", top))
        names = docs.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(len(index.ids)), pa.int32()), "item_id": index.ids}),
            T.StructType([field("item", "int"), pairs.schema["item_id"]]))
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first
