"""Scores by cross-entropy difference: a target and a background bigram model over one vocabulary.

The target model counts the documents marked as target, the background model counts all. Both have the same form,
P(w | u) = (c(u w) + PRIOR P(w)) / (c(u) + PRIOR) and P(w) = (c(w) + FLOOR) / (T + FLOOR * VOCABULARY), the end of a text being an
event that is not scored. A document is left out of both models when it is scored, else every document of the target would look like it.
Its score is the mean over its words of the background's loss less the target's: above zero, it is closer to the target.

Counts are exact and over all documents, and none is kept from the models. Documents lie in groups by id. A group lists its distinct words
and bigrams once, with their counts in both classes, in shards by hash; a shard adds up the groups' lists and tells each group
the totals of what occurs more than once in the corpus. What occurs once is the document's own and left out anyway. So neither the vocabulary nor
the bigrams are ever in one place, and a word that is in every document reaches its shard once per group.
The texts are dealt once; listing and scoring read that exchange.

Cases: null and empty texts have no words, losses and score 0; a marked id that is null or has no document counts for nothing; rows that
share an id are documents of their own, of which each is left out by itself; without target documents the target model is uniform; an empty
table gives no rows; only the named columns are read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import cut, field, groups_of, id_text, map_texts
from roadlog.llm.decontaminate import words
from roadlog.llm.lines import as_table
from roadlog.llm.rlz import mixed

PRIOR = 10.0
FLOOR = 0.05
VOCABULARY = 1 << 20
GROUP_ROWS = 768
SHARD_ROWS = 1536

_START = np.uint64(0x5851F42D4C957F2D)          # the context of a text's first word
_LISTS = T.StructType([field("__lm_shard", "long"), field("__lm_group", "long"), field("keys", "binary"), field("target", "binary"), field("all", "binary")])
_TOTALS = T.StructType([field("__lm_group", "long"), field("shard", "long"), field("known", "binary"), field("target", "binary"), field("all", "binary")])
SCORES = [field("n_words", "long"), field("loss_target", "double"), field("loss_background", "double"), field("score", "double")]


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of a text and of the bigrams that they end."""
    ws = words(text)
    w = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws)) | np.uint64(1)
    before = np.concatenate((np.array([_START]), w[:-1])) if len(w) else w
    return w, mixed(before * np.uint64(0x9E3779B97F4A7C15) + w) & ~np.uint64(1)          # words are odd, bigrams even


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: what they have in common costs next to nothing."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the steps between them."""
    return np.diff(keys, prepend=np.uint64(0))


class Group:
    """The documents of a group: their words and bigrams, and the distinct keys in the order in which shards get them."""

    def __init__(self, table: pa.Table, marks: pa.Table, shards: int):
        marked = set(marks.column("doc_id").to_pylist())
        self.target = np.array([i is not None and i in marked for i in table.column("doc_id").to_pylist()])
        self.docs = [coded(t or "") for t in table.column("text").to_pylist()]
        every = np.concatenate(list(chain.from_iterable(self.docs)) or [np.zeros(0, np.uint64)])
        keys, at = np.unique(every, return_inverse=True)
        sizes = np.array([2 * len(w) for w, _ in self.docs])
        of_target = np.repeat(self.target, sizes)
        self.all = np.bincount(at, minlength=len(keys))
        self.in_target = np.bincount(at[of_target], minlength=len(keys))
        shard = (mixed(keys) >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        self.keys, self.shard, self.all, self.in_target = keys[order], shard[order], self.all[order], self.in_target[order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.places = np.split(place[at], np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.parts = {int(self.shard[p[0]]): p for p in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(self.shard)) + 1) if len(p)}


def _listing(shards: int):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table([], _LISTS)
        g = Group(table, marks, shards)
        group = table.column("__lm_group")[0].as_py()
        return as_table([(shard, group, packed(steps(g.keys[p])), packed(g.in_target[p].astype(np.int32)), packed(g.all[p].astype(np.int32)))
                         for shard, p in g.parts.items()], _LISTS)
    return run


def _adding(table: pa.Table) -> pa.Table:
    """For each list the totals of its keys, where a key occurs more than once."""
    lists = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    add = lambda name, at: np.bincount(at, np.concatenate([unpacked(x, np.int32) for x in table.column(name).to_pylist()])).astype(np.int64)
    _, at = np.unique(np.concatenate(lists), return_inverse=True)
    target, every = add("target", at), add("all", at)
    rows, begin = [], 0
    for group, shard, keys in zip(table.column("__lm_group").to_pylist(), table.column("__lm_shard").to_pylist(), lists):
        mine = at[begin:begin + len(keys)]
        begin += len(keys)
        known = every[mine] > 1
        rows.append((group, shard, np.packbits(known).tobytes(), packed(target[mine[known]]), packed(every[mine[known]])))
    return as_table(rows, _TOTALS)


def _scoring(shards: int, sizes: dict[str, float], out: T.StructType):
    def losses(bigram: np.ndarray, word: np.ndarray, context: np.ndarray, total: float) -> np.ndarray:
        p = (word + FLOOR) / (total + FLOOR * VOCABULARY)
        return -np.log((bigram + PRIOR * p) / (context + PRIOR))

    def run(key: tuple, table: pa.Table, marks: pa.Table, totals: pa.Table) -> pa.Table:
        g = Group(table, marks, shards)
        count = {"target": g.in_target.astype(np.float64), "all": g.all.astype(np.float64)}
        for row in totals.to_pylist():
            part = g.parts[row["shard"]]
            known = part[np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(part)).astype(bool)]
            for name in count:
                count[name][known] = unpacked(row[name], np.int64)
        rows = {f.name: [] for f in SCORES}
        for (w, _), places, own_target in zip(g.docs, g.places, g.target):
            n = len(w)
            rows["n_words"].append(n)
            if not n:
                for name in ("loss_target", "loss_background", "score"):
                    rows[name].append(0.0)
                continue
            kinds, at, times = np.unique(places, return_inverse=True, return_counts=True)
            means = []
            for name, mine in (("target", float(own_target)), ("all", 1.0)):
                rest = (count[name][kinds] - mine * times)[at]              # the corpus without this document
                context = np.concatenate(([sizes[f"docs_{name}"] - mine], rest[:n - 1]))
                means.append(float(losses(rest[n:], rest[:n], context, sizes[f"words_{name}"] - mine * n).sum()) / n)
            rows["loss_target"].append(means[0])
            rows["loss_background"].append(means[1])
            rows["score"].append(means[1] - means[0])
        kinds_ = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table({"doc_id": table.column("doc_id").combine_chunks(), **{f.name: pa.array(rows[f.name], k) for f, k in zip(SCORES, kinds_)}})
    return run


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document n_words, both mean losses and their difference. `target` has the ids of the target documents."""
    rows = id_text(docs, id_col, text_col)
    marked = target.select(F.col(id_col).cast(rows.schema["doc_id"].dataType).alias("doc_id")).filter("doc_id is not null").distinct()
    counted = cut(map_texts(rows, lambda texts: {"n": [len(words(t)) for t in texts]}, [field("n", "long")]).filter("n > 0"))
    of_target = counted.join(marked, "doc_id", "left_semi")
    sums = [x.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first() for x in (of_target, counted)]
    sizes = {f"{what}_{name}": float(s[what]) for s, name in zip(sums, ("target", "all")) for what in ("docs", "words")}
    groups, shards = groups_of(docs, text_col, group_rows, shard_rows)
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long")
    dealt = rows.withColumn("__lm_group", group).repartition("__lm_group")
    marks = marked.withColumn("__lm_group", group)
    lists = dealt.groupBy("__lm_group").cogroup(marks.groupBy("__lm_group")).applyInArrow(_listing(shards), _LISTS)
    totals = lists.groupBy("__lm_shard").applyInArrow(_adding, _TOTALS)
    out = T.StructType([dealt.schema["doc_id"], *SCORES])
    # totals and marks of a group come in one table: a cogroup has two sides
    ids = marks.select("__lm_group", F.col("doc_id").alias("mark"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in _TOTALS[1:]])
    told = totals.withColumn("mark", F.lit(None).cast(rows.schema["doc_id"].dataType)).unionByName(ids)
    work = _scoring(shards, sizes, out)

    def run(table: pa.Table, told_rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], k) for f, k in zip(out, [table.schema.field("doc_id").type, pa.int64(), *[pa.float64()] * 3])})
        known = told_rows.column("shard").is_valid()
        marks_ = pa.table({"doc_id": told_rows.filter(told_rows.column("mark").is_valid()).column("mark")})
        return work((), table, marks_, told_rows.filter(known))

    return dealt.groupBy("__lm_group").cogroup(told.groupBy("__lm_group")).applyInArrow(run, out)
