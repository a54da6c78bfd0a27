"""Repeated passages by relative Lempel-Ziv parsing: documents as factors of what stands earlier in the corpus.

The reference is the corpus itself. Each document falls into blocks of words that its content sets: the smallest hash of five
words in a window of `window` words is the window's anchor, and the windows around one anchor form a block. Equal windows have equal
anchors, so whatever repeats, repeats among the blocks of one anchor. All blocks of all documents are indexed, in shards by anchor: the
index keeps, for each block content, its first place (smallest document id, then start).

A document is parsed greedily against this index: windows of a block that occurs earlier continue the factor as long as the source
continues, too. Where a factor ends, whole blocks no longer match, but single windows may. The blocks that are the first of their content, while
their anchor has other contents, are such boundaries; their windows are looked up one by one, in shards by anchor again. Factors
of at least `window` words are the duplicate spans. The result is exact: a word goes if and only if a window over it starts earlier.

Documents lie in groups by id; a group lists each block content once, so a passage that every document holds reaches a shard once
per group. Groups and shards grow in number with the table, not in size. The texts are dealt once; listing, boundary check and
removal read that exchange.

Cases: a null or empty text, or one of fewer words than the window, has no windows and loses nothing; rows that share an id stand at the same
place, so equal rows do not remove each other; rows without id stand before all others, at one place; an empty table gives no
rows; only id and text are read. Ids are whole numbers. Hashes have 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import field, groups_of
from roadlog.llm.lines import as_table

WINDOW = 20
ANCHOR = 5
GROUP_ROWS = 512
SHARD_ROWS = 2048
CHUNK_WORDS = 500_000

_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

_LISTS = T.StructType([field("__rlz_shard", "long"), field("__rlz_group", "long"), field("anchors", "binary"), field("contents", "binary"),
                       field("ids", "binary"), field("starts", "binary"), field("counts", "binary")])
_FIRSTS = T.StructType([field("__rlz_group", "long"), field("level", "long"), field("keys", "binary"), field("ids", "binary"), field("starts", "binary"),
                        field("more", "binary")])
FACTORS = [field("n_words", "long"), field("n_removed", "long"), field("starts", "int[]"), field("lengths", "int[]"),
           field("source_ids", "long[]"), field("source_starts", "int[]"), field("kept", "string")]


class Words(NamedTuple):
    """The words of some documents in one row, with the blocks of their windows."""

    texts: list[list[bytes]]
    names: np.ndarray           # id of each document
    begin: np.ndarray           # where each document begins in the row
    doc: np.ndarray             # per block: its document
    first: np.ndarray           # per block: first and last window, as places in the row
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    window: np.ndarray          # hash of the window at each place

    def start(self) -> np.ndarray:
        return self.first - self.begin[self.doc]

    def keys(self, blocks: np.ndarray | slice = slice(None)) -> np.ndarray:
        return key(self.anchor[blocks], self.content[blocks])


def key(anchors: np.ndarray, contents: np.ndarray) -> np.ndarray:
    """One number for anchor and content, to look up among the blocks of a group."""
    return mixed(anchors) * np.uint64(_BASE) + contents


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def analysed(names: list[int], texts: list[str], window: int) -> Words:
    """Words, windows and blocks of the documents."""
    parts = [t.encode().split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    n = int(begin[-1])
    hashed = xxhash.xxh64_intdigest
    words = np.fromiter((hashed(w) for p in parts for w in p), np.uint64, n)
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)))

    def run(first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64))

    doc = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(max(0, n - window + 1))
    if not len(place):
        none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(parts, np.array(names, np.int64), begin, none, none, none, hashes, hashes, hashes)
    value = run(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    at = np.arange(len(value))
    width, reach = 1, window - ANCHOR + 1               # the smallest of `reach` anchors from each place on, the leftmost of equals
    while width < reach:
        step = min(width, reach - width)
        left, right = value[:-step], value[step:]
        at = np.where(right < left, at[step:], at[:-step])
        value = np.minimum(left, right)
        width += step
    valid = place + window <= begin[doc[place] + 1]
    place, value, at = place[valid], value[valid], at[valid]
    hashes = np.zeros(max(0, n - window + 1), np.uint64)
    hashes[place] = run(place, place + window)
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.concatenate((place[cut[1:] - 1], place[-1:])) if len(cut) else place[:0]
    first = place[cut]
    return Words(parts, np.array(names, np.int64), begin, doc[first], first, last, value[cut], run(first, last + window), hashes)


def chunks(table: pa.Table, window: int) -> Iterator[tuple[int, Words]]:
    """The documents of a group, a bounded number of words at a time; a longer document by itself."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    at = size = 0
    for n, text in enumerate(texts):
        size += len(text or "") // 4
        if size > CHUNK_WORDS or n == len(texts) - 1:
            part = slice(at, n + 1)
            yield at, analysed([_NO_ID if i is None else i for i in ids[part]], [t or "" for t in texts[part]], window)
            at, size = n + 1, 0


def _listed(group: int, shards: int, anchors: np.ndarray, contents: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """Rows for the shards: each content once, with its first place in the group and how often it occurs there."""
    order = np.lexsort((starts, ids, contents, anchors))
    anchors, contents, ids, starts = anchors[order], contents[order], ids[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (contents[1:] != contents[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(at, append=len(order))
    anchors, contents, ids, starts = anchors[at], contents[at], ids[at], starts[at]
    shard = (mixed(anchors) >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            out.append((int(shard[part[0]]), group, anchors[part].tobytes(), contents[part].tobytes(), ids[part].tobytes(),
                        starts[part].astype(np.int32).tobytes(), counts[part].astype(np.int32).tobytes()))
    return out


def _blocks(window: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        found = [(w.anchor, w.content, w.names[w.doc], w.start()) for _, w in chunks(table, window)]
        return as_table(_listed(table.column("__rlz_group")[0].as_py(), shards, *map(np.concatenate, zip(*found))), _LISTS)
    return run


def _firsts(level: int):
    """Per group, the contents that occur more than once or whose anchor has other contents, with their first place."""
    def run(table: pa.Table) -> pa.Table:
        kinds = {"anchors": np.uint64, "contents": np.uint64, "ids": np.int64, "starts": np.int32, "counts": np.int32}
        parts = {n: [np.frombuffer(x, k) for x in table.column(n).to_pylist()] for n, k in kinds.items()}
        sizes = [len(x) for x in parts["anchors"]]
        whole = {n: np.concatenate(x) for n, x in parts.items()}
        order = np.lexsort((whole["starts"], whole["ids"], whole["contents"], whole["anchors"]))
        a, c = whole["anchors"][order], whole["contents"][order]
        new_anchor = np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new = new_anchor.copy()
        new[1:] |= c[1:] != c[:-1]
        content, anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        head = order[np.flatnonzero(new)]
        times = np.bincount(content, whole["counts"][order])
        kinds_of = np.bincount(anchor[new])
        more, again = np.zeros(len(a), bool), np.zeros(len(a), bool)
        more[order], again[order] = kinds_of[anchor] > 1, times[content] > 1
        first = np.zeros(len(a), np.int64)
        first[order] = head[content]
        out, at = [], 0
        for group, size in zip(table.column("__rlz_group").to_pylist(), sizes):
            mine = np.arange(at, at + size)
            at += size
            mine = mine[again[mine] | more[mine]] if level == 1 else mine[again[mine]]
            if len(mine):
                out.append((group, level, key(whole["anchors"][mine], whole["contents"][mine]).tobytes(), whole["ids"][first[mine]].tobytes(),
                            whole["starts"][first[mine]].tobytes(), more[mine].tobytes()))
        return as_table(out, _FIRSTS)
    return run


class Known:
    """First places by key, as a group got them from the shards."""

    def __init__(self, rows: pa.Table, level: int):
        rows = [r for r in rows.to_pylist() if r["level"] == level]
        join = lambda n, kind: np.concatenate([np.frombuffer(r[n], kind) for r in rows] or [np.zeros(0, kind)])
        keys = join("keys", np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.starts, self.more = keys[order], join("ids", np.int64)[order], join("starts", np.int32)[order].astype(np.int64), join("more", bool)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def earlier(known: Known, keys: np.ndarray, names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places have the same content at an earlier place, and the entry that tells where."""
    hit, at = known.find(keys)
    if not hit.any():
        return hit, at
    first = (known.ids[at] < names) | ((known.ids[at] == names) & (known.starts[at] < starts))
    return hit & first, at


def boundary(w: Words, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with an earlier copy, their entries, and the windows of the boundary blocks with their anchors."""
    copied, at = earlier(known, w.keys(), w.names[w.doc], w.start())
    hit, _ = known.find(w.keys())
    open_ = hit & ~copied
    if len(known.keys):
        open_ &= known.more[at]
    blocks = np.flatnonzero(open_)
    sizes = w.last[blocks] - w.first[blocks] + 1
    windows = np.repeat(w.first[blocks] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum())) if len(blocks) else np.zeros(0, np.int64)
    return copied, at, windows, np.repeat(blocks, sizes)


def _windows(window: int, shards: int):
    def run(table: pa.Table, firsts: pa.Table) -> pa.Table:
        known, found = Known(firsts, 1), []
        for _, w in chunks(table, window):
            _, _, places, block = boundary(w, known)
            found.append((w.anchor[block], w.window[places], w.names[w.doc[block]], places - w.begin[w.doc[block]]))
        if not found:
            return as_table([], _LISTS)
        return as_table(_listed(table.column("__rlz_group")[0].as_py(), shards, *map(np.concatenate, zip(*found))), _LISTS)
    return run


def _parsed(window: int, kind: T.StructType):
    def run(table: pa.Table, firsts: pa.Table) -> pa.Table:
        blocks, singles = Known(firsts, 1), Known(firsts, 2)
        out: dict[str, list] = {f.name: [] for f in FACTORS}
        for _, w in chunks(table, window):
            copied, at, places, block = boundary(w, blocks)
            again, entry = earlier(singles, key(w.anchor[block], w.window[places]), w.names[w.doc[block]], places - w.begin[w.doc[block]])
            sizes = (w.last - w.first + 1)[copied]
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            spot = np.concatenate((np.repeat(w.first[copied], sizes) + inside, places[again]))
            source = np.concatenate((np.repeat(blocks.ids[at[copied]], sizes) if copied.any() else inside, singles.ids[entry[again]] if again.any() else places[:0]))
            offset = np.concatenate((np.repeat(blocks.starts[at[copied]], sizes) + inside if copied.any() else inside, singles.starts[entry[again]] if again.any() else places[:0]))
            order = np.argsort(spot)
            _emit(out, w, spot[order], source[order], offset[order], window)
        columns = {"doc_id": table.column("doc_id").combine_chunks()}
        kinds = {"long": pa.int64(), "int": pa.int32()}
        for f in FACTORS:
            name = f.dataType.elementType.simpleString() if isinstance(f.dataType, T.ArrayType) else f.dataType.simpleString()
            one = {"bigint": kinds["long"], "int": kinds["int"], "string": pa.string()}[name]
            columns[f.name] = pa.array(out[f.name], pa.list_(one) if isinstance(f.dataType, T.ArrayType) else one)
        return pa.table(columns)
    return run


def _emit(out: dict[str, list], w: Words, spot: np.ndarray, source: np.ndarray, offset: np.ndarray, window: int) -> None:
    """The factors of each document and what is left of it; `spot` are the windows that occur earlier, in order."""
    bounds = np.searchsorted(spot, w.begin)
    for n, words in enumerate(w.texts):
        mine = slice(bounds[n], bounds[n + 1])
        s, src, off = spot[mine] - w.begin[n], source[mine], offset[mine]
        out["n_words"].append(len(words))
        if not len(s):
            out["n_removed"].append(0)
            for name in ("starts", "lengths", "source_ids", "source_starts"):
                out[name].append([])
            out["kept"].append(b" ".join(words).decode())
            continue
        new = np.ones(len(s), bool)                     # a factor goes on while place and source go on
        new[1:] = (s[1:] != s[:-1] + 1) | (src[1:] != src[:-1]) | (off[1:] != off[:-1] + 1)
        at = np.flatnonzero(new)
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, s, 1)
        np.add.at(covered, s + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        out["n_removed"].append(int(gone.sum()))
        out["starts"].append(s[at].tolist())
        out["lengths"].append((np.diff(at, append=len(s)) + window - 1).tolist())
        out["source_ids"].append([None if x == _NO_ID else x for x in src[at].tolist()])
        out["source_starts"].append(off[at].tolist())
        out["kept"].append(b" ".join([x for x, g in zip(words, gone.tolist()) if not g]).decode())


def parse(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          group_rows: int = GROUP_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document its factors (starts, lengths, source_ids, source_starts, in words) and what the parse leaves.

    `n_words` and `n_removed` count words; `kept` has the words outside of all factors, joined by a space.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups, shards = groups_of(docs, text_col, group_rows, shard_rows)
    dealt = rows.withColumn("__rlz_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long")).repartition("__rlz_group")
    by_group = dealt.groupBy("__rlz_group")
    firsts = by_group.applyInArrow(_blocks(window, shards), _LISTS).groupBy("__rlz_shard").applyInArrow(_firsts(1), _FIRSTS)
    singles = by_group.cogroup(firsts.groupBy("__rlz_group")).applyInArrow(_windows(window, shards), _LISTS)
    singles = singles.groupBy("__rlz_shard").applyInArrow(_firsts(2), _FIRSTS)
    out = T.StructType([dealt.schema["doc_id"], *FACTORS])
    return by_group.cogroup(firsts.unionByName(singles).groupBy("__rlz_group")).applyInArrow(_parsed(window, out), out)
