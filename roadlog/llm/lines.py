"""Removal of lines that many documents share, through a sharded minimal perfect hash.

Documents lie in blocks by their id. A block lists its distinct long lines once, with the number of its
documents that hold each and the largest of their ids. These lists go to shards by line hash. A shard
numbers its distinct lines with a minimal perfect hash and keeps, at the number of a line, a compact
fingerprint, the count of documents and the largest id. The blocks' lists are the probes: each line is
looked up in the arrays of its shard, and only the lines to drop go back to the blocks. Lines are never joined.

A line that every document holds reaches its shard once per block, so no shard gets hot; blocks
and shards grow in number, not in size, with the table. One plan holds it all: the texts are dealt to
blocks once, and both the listing and the removal read that exchange.

Cases: a null or empty text is one empty line, and a text that loses no line stays as it is, null too; rows that share an
id are one document; rows without id are together one document that sorts before all others; of equal keys in one
document all lines go or stay; empty tables give no rows; other columns pass through, whatever their names, only names
that start with `__line_` are taken. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import field, groups_of

LEAST_CHARS = 20
LEAST_DOCS = 3
BLOCK_ROWS = 512
SHARD_ROWS = 2048

_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)
_LEVELS = 40
_LISTS = T.StructType([field("__line_shard", "long"), field("__line_block", "long"), field("digests", "binary"),
                       field("counts", "binary"), field("largest", "binary")])
_DROPS = T.StructType([field("__line_block", "long"), field("digests", "binary"), field("largest", "binary")])


def keys(text: str | None, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """Per line the digest of its key, None for a line whose key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: cascaded bit arrays, a key's number is the rank of its bit.

    A key takes the first level on which no other remaining key falls on its bit.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []      # bits, rank of each bit
        self.size = 0
        rest = keys
        while len(rest) and len(self.levels) < _LEVELS:
            width = max(64, 2 * len(rest))
            place = (_mixed(rest, len(self.levels)) % np.uint64(width)).astype(np.int64)
            bits = np.bincount(place, minlength=width) == 1
            self.levels.append((bits, self.size + np.cumsum(bits) - 1))
            self.size += int(bits.sum())
            rest = rest[~bits[place]]
        self.rest = {int(k): self.size + n for n, k in enumerate(rest)}
        self.size += len(self.rest)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not indexed gets any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            place = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        for at in open_.tolist() if self.rest else []:
            out[at] = self.rest.get(int(keys[at]), -1)
        return out


class Shard:
    """The distinct lines of one shard: perfect hash, fingerprints, document counts, largest ids."""

    def __init__(self, digests: np.ndarray, counts: np.ndarray, largest: np.ndarray):
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        digests, counts, largest = digests[order], counts[order], largest[order]
        first = np.ones(len(digests), bool)
        first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
        start = np.flatnonzero(first)
        digests = digests[start]
        counts = np.add.reduceat(counts, start) if len(start) else counts
        largest = np.maximum.reduceat(largest, start) if len(start) else largest
        same = np.zeros(len(digests), bool)                 # two lines with one 64-bit key are listed apart
        same[1:] = digests[1:, 0] == digests[:-1, 0]
        same[:-1] |= same[1:]
        self.apart = {(int(a), int(b)): (int(c), int(m)) for (a, b), c, m in zip(digests[same], counts[same], largest[same])}
        self.hash = PerfectHash(digests[~same, 0])
        at = self.hash.number(digests[~same, 0])
        self.fingerprints = np.zeros(self.hash.size, np.uint32)
        self.counts, self.largest = np.zeros(self.hash.size, np.int64), np.zeros(self.hash.size, np.int64)
        self.fingerprints[at] = digests[~same, 1].astype(np.uint32)
        self.counts[at], self.largest[at] = counts[~same], largest[~same]

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and largest id of each line; count 0 for a line that is not in the index."""
        at = self.hash.number(digests[:, 0])
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == digests[known, 1].astype(np.uint32)
        counts, largest = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[known], largest[known] = self.counts[at[known]], self.largest[at[known]]
        if self.apart:
            for n, (a, b) in enumerate(digests.tolist()):
                if (a, b) in self.apart:
                    counts[n], largest[n] = self.apart[a, b]
        return counts, largest


def _listing(id_col: str, text_col: str, least_chars: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("__line_block")[0].as_py()
        seen: set[tuple[bytes, int]] = set()
        held: dict[bytes, list[int]] = {}
        for name, text in zip(table.column(id_col).to_pylist(), table.column(text_col).to_pylist()):
            name = _NO_ID if name is None else name
            for digest in {k for k in keys(text, least_chars) if k}:
                if (digest, name) not in seen:
                    seen.add((digest, name))
                    entry = held.setdefault(digest, [0, name])
                    entry[0] += 1
                    entry[1] = max(entry[1], name)
        digests = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        numbers = np.array(list(held.values()), np.int64).reshape(-1, 2)
        shard = (digests[:, 1] >> np.uint64(33)).astype(np.int64) % shards
        rows = []
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                rows.append((int(shard[part[0]]), block, digests[part].tobytes(), numbers[part, 0].tobytes(), numbers[part, 1].tobytes()))
        return as_table(rows, _LISTS)
    return run


def as_table(rows: list[tuple], kind: T.StructType) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in kind]
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.table({f.name: pa.array(c, kinds[f.dataType.simpleString()]) for f, c in zip(kind, columns)})


def _answers(least_docs: int):
    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("digests").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        largest = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("largest").to_pylist()])
        shard = Shard(np.concatenate(lists), counts, largest)
        rows = []
        for block, digests in zip(table.column("__line_block").to_pylist(), lists):
            found, keeper = shard.probe(digests)
            drop = found >= least_docs
            if drop.any():
                rows.append((block, digests[drop].tobytes(), keeper[drop].tobytes()))
        return as_table(rows, _DROPS)
    return run


def _removal(id_col: str, text_col: str, least_chars: int, names: list[str]):
    def run(table: pa.Table, drops: pa.Table) -> pa.Table:
        keeper: dict[bytes, int] = {}
        for digests, largest in zip(drops.column("digests").to_pylist(), drops.column("largest").to_pylist()):
            keeper.update(zip((digests[n:n + 16] for n in range(0, len(digests), 16)), np.frombuffer(largest, np.int64).tolist()))
        texts, lines, dropped = table.column(text_col).to_pylist(), [], []
        for n, (name, text) in enumerate(zip(table.column(id_col).to_pylist(), texts)):
            name = _NO_ID if name is None else name
            digests = keys(text, least_chars)
            stay = [k is None or keeper.get(k, name) == name for k in digests]
            lines.append(len(digests))
            dropped.append(len(digests) - sum(stay))
            if dropped[-1]:
                texts[n] = "\n".join(x for x, keep in zip(text.split("\n"), stay) if keep)
        kept = table.select(names)
        at = names.index(text_col)
        kept = kept.set_column(at, names[at], pa.array(texts, pa.string()))
        return (kept.append_column("__line_n", pa.array(lines, pa.int64()))
                .append_column("__line_dropped", pa.array(dropped, pa.int64())))
    return run


def remove(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text",
           block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All columns of the documents with shared lines taken out of the text, and __line_n, __line_dropped.

    A line whose key (stripped, ASCII lower case) has `least_chars` code points or more and is in
    `least_docs` documents or more stays only in the document with the largest id.
    """
    docs = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")})
    blocks, shards = groups_of(docs, text_col, block_rows, shard_rows)
    names = docs.columns
    dealt = docs.withColumn("__line_block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("long")).repartition("__line_block")
    lists = dealt.groupBy("__line_block").applyInArrow(_listing(id_col, text_col, least_chars, shards), _LISTS)
    drops = lists.groupBy("__line_shard").applyInArrow(_answers(least_docs), _DROPS)
    out = T.StructType([*docs.schema, field("__line_n", "long"), field("__line_dropped", "long")])
    return dealt.groupBy("__line_block").cogroup(drops.groupBy("__line_block")).applyInArrow(
        _removal(id_col, text_col, least_chars, names), out)
