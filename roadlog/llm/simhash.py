"""Near-duplicate documents by SimHash fingerprints that share pigeonhole blocks.

Two forms, both over distinct fingerprints, so that exact copies cost nothing:

`classes` links documents whose 64-bit fingerprints differ in at most two bits. The bits are cut into four blocks;
fingerprints that close agree on two of them, so they share the key that some choice of two blocks makes. Fingerprints that
share a key are joined and the Hamming distance is verified. A key that more than `bucket` distinct fingerprints share is not
joined: these fingerprints list themselves and their one-bit neighbours instead. Two of them link exactly when their lists meet,
and at most 65 fingerprints meet in one entry, so this way is exact too and linear in the fingerprints.

`near` links documents whose shingle sets are similar (0.8 or more by default), which is too far for 64 bits: there, ten bits differ. Its
fingerprint has a block of 64 bits for each share of about `SHARE` shingles, dealt by their hashes. A changed shingle spoils one block
at most, so documents that differ in fewer shingles than they have blocks share one; at most `BLOCKS` blocks are compared, which
leaves a pair of similarity 0.8 without a common block about once in a thousand times from 150 words on. Sets of up to `SHORT` shingles
have too few blocks for that. Their keys are the first shingles in one order of all shingles, one more than a similar set may lack, so
that two similar sets always share a key; shingles that are frequent in a sample of the sets come last in that order, which decides how
many sets share a key but not which pairs meet. Sets beyond `SHORT` that a set of `SHORT` may be similar to have both kinds of keys.

Two sets that carry their shingles, as 32-bit hashes, are verified exactly. For other documents that share a key the Hamming distance of a fingerprint of
2048 bits preselects: its expected share of differing bits is the angle of the sets, with a standard deviation of 0.8 hundredths, or 0.02 of similarity.
Pairs `DEVIATIONS` of these from the threshold are decided by it. Those between stay open; where the sure links leave
the two apart, the shingles of their texts are made again and decide exactly. Up to `bucket` documents of a key are joined in pairs. A larger
group goes to tasks in pairs of pieces of about `PIECE` documents, so that every two of its documents meet in one; there they are searched
from document to document, and those reached are not compared again, so a group of similar documents costs little more than its size.
Keys with the same documents are compared once.

Cases: null and empty texts, like texts without words, have fingerprint zero and link with each other; fewer
words than a shingle make one shingle; equal rows have equal classes; ids that are null never name a class unless all of
it are null; an empty table gives no rows; only id and text are read, other columns pass through `distinct` unchanged,
names that start with `__sim_` are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import cut, field, id_text, map_texts, sliced
from roadlog.llm.graph import components

SEED = 42
BUCKET = 64
WIDE = 2048
SHARE = 6
BLOCKS = 32
PIECE = 4096
SHORT = 128
SAMPLE = 20_000
DEVIATIONS = 3.5            # how far from the threshold wide fingerprints decide alone
LOAD = 4_000_000            # shingles of an undecided group that go to one task, at most two such parts


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of `size` words, ASCII lower case, joined by a space; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*[words[k:] for k in range(size)])]


def fingerprints(texts: list[str], size: int) -> np.ndarray:
    """The fingerprint of each text as a signed 64-bit number."""
    hashed, counts = xxhash.xxh64_intdigest, []
    out = np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        parts = shingles(text, size)
        counts.append(len(parts))
        if not parts:
            continue
        total = np.zeros(64, np.int64)
        for at in range(0, len(parts), 1 << 16):
            h = np.array([hashed(p, SEED) for p in parts[at:at + (1 << 16)]], ">u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[n] = int.from_bytes(np.packbits(2 * total > len(parts)).tobytes(), "big", signed=True)
    return out


def signed(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `fp`, the fingerprint as a number."""
    return map_texts(id_text(docs, id_col, text_col), lambda texts: {"fp": fingerprints(texts, size)}, [field("fp", "long")])


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Linked pairs (a, b) of the distinct fingerprints `prints` (fp), enough to hold every class together."""
    if distance != 2:
        raise ValueError("the blocks and the one-bit neighbours are laid out for two differing bits")
    blocks = [0xFFFF << (16 * k) for k in range(4)]
    masks = [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(blocks, 2))]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                    for n, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["t", "key"]))
    near = shared.filter(F.col("n") <= bucket).select("t", "key", "fp")
    left, right = near.withColumnRenamed("fp", "a"), near.withColumnRenamed("fp", "b")
    verified = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    bits = [0, *[1 << k for k in range(63)], -(1 << 63)]
    listed = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(b)) for b in bits])).alias("entry"))
    met = listed.groupBy("entry").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    starred = met.select("a", F.explode("all").alias("b")).filter("a <> b")
    return verified.select("a", "b").unionByName(starred)


def classes(signs: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id and `keeper` (whether the row is of the id and fingerprint that stand for its class).

    `signs` is (doc_id, fp), a written table, as it is read several times.
    """
    prints = cut(signs.select("fp").distinct())
    return _named(signs, links(prints, distance, bucket))


def _named(signs: DataFrame, edges: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    prints = cut(signs.groupBy("fp").agg(first.alias("first")))
    roots = components(edges)
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.select("fp", "root").join(heads, "root").select("fp", "head")
    return signs.join(named, "fp").select(
        "doc_id", "fp", F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("fp") == F.col("head.fp"))).alias("keeper"))


def _hashes(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(p, SEED) for p in shingles(text, size)], np.uint64))


def _short(hashes: np.ndarray) -> np.ndarray:
    """A set of shingle hashes as distinct 32-bit numbers."""
    return np.unique(hashes.astype(np.uint32)).view(np.int32)


def _set_id(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63) if len(hashes) else 0


def _shares(n: float) -> int:
    """Into how many shares the shingles of a document of n go: a power of two."""
    return 1 << max(0, round(np.log2(n / SHARE)))


def _longest(similarity: float) -> int:
    """The most shingles that a set similar to one of `SHORT` may have."""
    return int(SHORT / similarity + 1e-9)


def block_keys(hashes: np.ndarray, similarity: float) -> list[int]:
    """The blocks of a document beyond `SHORT` as signed numbers, for each number of shares that a similar document may have."""
    out = []
    n = len(hashes)
    for shares in sorted({_shares(n * similarity), _shares(n), _shares(n / similarity)}) if n > SHORT else []:
        share = (hashes >> np.uint64(20)) & np.uint64(shares - 1)
        mine = share < BLOCKS
        order = np.argsort(share[mine], kind="stable")
        share, part = share[mine][order], hashes[mine][order]
        if not len(part):
            continue
        start = np.flatnonzero(np.diff(share, prepend=share[0] + np.uint64(1)))
        size = np.diff(start, append=len(part))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        blocks = np.packbits(2 * ones > size[:, None], axis=1)
        for number, block, count in zip(share[start].tolist(), blocks, size.tolist()):
            if count >= 2:
                out.append(xxhash.xxh64_intdigest(block.tobytes() + bytes([shares.bit_length(), number]), SEED) - (1 << 63))
    return out


def prefix_keys(few: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before those of `common` (sorted, with counts): any set as similar has one of its first ones among them."""
    at = np.minimum(np.searchsorted(common, few), max(len(common) - 1, 0))
    frequency = np.where(common[at] == few, counts[at], 0) if len(common) else np.zeros(len(few), np.int64)
    first = len(few) - int(np.ceil(similarity * len(few) - 1e-9)) + 1
    return few[np.lexsort((few, frequency))[:first]].astype(np.int64)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of WIDE bits, rows of signed 64-bit numbers: the signs of random sums over the shingles.

    Shingles fall into as many cells as there are bits, with a sign; two rounds of random signs and a Hadamard transform make
    the sums.
    """
    x = np.zeros((len(sets), WIDE), np.float32)
    for row, hashes in zip(x, sets):
        cell = (hashes & np.uint64(WIDE - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((hashes >> np.uint64(11)) & np.uint64(1)).astype(np.float64)
        row += np.bincount(cell, sign, WIDE).astype(np.float32)
    signs = 1 - 2 * np.random.default_rng(SEED).integers(0, 2, (2, WIDE)).astype(np.float32)
    for k in range(2):
        x *= signs[k]
        half = 1
        while half < WIDE:
            pair = x.reshape(len(x), WIDE // (2 * half), 2, half)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), WIDE)
            half *= 2
    return np.packbits(x > 0, axis=1).view(">i8").astype(np.int64)


def differing(similarity: float, deviations: float = 0.0) -> int:
    """How many of the WIDE bits differ between sets of this similarity, and this many standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * share + deviations * np.sqrt(WIDE * share * (1 - share)))


def sketched(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the number of the shingle set), blocks and the wide fingerprint of longer sets, the shingles of shorter ones."""
    longest = _longest(similarity)

    def work(texts: list[str]) -> dict:
        sets = [_hashes(t, size) for t in texts]
        wide = iter(wide_fingerprints([h for h in sets if len(h) > SHORT]).tolist())
        return {"fp": [_set_id(h) for h in sets], "blocks": [block_keys(h, similarity) for h in sets],
                "wide": [next(wide) if len(h) > SHORT else None for h in sets],
                "few": [_short(h).tolist() if len(h) <= longest else None for h in sets]}

    return map_texts(id_text(docs, id_col, text_col), work, [field("fp", "long"), field("blocks", "long[]"), field("wide", "long[]"), field("few", "int[]")])


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in the sample of sets with the smallest number, sorted, and how often they are there."""
    carried = sets.filter("few is not null")
    n = carried.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = carried if share == 1.0 else carried.filter(F.col("fp") < int(-(1 << 63) + share * (1 << 64)))
    counted = sample.select(F.explode("few").alias("x")).groupBy("x").agg(F.count("*").alias("n")).filter("n > 4")
    rows = counted.orderBy(F.desc("n"), "x").limit(100_000).toArrow().sort_by("x")
    return rows.column("x").to_numpy(), rows.column("n").to_numpy()


def _keyed(sets: DataFrame, similarity: float) -> DataFrame:
    """fp and key of each block, and of each shingle in the prefix of a set that carries its shingles."""
    common, counts = _common(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                few = [np.array(x, np.int32) for x in part.column(1).to_pylist()]
                keys = [prefix_keys(x, similarity, common, counts) if len(x) else np.zeros(0, np.int64) for x in few]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])), pa.array(np.concatenate(keys))], ["fp", "key"])

    prefixes = sets.filter("few is not null").select("fp", "few").mapInArrow(run, "fp long, key long")
    return sets.select("fp", F.explode("blocks").alias("key")).unionByName(prefixes)


def spanning(n: int, alike: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that hold together what `alike` (a member, others: which of them it links with, which it may) does, and the open members.

    Each link is found from a member reached before. Open are the members that may link with one of another part.
    """
    rest, out, opened = np.arange(n), [], np.zeros(n, bool)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        unsure, may = [], np.zeros(n, bool)
        while reached and len(rest):
            at = reached.pop()
            hit, perhaps = alike(at, rest)
            found = rest[hit].tolist()
            out += [(at, x) for x in found]
            reached += found
            if perhaps.any():
                unsure.append(at)
                may[rest[perhaps]] = True
            rest = rest[~hit]
        if may[rest].any():
            opened[unsure] = True
            opened[rest[may[rest]]] = True
    return out, opened


class _Exact:
    """Which sets of a group are similar to one of them, by their shingles."""

    def __init__(self, sets: pa.ListArray, similarity: float):
        self.similarity = similarity
        self.size = sets.value_lengths().fill_null(0).to_numpy(False)
        self.end = np.cumsum(self.size)
        every, self.coded = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        self.mark = np.zeros(len(every), bool)

    def __call__(self, at: int, rest: np.ndarray) -> np.ndarray:
        self.mark[mine := self.coded[self.end[at] - self.size[at]:self.end[at]]] = True
        hits = np.concatenate(([0], np.cumsum(self.mark[self.coded])))
        self.mark[mine] = False
        both = hits[self.end[rest]] - hits[self.end[rest] - self.size[rest]]
        return both >= self.similarity * (self.size[at] + self.size[rest] - both) - 1e-9


class _Alike:
    """Which sets of a group are surely similar to one of them, and which may be."""

    def __init__(self, table: pa.Table, similarity: float):
        self.sure, self.perhaps = differing(similarity, -DEVIATIONS), differing(similarity, DEVIATIONS)
        few, wide = table.column("few").combine_chunks(), table.column("wide").combine_chunks()
        self.carries, self.broad = ~few.is_null().to_numpy(False), ~wide.is_null().to_numpy(False)
        self.wide = np.zeros((len(table), WIDE // 64), np.uint64)
        self.wide[self.broad] = wide.flatten().to_numpy().view(np.uint64).reshape(-1, WIDE // 64)
        self.exact = _Exact(few, similarity)

    def __call__(self, at: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, perhaps = np.zeros(len(rest), bool), np.zeros(len(rest), bool)
        carried = self.carries[rest] if self.carries[at] else hit
        if carried.any():
            hit = carried & self.exact(at, rest)
        if self.broad[at] and (other := self.broad[rest] & ~carried).any():
            distance = np.bitwise_count(self.wide[rest[other]] ^ self.wide[at]).sum(axis=1, dtype=np.int32)
            hit[other] = distance <= self.sure
            perhaps[other] = (distance > self.sure) & (distance <= self.perhaps)
        return hit, perhaps


def _met(similarity: float):
    """Links (a, b) of a group, and its open members (a) under a number of all of them (open)."""
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        found, opened = spanning(len(fp), _Alike(table, similarity))
        ends, left = fp[np.array(found, np.int64).reshape(-1, 2)], np.sort(fp[opened])
        number = xxhash.xxh64_intdigest(left.tobytes(), SEED) - (1 << 63)
        return pa.table({"a": pa.array(np.concatenate((ends.min(axis=1), left))),
                         "b": pa.array([*ends.max(axis=1).tolist(), *[None] * len(left)], pa.int64()),
                         "open": pa.array([None] * len(ends) + [number] * len(left), pa.int64())})
    return run


def _settled(similarity: float):
    """Links (a, b) between members of a group that have different roots, by their shingles."""
    def run(table: pa.Table) -> pa.Table:
        fp, root = table.column("fp").to_numpy(), table.column("root").to_numpy()
        exact = _Exact(table.column("shingles").combine_chunks(), similarity)

        def alike(at: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (root[rest] == root[at]) | exact(at, rest), np.zeros(len(rest), bool)

        found = np.array(spanning(len(fp), alike)[0], np.int64).reshape(-1, 2)
        ends = fp[found[root[found[:, 0]] != root[found[:, 1]]]]
        return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})
    return run


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """(group, fp) with `parts` in pairs of parts (one, two) of its group, so that every two of its members meet in one."""
    placed = members.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return placed.filter("parts = 1 or mine <> other").select(group, F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "fp")


def _whole(fps: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(fp, shingles) of the sets `fps`, from the text of one document of each."""
    first = sketches.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m"))
    ids = first.select(F.col("m.doc_id").alias("__sim_id")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sets = [_hashes(x or "", size) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([_short(h) for h in sets], pa.list_(pa.int32()))], ["fp", "shingles"])

    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("__sim_id")), "left_semi").select("text")
    found = chosen.mapInArrow(work, "fp long, shingles array<int>").join(fps, "fp", "left_semi")
    return cut(found.groupBy("fp").agg(F.first("shingles").alias("shingles")))


def _reopened(undecided: DataFrame, sure: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, similarity: float, load: int) -> DataFrame:
    """Links (a, b) in the groups `undecided` (open, fp) that the links `sure` leave apart, from all shingles of these sets."""
    rooted = undecided.join(components(sure).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    apart = rooted.groupBy("open").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("open")
    members = cut(rooted.join(apart, "open", "left_semi"))
    whole = _whole(cut(members.select("fp").distinct()), sketches, texts, size)
    weights = members.join(whole.select("fp", F.size("shingles").alias("n")), "fp").groupBy("open").agg(F.ceil(F.sum("n") / load).cast("int").alias("parts"))
    dealt = _dealt(members.select("open", "fp").join(weights, "open"), "open")
    held = members.select("fp", "root").distinct().join(whole, "fp")
    return dealt.join(held, "fp").groupBy("open", "one", "two").applyInArrow(_settled(similarity), "a long, b long")


def near(sketches: DataFrame, texts: DataFrame, size: int = 5, similarity: float = 0.8, bucket: int = 8, piece: int = PIECE, load: int = LOAD) -> DataFrame:
    """Linked pairs (a, b) of the distinct shingle sets of `sketches`, enough to hold every class together.

    `sketches` is a written table as of `sketched`, `texts` (doc_id, text) are the documents it was made of.
    """
    # one row for each set of shingles before anything is joined, so copies make no hot key
    sets = cut(sketches.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("blocks", "wide", "few")]))
    keyed = cut(_keyed(sets, similarity))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y")).filter("n > 1")
    groups = groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")       # one key of those with the same members
    shared = cut(keyed.join(groups, "key"))
    few = shared.filter(F.col("n") <= bucket).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").filter("a < b").select("a", "b").distinct()
    known = cut(pairs)
    touched = known.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    held = cut(sets.join(touched, "fp", "left_semi").select("fp", "wide", "few"))
    both = known.join(held.select(F.col("fp").alias("a"), F.col("wide").alias("x"), F.col("few").alias("s")), "a").join(
        held.select(F.col("fp").alias("b"), F.col("wide").alias("y"), F.col("few").alias("t")), "b")
    distance = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    common = F.size(F.array_intersect("s", "t"))
    exact = common >= similarity * (F.size("s") + F.size("t") - common) - 1e-9
    off = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.when(exact, 0)).otherwise(distance)
    judged = both.select("a", "b", off.alias("off")).filter(F.col("off") <= differing(similarity, DEVIATIONS))
    judged = judged.select("a", F.when(F.col("off") <= differing(similarity, -DEVIATIONS), F.col("b")).alias("b"), F.xxhash64("a", "b").alias("open"), F.col("b").alias("c"))
    judged = judged.select(F.explode(F.when(F.col("b").isNotNull(), F.array(F.struct("a", "b", F.lit(None).cast("long").alias("open")))).otherwise(
        F.array(*[F.struct(F.col(x).alias("a"), F.lit(None).cast("long").alias("b"), "open") for x in ("a", "c")]))).alias("e")).select("e.*")
    crowded = _dealt(shared.filter(F.col("n") > bucket).withColumn("parts", F.ceil(F.col("n") / piece).cast("int")), "key")
    met = crowded.join(sets.select("fp", "wide", "few"), "fp").groupBy("key", "one", "two").applyInArrow(_met(similarity), "a long, b long, open long")
    found = cut(judged.unionByName(met.distinct()))
    sure = found.filter("b is not null").select("a", "b")
    undecided = found.filter("b is null").select("open", F.col("a").alias("fp"))
    return sure.unionByName(_reopened(undecided, sure, sketches, texts, size, similarity, load))


def distinct(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class by `near`, with all its columns: that of the smallest id, one row of it if rows repeat."""
    sketches = cut(sketched(docs, size, similarity, id_col, text_col))
    heads = _named(sketches.select("doc_id", "fp"), near(sketches, id_text(docs, id_col, text_col), size, similarity)).filter("keeper").select(F.col("doc_id").alias("__sim_id"), F.col("fp").alias("__sim_fp")).distinct()
    at = docs.schema.fieldNames().index(text_col)
    out = T.StructType([*docs.schema, field("__sim_at", "long"), field("__sim_n", "long")])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(part for b in batches for part in sliced(b)):
            fp = np.array([_set_id(_hashes(x or "", size)) for x in batch.column(at).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp), pa.array(np.arange(len(fp)) + 512 * n)], [*out.names])

    marked = docs.mapInArrow(sign, out)
    kept = marked.join(heads, (F.col("__sim_at") == F.col("__sim_fp")) & F.col(id_col).eqNullSafe(F.col("__sim_id")), "left_semi")
    # rows that share id and fingerprint lie together after that join; one of them stays
    order = Window.partitionBy("__sim_at", id_col).orderBy(F.xxhash64(text_col), "__sim_n")
    return kept.withColumn("__sim_n", F.row_number().over(order)).filter("__sim_n = 1").drop("__sim_at", "__sim_n")
