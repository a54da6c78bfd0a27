"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every word sequence of every item. A document's words are streamed through it; the
state gives the longest suffix read so far that occurs in an item. Where that length reaches the window,
the last `window` words are in some item, and the covered words form the spans. An item shorter than
the window is a window of its own length.

The test set is split into blocks of items of about `block_words` words by their ids. Blocks are taken to
the executors one after the other, each in a pass over the documents that is written before the next one, so that neither
the driver nor a task holds more than one block; the hits of earlier blocks travel with the documents. Nothing is shuffled.

Cases: null and empty texts have no words and are clean; a null item id is kept as a null that no list
shows; an item without words matches nothing; repeated items count once per id; empty tables give empty
or all-clean results; only the named columns are read, the others are passed through by `clean` as they are; names that
start with `__leak_` are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.common import cut, field, id_text, pieces, sliced

WINDOW = 10
BLOCK_WORDS = 400_000
MAX_COVERAGE = 0.5

# fixed value: a word is a run of ASCII letters and digits and of any characters beyond ASCII
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")      # the same before lower-casing
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = [field("n_words", "long"), field("starts", "int[]"), field("ends", "int[]"), field("items", "string[]")]


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.least = min([window, *(len(ws) for _, ws in coded)])
        self.found: dict[tuple[int, int], set[str]] = {}        # (state, window length): the items
        for name, ws in coded:
            size, state, run = min(window, len(ws)), 0, 0
            for w in ws:
                state, run = self.advance(state, run, w)
                if run >= size:
                    self.found.setdefault((self.holder(state, size), size), set()).add(name)
        self.short = sorted({size for _, size in self.found if size < window})

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            at = step[last][w]
            return at if length[at] == length[last] + 1 else self._clone(last, w, at)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last != -1 and w not in step[last]:
            step[last][w] = new
            last = link[last]
        if last != -1:
            at = step[last][w]
            link[new] = at if length[at] == length[last] + 1 else self._clone(last, w, at)
        return new

    def _clone(self, last: int, w: int, at: int) -> int:
        step, link, length = self.step, self.link, self.length
        new = len(step)
        step.append(dict(step[at]))
        length.append(length[last] + 1)
        link.append(link[at])
        link[at] = new
        while last != -1 and step[last].get(w) == at:
            step[last][w] = new
            last = link[last]
        return new

    def advance(self, state: int, run: int, w: int) -> tuple[int, int]:
        """The state after one more word, and how many of the last words it stands for."""
        while state and w not in self.step[state]:
            state = self.link[state]
            run = self.length[state]
        if w in self.step[state]:
            return self.step[state][w], run + 1
        return 0, 0

    def holder(self, state: int, size: int) -> int:
        """The state of the last `size` words, where at least so many match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def match(self, ws: list[bytes], names: set[str]) -> list[tuple[int, int]]:
        """Merged spans of the words inside windows; adds the items that have any to `names`."""
        ids = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int32, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - begin < self.least:
                continue
            state = run = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin):
                state, run = self.advance(state, run, w)
                longest = 0
                if run >= self.window:
                    names |= self.found.get((self.holder(state, self.window), self.window), set())
                    longest = self.window
                for size in self.short:
                    if run >= size and (hit := self.found.get((self.holder(state, size), size))):
                        names |= hit
                        longest = max(longest, size)
                if longest:
                    spans.append((at + 1 - longest, at + 1))
        return merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, joined where they meet."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list[tuple[str, list[bytes]]], bool]]:
    """The items in blocks of a bounded number of words, one block at a time, and whether it is the last."""
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = pieces(chars, 4 * block_words)
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        yield [(r["name"], words(r["text"])) for r in part], k == blocks - 1


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, the word spans inside windows (starts, ends) and the ids of the items found."""
    none = F.array().cast
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), none("array<int>").alias("starts"), none("array<int>").alias("ends"),
        none("array<string>").alias("items"))
    out = T.StructType([rows.schema["doc_id"], rows.schema["text"], *SPANS])
    last = T.StructType([rows.schema["doc_id"], *SPANS])
    for block, final in item_blocks(items, item_id, item_text, block_words):
        rows = rows.mapInArrow(_pass(block, window, final), last if final else out)
        rows = rows if final else cut(rows)         # the plan lets go of this block
    return rows


def _pass(block: list[tuple[str, list[bytes]]], window: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(block, window)
        for batch in batches:
            for part in sliced(batch):
                counts, starts, ends, items = [], [], [], []
                for text, s, e, names in zip(part.column(1).to_pylist(), *[part.column(c).to_pylist() for c in (3, 4, 5)]):
                    ws = words(text or "")
                    known = set(names)
                    found = automaton.match(ws, known)
                    whole = merged([*zip(s, e), *found]) if s else found
                    counts.append(len(ws))
                    starts.append([x for x, _ in whole])
                    ends.append([x for _, x in whole])
                    items.append(sorted(x for x in known if x is not None))
                texts = [] if final else [part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *texts, pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", *["text"] * (not final), *[f.name for f in SPANS]])
    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without the spans found in test items; those covered beyond `max_coverage` go whole.

    The spans of all blocks of items are found in the text as it is; the last pass cuts them and judges coverage once.
    Documents without a hit keep their text as it is.
    """
    kind = docs.schema
    at = kind.fieldNames().index(text_col)
    marked = T.StructType([*kind, field("__leak_starts", "int[]"), field("__leak_ends", "int[]")])
    first = True
    for block, final in item_blocks(items, item_id, item_text, block_words):
        docs = docs.mapInArrow(_cutter(block, window, max_coverage, at, len(kind), first, final), kind if final else marked)
        docs = docs if final else cut(docs)
        first = False
    return docs


def _cutter(block: list[tuple[str, list[bytes]]], window: int, max_coverage: float, at: int, width: int, first: bool, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(block, window)
        for batch in batches:
            for part in sliced(batch):
                texts, keep, spans = part.column(at).to_pylist(), [], []
                known = repeat(([], [])) if first else zip(*[part.column(c).to_pylist() for c in (width, width + 1)])
                for k, (text, (s, e)) in enumerate(zip(texts, known)):
                    ws = words(text or "")
                    found = automaton.match(ws, set())
                    whole = merged([*zip(s, e), *found]) if s else found
                    spans.append(whole)
                    if final:
                        keep.append(sum(e - s for s, e in whole) <= max_coverage * len(ws))
                        if whole:
                            texts[k] = without(text, whole)
                if final:
                    columns = [*part.columns[:at], pa.array(texts, part.schema.field(at).type), *part.columns[at + 1:width]]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:width]).filter(pa.array(keep, pa.bool_()))
                else:
                    hits = [pa.array([[x[k] for x in whole] for whole in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *hits], names=[*part.schema.names[:width], "__leak_starts", "__leak_ends"])
    return run


def without(text: str, found: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in found:
        out.append(text[at:places[begin][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])
