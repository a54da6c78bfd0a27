"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

Both models are word bigrams with absolute discounts over one vocabulary. The words of a class are weighed by the contexts
they continue, not by how often they occur, so a passage that is copied counts once. What is rare is smoothed through counts
that both classes share: a word with few contexts in either class has the same probability in both, a bigram
backs off to the bigram counts of both classes together, and a bigram that neither class knows to the words. The log-likelihoods
of a text under the two models are compared per word, and a logistic curve, fitted on labelled texts that the models have not
seen, turns the difference into a score.

The models are fitted on at most `PER_CLASS` labelled documents of each class, those whose ids have the smallest hash; near copies,
texts with the same smallest shingle hash, are learned once. This bounds vocabulary and bigrams, which is why the
models may go to all tasks. Scoring reads each document once, whole.

Cases: null and empty texts have no words and get the score of a difference of zero; without documents of both classes
the score is the share of toxic labels (0 without labels); a document labelled more than once counts as toxic if one
label says so; rows whose id or label is null are not learned from; empty tables give no rows; only the named columns are read,
`ordinary` passes all columns through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog.llm.boosting import logistic
from roadlog.llm.common import cut, field, id_text, map_texts, sliced, smallest
from roadlog.llm.decontaminate import words
from roadlog.llm.simhash import shingles

PER_CLASS = 4_000
DISCOUNT = 0.75
PRIOR = 1000.0              # how many words of a context the shared counts weigh
EQUAL = 1.0                 # log ratios up to this count as equal: the classes differ in languages and subjects too
FOLDS = 5
OTHER, START = 0, 1         # numbers of the words beyond the vocabulary and of the begin of a text


def held_out(name: Column) -> Column:
    """Whether a document is kept from learning: one in five by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(name.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(toxic, fit, text) of the bounded sample, and the share of toxic labels outside the held-out fold."""
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")))
    marks = cut(marks)
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    picked = [smallest(marks.filter(F.col("toxic") == k), "h", ["doc_id"], per_class) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))                      # at most 2 * per_class ids
    texts = id_text(docs, id_col, text_col).join(chosen, "doc_id").filter("text is not null").select("toxic", "h", "text")
    keyed = texts.mapInArrow(_with_key, "toxic int, h long, text string, t long")
    once = keyed.groupBy("toxic", "t").agg(F.min(F.struct("h", "text")).alias("m"))
    return cut(once.select("toxic", (F.pmod("t", F.lit(4)) != 0).alias("fit"), "m.text")), share


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's runs of five words, which near copies mostly share."""
    for batch in batches:
        for part in sliced(batch):
            keys = [min(map(xxhash.xxh3_64_intdigest, shingles(t, 5)), default=0) >> 1 for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], ["toxic", "h", "text", "t"])


def rare_below(documents: int) -> int:
    """From how many documents or contexts on an expression is not rare in a sample of so many documents."""
    return 3 + int(documents ** 0.5 / 8)


def _beyond(gap: np.ndarray) -> np.ndarray:
    """Log ratios less the part that counts as equal."""
    return np.sign(gap) * np.maximum(np.abs(gap) - EQUAL, 0)


class Model:
    """Vocabulary and tables of the two models, and the logistic curve."""

    def __init__(self, share: float):
        self.share = share
        self.ids: dict[bytes, int] | None = None
        self.weights = np.zeros(3)

    def coded(self, text: str) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.ids.get, ws, repeat(OTHER)), np.int64, len(ws))

    def fit(self, vocabulary: list[str], pairs: pa.Table, befores: pa.Table, afters: pa.Table, least: int) -> Model:
        """`pairs` (u, w, n0, n1), `befores` (u, n0, n1, kinds0, kinds1) and `afters` (w, n0, n1, both: contexts)."""
        size = len(vocabulary) + 2
        self.ids = {w.encode(): n for n, w in enumerate(vocabulary, 2)}
        count, kinds, contexts, both = np.zeros((2, size)), np.zeros((2, size)), np.zeros((2, size)), np.zeros(size)
        at, at_w = befores["u"].to_numpy(), afters["w"].to_numpy()
        both[at_w] = afters["both"].to_numpy()
        for c in (0, 1):
            count[c, at], kinds[c, at] = befores[f"n{c}"].to_numpy(), befores[f"kinds{c}"].to_numpy()
            contexts[c, at_w] = afters[f"n{c}"].to_numpy()
        shared = (both + 0.5) / (both + 0.5).sum()
        kept = np.maximum(contexts - DISCOUNT, 0)
        rest = (contexts - kept).sum(axis=1, keepdims=True)                     # what the discount takes from a class
        word = (kept + rest * shared) / np.maximum(contexts.sum(axis=1, keepdims=True), 1)
        rare = contexts.max(axis=0) < least
        rare[[OTHER, START]] = True
        word[:, rare] = shared[rare]
        self.word_gap = _beyond(np.log(word[1]) - np.log(word[0]))
        u, w = pairs["u"].to_numpy(), pairs["w"].to_numpy()
        n = np.stack([pairs["n0"].to_numpy(), pairs["n1"].to_numpy()]).astype(float)
        joined = n.sum(axis=0) / count[:, u].sum(axis=0)
        tilt = word[:, w] / word[:, w].mean(axis=0)
        p = (np.maximum(n - DISCOUNT, 0) + (PRIOR + DISCOUNT * kinds[:, u]) * joined * tilt) / (count[:, u] + PRIOR)
        order = np.argsort(u * size + w)
        self.size, self.keys = size, (u * size + w)[order]
        self.pair = _beyond(np.log(p[1]) - np.log(p[0]))[order]
        return self

    def gaps(self, coded: np.ndarray) -> np.ndarray:
        """Per word the log-likelihood under the toxic model less that under the ordinary one."""
        before = np.concatenate(([START], coded[:-1])) if len(coded) else coded
        out = self.word_gap[coded]
        key = before * self.size + coded
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        if len(self.keys):
            hit = self.keys[at] == key
            out[hit] = self.pair[at[hit]]
        return out

    def features(self, text: str) -> tuple[float, float]:
        """The difference of the log-likelihoods by the number of words, and by its root."""
        coded = self.coded(text)
        if not len(coded):
            return 0.0, 0.0
        total = float(self.gaps(coded).sum())
        return total / len(coded), total / len(coded) ** 0.5

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.ids is None:
            return np.full(len(texts), self.share)
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -40, 40)))

    def curve(self, x: np.ndarray, toxic: np.ndarray) -> Model:
        """Fit the curve on features, then move it from the sample's share of toxic texts to that of the labels."""
        middle, width = x.mean(axis=0), x.std(axis=0) + 1e-9
        scaled = logistic((x - middle) / width, toxic)
        self.weights = np.append(scaled[:2] / width, scaled[2] - (scaled[:2] * middle / width).sum())
        sample = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
        real = float(np.clip(self.share, 1e-3, 1 - 1e-3))
        self.weights[2] += np.log(real / (1 - real)) - np.log(sample / (1 - sample))
        return self


def _counted(rows: DataFrame, count, columns: str) -> DataFrame:
    """Partial counts of each Arrow batch; `count` gets (toxic, text) pairs and yields rows."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(count(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names) if found else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.string() if n == "word" else pa.int64()) for n in names]))

    return rows.select("toxic", "text").mapInArrow(run, columns)


def _word_docs(rows):
    seen: Counter[bytes] = Counter()
    for _, text in rows:
        seen.update(set(words(text)))
    return ((w.decode(), n) for w, n in seen.items())


def _pair_counts(ids: dict[bytes, int]):
    def count(rows):
        n: dict[tuple[int, int], list[int]] = {}
        for toxic, text in rows:
            coded = [START, *map(ids.get, ws := words(text), repeat(OTHER, len(ws)))]
            for pair, times in Counter(zip(coded, coded[1:])).items():
                entry = n.setdefault(pair, [0, 0, 0])
                entry[toxic] += times
                entry[2] += 1
        return ((u, w, *c) for (u, w), c in n.items())
    return count


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit both models and the curve on the labelled documents outside the held-out fold."""
    rows, share = learned(docs, labels, per_class, id_col, text_col, label_col)
    model = Model(share)
    sizes = {(r["toxic"], r["fit"]): r["count"] for r in rows.groupBy("toxic", "fit").count().collect()}
    if any(not sizes.get((c, f)) for c in (0, 1) for f in (False, True)):
        return model
    seen = rows.filter("fit")
    least = rare_below(sizes[0, True] + sizes[1, True])
    vocabulary = (_counted(seen, _word_docs, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
                  .filter(F.col("docs") >= least).select("word").toArrow()["word"].to_pylist())
    vocabulary.sort()
    ids = {w.encode(): n for n, w in enumerate(vocabulary, 2)}
    pairs = cut(_counted(seen, _pair_counts(ids), "u long, w long, n0 long, n1 long, docs long").groupBy("u", "w").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "docs")]))
    befores = pairs.groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum((F.col("n0") > 0).cast("long")).alias("kinds0"),
                                     F.sum((F.col("n1") > 0).cast("long")).alias("kinds1"))
    afters = pairs.groupBy("w").agg(F.sum((F.col("n0") > 0).cast("long")).alias("n0"), F.sum((F.col("n1") > 0).cast("long")).alias("n1"),
                                    F.count("*").alias("both"))
    model.fit(vocabulary, pairs.filter(F.col("docs") >= least).select("u", "w", "n0", "n1").toArrow(), befores.toArrow(), afters.toArrow(), least)
    # the texts of the curve are scored in tasks, only two numbers of each come back
    unseen = rows.filter("not fit").select(F.col("toxic").alias("doc_id"), "text")
    shared = unseen.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict:
        x = [shared.value.features(t) for t in texts]
        return {"a": [v[0] for v in x], "b": [v[1] for v in x]}

    got = map_texts(unseen, work, [field("a", "double"), field("b", "double")]).orderBy("a", "b", "doc_id").toArrow()
    return model.curve(np.column_stack([got["a"].to_numpy(), got["b"].to_numpy()]), got["doc_id"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded: it is learned from a bounded sample
    return map_texts(id_text(docs, id_col, text_col), lambda texts: {"score": shared.value.scores(texts)}, [field("score", "double")])


def ordinary(docs: DataFrame, model: Model, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below `below`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                got = shared.value.scores([x or "" for x in part.column(at).to_pylist()])
                yield part.filter(pa.array(got < below))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
