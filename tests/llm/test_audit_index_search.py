"""Source audit, digest index and reversed search against plain Python, on odd documents and small parts."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlog.llm import divergence, exact, search
from roadlog.llm.common import cut

ITEMS = [("a", "one two Words"), ("a", "three ONE"), ("b", None), ("c", ""), (None, "nbsp base ünïcode"), ("d", "a b"), ("d", "a b"), ("e", "zzz unknown")]


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 200, "cells": 5}])
@pytest.mark.parametrize("least", [1, 3, 10])
def test_audit(odd, same, sizes, least):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    same(divergence.audit(odd, least_docs=least, **sizes).collect(), brute.audit(rows, least))


def test_audit_random(spark, same):
    rng = random.Random(4)
    words = ["a", "ab", "ABC", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghijklmnopq", "abcdefghijklmnopr", "x" * 70 + "y", "x" * 70 + "z", "x" * 200, "é", "éa", "日本"]
    rows = [(rng.choice([" ", ",", "\n9"]).join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice("abcde")) for _ in range(200)]
    rows += [(None, None, None), ("", "xx", "alone"), ("12 34", "yy", "a"), ("", "yy", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    same(divergence.audit(docs, slice_bytes=3000, cells=20).collect(), brute.audit(rows))


def test_audit_of_nothing(none):
    assert divergence.audit(none).count() == 0


def test_pointers_are_sorted():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cé1") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["q" * 5000, "q" * 5000 + "r", "ends", "starts"]
    held = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    letters = np.zeros(len(held) + 8, np.uint8)
    letters[:-8] = divergence._LETTERS[np.frombuffer(held, np.uint8)]
    starts, lengths = divergence.word_starts(letters[:-8], offsets)
    word = [letters[s:s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist())]
    assert [w.decode() for w in word] == [w for t in texts for w in brute.LETTERS.findall(t.translate(brute.LOWER))]
    order, run = divergence.sort_pointers(letters, starts, lengths)
    ranked = [word[k] for k in order]
    assert ranked == sorted(word)
    assert run.tolist() == np.concatenate(([0], np.cumsum([a != b for a, b in zip(ranked[1:], ranked)]))).tolist()


def test_slices_keep_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "", "bbbbbbbb", "c", "d", ""])], ["text"]).slice(1)
    parts = [p.column(0).to_pylist() for p in divergence.slices(batch, 3)]
    assert sum(parts, []) == ["", "bbbbbbbb", "c", "d", ""] and ["bbbbbbbb"] in [[x for x in p if x] for p in parts]


def _absorbed(index, docs, batch):
    found = index.absorb(cut(exact.digested(docs)), batch)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()


@pytest.fixture
def index_path(tmp_path_factory):
    return str(tmp_path_factory.mktemp("index") / "texts")


def test_digest_index(spark, odd, pairs, same, index_path):
    same(_absorbed(exact.DigestIndex.create(spark, index_path, 10), odd, "one"), brute.copies(pairs))


def test_hot_text(spark, same, index_path):
    rows = [(k, "copy  of one" if k % 3 else f"text {k % 50}") for k in range(1, 4000)] + [(0, "copyofone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(_absorbed(exact.DigestIndex.create(spark, index_path, 10), docs, "one"), brute.copies(rows))


def test_later_batches(spark, same, index_path):
    rows = [[(1, "a b"), (2, "ab"), (3, "c"), (4, "c"), (None, "d")], [(0, "a  b"), (5, "e"), (6, "e "), (7, "d"), (8, None)], [(9, ""), (10, "f")]]
    index = exact.DigestIndex.create(spark, index_path, 10)
    docs = [spark.createDataFrame(r, "doc_id long, text string") for r in rows]
    same([r[:4] for r in _absorbed(index, docs[0], "0")], [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 1, True)])
    second = [(0, 1, 1, False), (5, 6, 2, False), (6, 6, 2, True), (7, None, 1, False), (8, 8, 1, True)]
    same([r[:4] for r in _absorbed(index, docs[1], "1")], second)
    index = exact.DigestIndex.open(spark, index_path)               # as a later session finds it
    assert index.rows().count() == 5
    same([r[:4] for r in _absorbed(index, docs[1], "1")], second)   # the same batch again
    assert index.rows().count() == 5
    same([r[:4] for r in _absorbed(index, docs[2], "2")], [(9, 8, 1, False), (10, 10, 1, True)])
    assert exact.distinct(docs[2], index, "2").columns == ["doc_id", "text"]


def test_index_is_not_shuffled(spark, index_path):
    index = exact.DigestIndex.create(spark, index_path, 10)
    dealt = spark.range(100).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).repartition(index.buckets, "digest")
    plan = dealt.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_distinct_keeps_columns(spark, odd, none, pairs, index_path):
    index = exact.DigestIndex.create(spark, index_path, 10)
    assert exact.distinct(none, index, "none").count() == 0 and index.rows().count() == 0
    kept = exact.distinct(odd, index, "one")
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in brute.copies(pairs) if r[3])
    assert exact.distinct(odd, index, "two").count() == 0


@pytest.mark.parametrize("block", [400_000, 3])
@pytest.mark.parametrize("top", [1, 10])
def test_search(spark, odd, pairs, same, block, top):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, score int")
    found = search.search(odd, items, top=top, block_postings=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    same(found.collect(), brute.search(pairs, ITEMS, top))


def test_search_random(spark, same):
    rng = random.Random(8)
    docs = [(rng.randint(0, 300), " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for _ in range(600)]
    items = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 6)))) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    same(search.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect(), brute.search(docs, items))


def test_small_slabs_change_nothing(spark, odd, same):
    index = search.Inverted(pa.table({"item_id": pa.array([1, 1, 2, 3]), "term": pa.array(["one", "a", "a", "b"])}))
    counted = cut(search.counts(odd, index))
    n, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    weights = search.weights_of(counted, n, len(index.terms))
    wide, narrow = (search.merged(search.stream(counted, index, weights, n, length, slab=s), "item") for s in (2_000_000, 1))
    same(wide.collect(), narrow.collect())


def test_search_of_nothing(spark, none, odd):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert search.search(none, items).count() == 0
    assert search.search(odd, items.limit(0)).count() == 0
