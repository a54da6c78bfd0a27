"""Toxicity by held-out accuracy, near copies by similarity, and the pipeline stage by stage."""

import random
import zlib

import brute
import corpus_pipeline
import pytest
from oddities import prose
from pyspark.sql import functions as F

from roadlog.llm import simhash, toxicity
from roadlog.llm.common import cut, load

INSULTS = ["idiot", "moron", "scum", "trash"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = prose(rng, rng.randint(20, 120))
        for _ in range(max(2, len(words) // 40) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    labels += [(None, 1), (5, None), (99999, 1), (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows)


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_held_out_accuracy(labelled):
    docs, labels, texts = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.held == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held]
    assert len(test) > 100 and sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in test) / len(test) > 0.97
    kept = {r.doc_id for r in toxicity.ordinary(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.5}


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    b = toxicity.score(docs, toxicity.fit(docs, flipped)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_toxicity_of_odd_documents(spark, odd, none, labelled):
    labels = labelled[1]
    model = toxicity.fit(labelled[0], labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.ordinary(odd, model).schema == odd.schema
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, empty)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.filter("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with a growing number of changed words, in groups."""
    rng = random.Random(21)
    rows = []
    for g in range(40):
        base = prose(rng, rng.choice([30, 60, 150, 400]))
        for edits in (0, 0, 1, 1, 2, 4):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def named(docs, **sizes):
    sketches = cut(simhash.sketched(docs))
    return {r.doc_id: r.component_id for r in simhash._named(sketches.select("doc_id", "fp"), simhash.near(sketches, docs, **sizes)).collect()}


@pytest.mark.parametrize("sizes", [{}, {"bucket": 1}, {"bucket": 1, "piece": 64, "load": 2000}])
def test_near_copies(copies, sizes):
    docs, rows = copies
    rows = sorted(rows)
    assert named(docs, **sizes) == dict(enumerate(brute.classes(rows, lambda a, b: brute.jaccard(rows[a][1], rows[b][1]) >= 0.8)))


@pytest.mark.parametrize("sizes", [{}, {"bucket": 1}])
def test_pairs_at_the_threshold(spark, sizes):
    """Pairs between 0.77 and 0.83 from 130 shingles up: those of 0.8 or more are found, the others are not."""
    rng = random.Random(31)
    rows, similar = [], []
    for n in (130, 200, 400, 800, 1600):
        for _ in range(80):
            base = [f"w{rng.randrange(10 ** 9)}" for _ in range(n + 4)]
            more = [f"w{rng.randrange(10 ** 9)}" for _ in range(rng.randint(int(n * 0.205), int(n * 0.298)))]
            if rng.random() < 0.5:
                pair = base, base + more
            else:
                other = list(base)
                for at in rng.sample(range(n), rng.choice([n // 45, n // 45 + 1])):
                    other[at] = f"w{rng.randrange(10 ** 9)}"
                pair = base, other
            rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(pair)]
            similar.append(brute.jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    got = named(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    linked = [got[2 * k + 1] == 2 * k for k in range(len(similar))]
    assert not any(x and not y for x, y in zip(linked, similar))
    assert sum(similar) > 150 and sum(linked) >= 0.99 * sum(similar)


@pytest.mark.parametrize("sizes", [{}, {"piece": 64}])
def test_copies_of_one_text_that_differ_from_each_other(spark, sizes):
    rng = random.Random(5)
    base = prose(rng, 600)
    base = [f"{w}{rng.randrange(100)}" for w in base]
    rows = [(0, " ".join(base))]
    for k in range(1, 301):
        words = list(base)
        for at in rng.sample(range(len(words)), 10):
            words[at] = f"edit{rng.randrange(10 ** 9)}"
        rows.append((k, " ".join(words)))
    assert all(brute.jaccard(rows[0][1], t) >= 0.8 for _, t in rows) and brute.jaccard(rows[1][1], rows[2][1]) < 0.78
    assert set(named(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).values()) == {0}


@pytest.mark.parametrize("sizes", [{}, {"bucket": 1, "piece": 8}])
def test_short_near_copies(spark, sizes):
    """Short texts against themselves with words added, taken off and changed, also where all hold one passage: every pair, exactly."""
    rng = random.Random(6)
    passage, texts = [f"passage{k}" for k in range(6)], set()
    for n in range(6, 41):
        for g in range(2):
            base = [f"{w}{rng.randrange(1000)}" for w in prose(rng, n)]
            base = base[:-6] + passage if g and n > 12 else base
            for more in range(1 + n // 4):
                texts.add(" ".join(base + [f"more{rng.randrange(10 ** 9)}" for _ in range(more)]))
                texts.add(" ".join([f"more{rng.randrange(10 ** 9)}" for _ in range(more)] + base))
            words = list(base)
            words[rng.randrange(n)] = "other"
            texts.add(" ".join(words))
    rows = list(enumerate(sorted(texts)))
    sets = [set(brute.shingles(t, 5)) for _, t in rows]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    expected = brute.classes(rows, similar)
    number = [simhash._set_id(simhash._hashes(t, 5)) for _, t in rows]
    assert named(spark.createDataFrame(rows, "doc_id long, text string"), **sizes) == dict(enumerate(expected))
    assert len(set(number)) == len(rows) > len(set(expected)) + 500


def test_one_of_each_group_stays(copies, odd, pairs):
    docs, rows = copies
    kept = [r.doc_id for r in simhash.distinct(docs).collect()]
    rows = sorted(rows)
    assert sorted(kept) == sorted(set(brute.classes(rows, lambda a, b: brute.jaccard(rows[a][1], rows[b][1]) >= 0.8)))
    got = simhash.distinct(odd)
    assert got.columns == odd.columns
    sets = brute.Sets(len(pairs))
    for a in range(len(pairs)):
        for b in range(a):
            if brute.jaccard(pairs[a][1], pairs[b][1]) >= 0.8:
                sets.join(a, b)
    members = {}
    for k, row in enumerate(pairs):
        members.setdefault(sets.find(k), []).append(row)
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len(left) == len(members)
    for rows in members.values():
        least = min((i for i, _ in rows if i is not None), default=None)
        assert any(i == least and (i, t) in rows for i, t in left)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, on the small tables."""
    docs, out = load(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, SF))
        out[name] = (docs, made)
        docs = made
    return out


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stage_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["mixing"][1].collect()))


def test_stage_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scores = toxicity.score(before, toxicity.fit(before, load(spark, SF, "labels"))).collect()
    assert {r.doc_id for r in scores if r.score < 0.5} == {i for i, _ in pairs_of(after)}


def test_stage_lines(stages, same):
    before, after = stages["line_dedup"]
    same(pairs_of(after), [(n, t) for n, _, _, t in brute.lines(pairs_of(before))])
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_stage_near_copies(stages):
    before, after = stages["near_dedup"]
    rows = pairs_of(before)
    sets = [set(brute.shingles(t, 5)) for _, t in rows]
    alike = lambda least: lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    kept = {i for i, _ in pairs_of(after)}
    assert set(brute.classes(rows, alike(0.72))) <= kept and len(kept - set(brute.classes(rows, alike(0.8)))) <= 1


def test_stage_leaks(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    found, left = brute.leaks(pairs_of(before), items), dict(pairs_of(after))
    texts = dict(pairs_of(before))
    for name, n_words, n_hit, _, _, hit in found:
        if not hit:
            assert left[name] == texts[name]
        elif n_hit > 0.5 * n_words:
            assert name not in left
        else:
            assert len(brute.ITEM_WORD.findall(left[name].translate(brute.LOWER))) >= n_words - n_hit - 2
    assert any(f[5] for f in found) and not any(f[5] for f in brute.leaks(pairs_of(after), items))


def test_stage_mixing(stages):
    before, after = stages["mixing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in pairs_of(before)}
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    assert 1.5 * total - largest <= sum(r.taken for r in rows) <= 1.5 * total
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * max(r.size for r in mine)


def test_stages_on_odd_documents(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            assert made.count() <= docs.count()
            if name != "mixing":
                assert made.columns == docs.columns, name
