import random

import numpy as np
import pytest

from phyllo.llm import reading as R


def text(rng, level):
    easy = "the cat sat on a mat and my dog ran to the big red box".split()
    hard = "notwithstanding multicollinear heteroscedasticity operationalisation whereby the epistemological parameterisation of stratified inference which substantiates every commensurability".split()
    words = [rng.choice(hard if rng.random() < (level - 1) / 4 else easy) for _ in range(rng.randrange(60, 120))]
    step = 4 + 5 * level
    return ". ".join(" ".join(words[i : i + step]) for i in range(0, len(words), step)) + "."


OTHER = ['{"apple_scab": 12, "peach_healthy": 4, "mango_dieback": 88}' * 4, "id,a,b\n" + "Train_1,0,1\n" * 40, "deadbeef01234567 " * 20, "=" * 300, "see tray 4", "", " \n", None, "2023-01-02 03:04:05 WARN checked=1 bad=2\n" * 20]


def test_levels_on_held_out_documents(spark, clash):
    rng = random.Random(1)
    docs = [(i, text(rng, 1 + i % 5), 1 + i % 5) for i in range(400)]
    rows = [(i, t) for i, t, _ in docs] + [(1000 + k, t) for k, t in enumerate(OTHER)]
    grades = [(i, g) for i, _, g in docs[:250]] + [(i, min(5, g + 1)) for i, _, g in docs[:20]] + [(7, None), (8, 9), (None, 3), (99999, 2), (1001, 4)]
    documents = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.level for r in R.levels(spark, documents, clash(spark.createDataFrame(grades, "doc_id long, reading_grade int"))).collect()}
    assert len(got) == len(rows) and all(got[1000 + k] is None for k in range(len(OTHER)))
    held = docs[250:]
    assert sum(abs(got[i] - g) <= 1 for i, _, g in held) / len(held) > 0.95
    assert sum((got[i] >= 4) == (g >= 4) for i, _, g in held) / len(held) > 0.85


def test_without_grades_or_documents(spark):
    documents = spark.createDataFrame([(1, "The cat sat on the mat. " * 10)], "doc_id long, text string")
    grades = spark.createDataFrame([], "doc_id long, reading_grade int")
    assert [r.level for r in R.levels(spark, documents, grades).collect()] == [None]
    assert R.levels(spark, documents.limit(0), grades).count() == 0


def test_isotonic_is_the_nearest_rising_function():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s, g = rng.permutation(30).astype(float), rng.integers(1, 6, 30).astype(float)
        knots, values = R.isotonic(s, g)
        assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
        order = g[np.argsort(s)]
        want = [max(min(order[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9)))


def test_markup_does_not_count():
    plain = "The cat sat on the mat and the dog ran to my box near the wall. " * 3
    marked = "<p>" + plain.replace("dog", "d0g") + "</p> [00:12] https://x.y/z"
    (a, shape_a, _, _), (b, shape_b, _, _) = R.measure([plain]), R.measure([marked])
    assert np.allclose(a, b, atol=0.05) and np.allclose(shape_a, shape_b, atol=0.1)


def test_prose_is_learned_from_graded_texts_among_others():
    rng = random.Random(4)
    prose = [text(rng, 1 + i % 5) for i in range(300)]
    records = [rng.choice(["Train_%d,0,1\n", "%08x ", '{"n": %d, "m": 7} ', "= %d = "]) * 30 % tuple(rng.randrange(9999) for _ in range(30)) for _ in range(60)]
    texts = prose + records + [None, ""]
    _, shape, buckets, counts = R.measure(texts)
    bags = np.zeros((len(texts), R.BUCKETS), np.float32)
    np.add.at(bags, (np.repeat(np.arange(len(texts)), counts), buckets), 1)
    bags /= np.maximum(bags.sum(1, keepdims=True), 1)
    graded = np.arange(len(texts)) < 60  # a fifth of the prose; the rest is not marked
    said = R.Prose(shape, bags, graded)(shape, buckets, counts)
    assert said[:300].mean() > 0.99 and not said[300:].any()


@pytest.mark.parametrize("bad", ["\ud800 half", "a" * 200_000])
def test_strange_texts(bad):
    R.measure([bad])
