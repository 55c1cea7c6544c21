import random

import pyarrow as pa
import pytest

from phyllo.llm import overlap as O

from ..conftest import rows_of

REC = "id long, text string"


@pytest.mark.parametrize("parts", [1, 9])
def test_spans_and_coverage_equal_brute_force(spark, clash, parts):
    rng = random.Random(1)
    words = ["ab", "abc", "bca", "ééx", "c"]
    records = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(60, None), (61, "")]
    k = 6
    places = {}
    for i, text in records:
        for p in range(len(text or "") - k + 1):
            places.setdefault(text[p : p + k], set()).add((i, p))
    want = {}
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                want.setdefault(i, set()).update(range(p, p + k))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spans = O.shared_spans(spark, clash(spark.createDataFrame(records, REC)), k)
        text = dict(records)
        rows = spans.collect()
        got = {r.b: r.covered for r in O.coverage(spans).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for r in rows:
        assert k <= r.span <= 2 * k and text[r.a][r.pos_a : r.pos_a + r.span] == text[r.b][r.pos_b : r.pos_b + r.span] and r.size == len(text[r.b])
    # A centre has no span to itself: it holds those of its members.
    for r in rows:
        got[r.a] = got.get(r.a, 0)
    assert set(got) == set(want)
    covered = {}
    for r in rows:
        covered.setdefault(r.b, set()).update(range(r.pos_b, r.pos_b + r.span))
    assert all(got[i] == len(c) for i, c in covered.items())
    for r in rows:
        covered.setdefault(r.a, set()).update(range(r.pos_a, r.pos_a + r.span))
    assert covered == want


def test_a_run_that_a_border_cuts_after_one_row():
    """The parts of a run that two tasks hold are told by the centres at their borders."""
    def batch(*rows):
        return pa.RecordBatch.from_pylist([{"suffix": s, "id": i, "pos": 0, "size": len(s)} for s, i in rows])

    run = O._runs(3)
    first = [r for b in run(iter([batch(("aaa", 1), ("hhhx", 1))])) for r in b.to_pylist()]
    second = [r for b in run(iter([batch(("hhhx", 2)), batch(("hhhy", 3), ("iii", 1), ("jjj", 2))])) for r in b.to_pylist()]
    assert {(r["a"], r["text"], r["whole"]) for r in first} == {(1, t, w) for t in ("aaa", "hhhx") for w in (True, False)}
    assert [(r["a"], r["b"], r["span"], r["whole"]) for r in second if r["b"]] == [(2, 3, 3, False)]
    assert {(r["a"], r["text"], r["whole"]) for r in second if not r["b"]} == {(2, t, w) for t in ("hhhx", "jjj") for w in (True, False)}


def test_pairs_across_splits(spark, make_items):
    same = [5] * 8
    items = make_items({"sha": "x", "hashes": same}, {"sha": "x", "hashes": same}, {"sha": "x", "hashes": same}, {"sha": "x", "hashes": same}, {"sha": "y"}, {"sha": "y"})
    m = [(0, "train"), (1, "VAL "), (1, "train"), (2, "testing"), (3, None), (3, "odd"), (4, "train"), (5, "train"), (None, "test")]
    manifest = spark.createDataFrame([(i, s, "src") for i, s in m] * 2, "item_id long, split string, source_dataset string")
    pairs = O.split_overlaps(spark, items, manifest)
    assert rows_of(pairs) == [(0, 1), (0, 2), (1, 2)]
    report = {(r.split, r.source_dataset): (r.n_items, r.n_pairs) for r in O.overlap_report(O.photographs(spark, items), manifest).collect()}
    assert report == {("val", "src"): (1, 1), ("test", "src"): (1, 2)}
    assert O.split_overlaps(spark, items, manifest.limit(0)).count() == 0


def test_report_counts_items_whose_own_rows_stand_in_both_splits(spark, make_items):
    items = make_items({"sha": "x"}, {"sha": "x"}, {"sha": "y"}, {"sha": "z"}, {"sha": "w"})
    m = [(0, "train"), (1, "val"), (1, "train"), (2, "Train"), (2, " VAL"), (2, "test"), (3, "train"), (3, "odd"), (4, "val"), (None, "train"), (None, "val")]
    manifest = spark.createDataFrame([(i, s, "src") for i, s in m] * 2, "item_id long, split string, source_dataset string")
    pairs = O.split_overlaps(spark, items, manifest)
    assert rows_of(pairs) == [(0, 1)]
    report = {(r.split, r.source_dataset): (r.n_items, r.n_own, r.n_pairs) for r in O.overlap_report(O.photographs(spark, items), manifest).collect()}
    assert report == {("val", "src"): (2, 2, 1), ("test", "src"): (1, 1, 0)}


def test_a_text_that_many_records_share(spark):
    records = [(i, "q" * 60 + "abcd") for i in range(900)] + [(i, f"{i:064}") for i in range(900, 950)]
    spans = O.shared_spans(spark, spark.createDataFrame(records, REC).repartition(8), 32, 16)
    whole = O.coverage(spans.where("a <> b"), "a").where("share = 1")
    assert rows_of(whole, "a", "b") == sorted([(0, i) for i in range(1, 900)], key=str)


@pytest.mark.parametrize("parts", [1, 13])
def test_same_pixels_equal_the_groups_of_digests(spark, make_items, parts):
    rng = random.Random(2)
    digests = [f"{rng.getrandbits(256):064x}" for _ in range(30)]
    digests += [digests[0][:32] + digests[1][32:], digests[2][:48] + digests[3][48:]]  # half of another one is no copy
    items = make_items(*({"sha": rng.choice([d, d.upper(), f" {d} "])} for d in (rng.choice(digests + digests[:2] * 9) for _ in range(200))), {"sha": None}, {"sha": ""}, {"sha": "odd"}, {"sha": "ODD "})
    first = {}
    want = []
    for r in items.orderBy("item_id").collect():
        key = (r.sha256_pixels or "").strip().lower()
        if key:
            if key in first:
                want.append((first[key], r.item_id))
            first.setdefault(key, r.item_id)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(O.same_pixels(spark, items.union(items)), "a", "b") == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
