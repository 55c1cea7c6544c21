import random

import pytest
from pyspark.sql import functions as F

from phyllo.llm import packing as P


def full_scan(sizes, tokens, documents, attention, weights=P.WEIGHTS):
    boxes, out = [], []
    for s in sizes:
        fits = [(weights[0] * ((f - s) / tokens) ** 2 + weights[1] * ((d - 1) / documents) ** 2 + weights[2] * ((a - s * s) / attention) ** 2, i) for i, (f, d, a) in enumerate(boxes) if f >= s and d >= 1 and a >= s * s]
        if fits:
            i = min(fits)[1]
        else:
            boxes.append((tokens, documents, attention))
            i = len(boxes) - 1
        f, d, a = boxes[i]
        boxes[i] = (f - s, d - 1, a - s * s)
        out.append(i)
    return boxes, out


@pytest.mark.parametrize("seed", range(8))
def test_search_is_as_good_as_a_full_scan(seed):
    rng = random.Random(seed)
    tokens, documents, attention = 100, rng.choice([3, 50]), rng.choice([2500, 10000])
    sizes = sorted((rng.randrange(0, 50) for _ in range(200)), reverse=True)
    got = P.best_fit(sizes, tokens, documents, attention)
    used = {}
    for s, box in zip(sizes, got):
        used.setdefault(box, []).append(s)
    for items in used.values():
        assert sum(items) <= tokens and len(items) <= documents and (sum(s * s for s in items) <= attention or len(items) == 1)
    assert len(used) <= len(full_scan(sizes, tokens, documents, attention)[0]) + 1


def test_every_text_is_packed_and_only_long_ones_are_split(spark, clash):
    rng = random.Random(9)
    lengths = [rng.choice([0, 1, 40, 100, 101, 250, rng.randrange(1, 90)]) for _ in range(500)]
    counts = clash(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, tokens long"))
    caps = spark.createDataFrame([("s", 100), ("l", 1000), ("s", 100), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    done = P.pack(spark, counts, caps, shard_items=100, documents_per_token=1.0).cache()
    for name, cap in (("s", 100), ("l", 1000)):
        mine = done.where(F.col("pack_name") == name)
        per = {r.doc_id: (r.n, r.k, r.parts) for r in mine.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.collect_set("piece").alias("parts")).collect()}
        assert len(per) == 500
        for i, size in enumerate(lengths):
            n, k, parts = per[i]
            assert n == size and k == max(1, -(-size // cap)) and sorted(parts) == list(range(k))
        assert mine.groupBy("container_id").agg(F.sum("tokens").alias("n")).where(F.col("n") > cap).count() == 0
    assert {r.pack_name for r in done.select("pack_name").distinct().collect()} == {"s", "l"}
    for r in P.fill(done).collect():
        assert r.least_containers <= r.n_containers and 0.8 < r.fill_ratio <= 1


def test_each_capacity_binds_by_default():
    rng = random.Random(2)
    sizes = sorted((min(511, int(rng.lognormvariate(5, 0.7))) for _ in range(4000)), reverse=True)

    def boxes(documents=4, attention=int(0.8 * 512 * 512)):
        return len(set(P.best_fit(sizes, 512, documents, attention)))

    assert boxes() > boxes(documents=512) and boxes() > boxes(attention=512 * 512) and sum(sizes) / 512 / boxes() > 0.9


def test_no_items_and_no_containers(spark):
    counts = spark.createDataFrame([], "doc_id long, tokens long")
    caps = spark.createDataFrame([("s", 100)], "pack_name string, capacity_tokens int")
    assert P.pack(spark, counts, caps).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, tokens long")
    assert [(r.tokens, r.piece) for r in P.pack(spark, one, caps).collect()] == [(0, 0)]
    assert P.pack(spark, one, caps.limit(0)).count() == 0
