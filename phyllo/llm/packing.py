"""Filling fixed-capacity containers with items.

Vector best-fit: each container has three capacities (tokens, documents and
attention cost, the sum of squared lengths); an item goes into the open
container that it fits in all three and that it leaves with the smallest
weighted residual norm, the largest items first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = (1.0, 0.25, 0.25)
OUT = ["pack_name", "container_id", "doc_id", "piece", "tokens", "capacity_tokens"]


def best_fit(sizes: list[int], tokens: int, documents: int, attention: int, weights: tuple = WEIGHTS) -> list[int]:
    """Container number of each size, for sizes in descending order that fit an empty container.

    Open containers are kept in the order of their free tokens. The search goes
    upward from the item's size and ends where the token term alone is no
    better than the best norm found, so its result is that of a full scan.
    """
    a, b, c = weights[0] / tokens**2, weights[1] / documents**2, weights[2] / attention**2
    opened: list[tuple[int, int, int, int]] = []  # free tokens, container, free documents, free attention
    out, count = [], 0
    smallest = sizes[-1] if sizes else 0
    for size in sizes:
        cost = size * size
        best, found = None, -1
        for at in range(bisect_left(opened, (size,)), len(opened)):
            free, _, docs, att = opened[at]
            low = a * (free - size) ** 2
            if best is not None and low >= best:
                break
            if docs and att >= cost:
                norm = low + b * (docs - 1) ** 2 + c * (att - cost) ** 2
                if best is None or norm < best:
                    best, found = norm, at
        if found < 0:
            free, box, docs, att = tokens, count, documents, attention
            count += 1
        else:
            free, box, docs, att = opened.pop(found)
        out.append(box)
        if free - size >= smallest and docs > 1:
            insort(opened, (free - size, box, docs - 1, att - cost))
    return out


def pack(
    spark: SparkSession,
    counts: DataFrame,
    capacities: DataFrame,
    shard_items: int = 8192,
    documents_per_token: float = 1 / 128,
    attention_share: float = 0.8,
    weights: tuple = WEIGHTS,
) -> DataFrame:
    """Containers of every capacity: ``pack_name``, ``container_id``, ``doc_id``, ``piece``, ``tokens``, ``capacity_tokens``.

    counts: ``doc_id`` and ``tokens``. Only an item longer than the capacity is
    split, into full pieces (each a container of its own) and a remainder. The
    items are spread over shards of about ``shard_items`` by a hash of their id
    and each shard is packed by itself: at most a few open containers per shard
    are lost against one global packing, and no task grows with the corpus.
    A container holds one document for each 128 tokens of capacity, and squared
    lengths up to ``attention_share`` of the squared capacity; an item that
    exceeds this by itself has its container alone.
    Items without tokens are packed too and use up only a document's place.
    A null count is 0; a capacity that is null or below 1 holds nothing and is left out.
    """
    sizes = [(r["pack_name"], r["capacity_tokens"]) for r in capacities.select("pack_name", "capacity_tokens").distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("more than 1000 container sizes")
    sizes = sorted((n, c) for n, c in sizes if c and c > 0)
    if not sizes:
        return spark.createDataFrame([], "pack_name string, container_id string, doc_id long, piece int, tokens int, capacity_tokens int")
    counts = counts.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    shards = max(1, -(-counts.count() // shard_items))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).alias("capacity_tokens")) for n, c in sizes)))
    fit = counts.select("doc_id", "tokens", each.alias("p")).select("doc_id", "tokens", "p.*")
    fit = fit.withColumn("full", F.expr("tokens div capacity_tokens").cast("int")).withColumn("rest", (F.col("tokens") % F.col("capacity_tokens")).cast("int"))
    full = fit.where("full > 0").select("pack_name", "doc_id", "capacity_tokens", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    full = full.select(
        "pack_name", F.concat_ws("/", "pack_name", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", F.col("capacity_tokens").alias("tokens"), "capacity_tokens"
    )
    rest = fit.where("rest > 0 OR tokens = 0").select("pack_name", "capacity_tokens", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    # Many shards share a task; each is packed as its rows end.
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rest = rest.repartition("pack_name", "shard").sortWithinPartitions("pack_name", "shard", F.desc("tokens"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            name, cap, shard = t["pack_name"][0].as_py(), t["capacity_tokens"][0].as_py(), t["shard"][0].as_py()
            boxes = best_fit(t["tokens"].to_pylist(), cap, max(1, int(cap * documents_per_token)), max(1, int(cap * cap * attention_share)), weights)
            ids = pa.array([f"{name}/{shard}/{box}" for box in boxes], pa.string())
            return t.append_column("container_id", ids).select(OUT).to_batches()[0]

        now = None
        for batch in batches:
            keys = list(zip(batch.column("pack_name").to_pylist(), batch.column("shard").to_pylist()))
            begin = 0
            for i, key in enumerate(keys):
                if key != now:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield done()
                    held, begin, now = [], i, key
            held.append(batch.slice(begin))
        if held:
            yield done()

    id_type = counts.schema["doc_id"].dataType.simpleString()
    packed = rest.mapInArrow(run, f"pack_name string, container_id string, doc_id {id_type}, piece int, tokens int, capacity_tokens int")
    return full.unionByName(packed)


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens in them, the least number of containers possible and the fill ratio."""
    per = packed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"))
    sums = per.groupBy("pack_name", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return sums.select("*", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_ratio"))
