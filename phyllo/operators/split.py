"""Grouped train, validation and test splits."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

SPLITS = ("train", "val", "test")
FRACTIONS = (0.8, 0.1, 0.1)


def component_histogram(rows: DataFrame) -> DataFrame:
    """Images of each label in each component."""
    return rows.groupBy("root", "class_label").agg(F.count("*").alias("n"))


def split_targets(rows: DataFrame, fractions: tuple = FRACTIONS) -> DataFrame:
    """Wanted images of each label in each split."""
    share = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.lit(f).alias("fraction")) for s, f in zip(SPLITS, fractions))))
    counts = rows.groupBy("class_label").agg(F.count("*").alias("n")).withColumn("s", share)
    return counts.select("class_label", "s.split", (F.col("n") * F.col("s.fraction")).alias("target"))


def greedy(components: Iterable[tuple[object, dict[str, int], bool]], totals: dict[str, int], seed: int, fractions: tuple = FRACTIONS) -> Iterator[tuple[object, str]]:
    """Split of each component.

    components: (key, images per label, held in train) in the order of their
    first members. Held ones go to train first. The others are shuffled by the
    seed. Each label in order reserves its smallest component for test and then
    for val, if that split lacks the label and at least three components have
    it. The rest goes, largest first, where it costs least: over its labels,
    the change of the squared distance to the target, relative to the target.
    """
    counts = {s: Counter() for s in SPLITS}
    targets = {s: {label: n * f for label, n in totals.items()} for s, f in zip(SPLITS, fractions)}
    placed: dict[object, str] = {}
    pool = []
    for key, bag, held in components:
        if held:
            placed[key] = "train"
            counts["train"].update(bag)
        else:
            pool.append((key, bag, sum(bag.values())))
    random.Random(seed).shuffle(pool)
    having: dict[str, list] = {}
    for entry in pool:
        for label in entry[1]:
            having.setdefault(label, []).append(entry)
    for label in sorted(totals):
        options = sorted(having.get(label, ()), key=lambda e: e[2])
        if len(options) < 3:
            continue
        free = iter(options)
        for split in ("test", "val"):
            if counts[split][label]:
                continue
            for key, bag, _ in free:
                if key not in placed:
                    placed[key] = split
                    counts[split].update(bag)
                    break

    def cost(split: str, bag: dict[str, int]) -> float:
        have, want = counts[split], targets[split]
        return sum(((have[x] + n - want[x]) ** 2 - (have[x] - want[x]) ** 2) / max(want[x], 1) for x, n in bag.items())

    for key, bag, _ in sorted(pool, key=lambda e: -e[2]):
        if key not in placed:
            best = min(SPLITS, key=lambda s: cost(s, bag))
            placed[key] = best
            counts[best].update(bag)
    return iter(placed.items())


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


HALVES = 7


def size_rounds(n: Column, name: Column) -> Column:
    """Round of a component, rising: the larger the earlier, by powers of two; components of less than
    four rows in rounds that are halved each time, by a hash of their names."""
    size = F.floor(F.log2(n.cast("double"))).cast("int")
    half = F.least(F.floor(-F.log2(uniform(name, F.lit("round")))), F.lit(HALVES - 1)).cast("int")
    return F.when(size > 1, -size).otherwise(half)


def _held(source: str | None) -> Column:
    return F.coalesce(F.max(F.col("source_dataset").eqNullSafe(F.lit(source))), F.lit(False)) if source else F.lit(False)


def grouped_split(rows: DataFrame, seed: int = 42, fractions: tuple = FRACTIONS, train_only_source: str | None = None, exact: bool = False) -> DataFrame:
    """``root`` and ``split`` of each component, balanced by label.

    Components are placed in rounds from large to small, each round by all
    tasks: a component draws a split by weighted rendezvous hashing, the
    weight being what the split still lacks of the component's labels, and only
    where it fits. Before that each label with three components at least gives
    its smallest to test and the next to val, and components of
    ``train_only_source`` go to train. A round is one Spark job; there is one
    for each power of two between the sizes, and HALVES for the small ones.

    ``exact`` repeats the sequential choice of ``greedy`` for a seeded shuffle.
    Each step of it depends on all before, so one task makes it, from one row
    per component: for collections whose components fit into a task.
    """
    if exact:
        return _greedy_split(rows, seed, fractions, train_only_source)
    spark = rows.sparkSession
    scratch = Scratch(spark, "split")
    bags = scratch.save(component_histogram(rows))
    comps = rows.groupBy("root").agg(F.count("*").alias("size"), _held(train_only_source).alias("held"))
    comps = scratch.save(comps.withColumn("round", size_rounds(F.col("size"), F.concat_ws(":", F.col("root").cast("string"), F.lit(seed)))))
    free = bags.join(comps.where("NOT held"), "root").withColumn("at", F.struct("size", F.xxhash64("root", F.lit(seed)).alias("h"), "root"))
    smallest = free.groupBy("class_label").agg(F.min("at").alias("first"), F.count("*").alias("k")).where("k >= 3").drop("k")
    second = free.join(smallest, "class_label").where("at <> first").groupBy("class_label").agg(F.min("at").alias("second"), F.first("first").alias("first"))
    wanted = second.select(F.explode(F.array(F.struct(F.col("first.root").alias("root"), "class_label", F.lit("test").alias("split")), F.struct(F.col("second.root").alias("root"), "class_label", F.lit("val").alias("split")))).alias("w"))
    reserved = wanted.select("w.*").groupBy("root").agg(F.min_by("split", F.struct("class_label", "split")).alias("split"))
    placed = [scratch.save(comps.where("held").select("root", F.lit("train").alias("split")).unionByName(reserved))]
    lacks = bags.groupBy("class_label").agg(F.sum("n").alias("total"), *((F.sum("n") * f).alias(f"l{k}") for k, f in enumerate(fractions)))
    rest = scratch.save(comps.join(placed[0], "root", "left_anti"))
    rounds = [r["round"] for r in rest.select("round").distinct().orderBy("round").collect()]  # at most 64 + HALVES rows

    def less(lacks: DataFrame, done: DataFrame) -> DataFrame:
        taken = done.join(bags, "root").groupBy("class_label").agg(*(F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"t{k}") for k, s in enumerate(SPLITS)))
        left = lacks.join(taken.withColumnRenamed("class_label", "label"), F.col("class_label").eqNullSafe(F.col("label")), "left")
        return scratch.save(left.select("class_label", "total", *((F.col(f"l{k}") - F.coalesce(f"t{k}", F.lit(0))).alias(f"l{k}") for k in range(len(SPLITS)))))

    lacks = less(lacks, placed[0])
    for number in rounds:
        now = rest.where(F.col("round") == number).select("root").join(bags, "root")
        now = now.join(lacks.withColumnRenamed("class_label", "label"), F.col("class_label").eqNullSafe(F.col("label")))
        sums = now.groupBy("root").agg(*(F.sum(F.col("n") * F.col(f"l{k}") / F.col("total")).alias(f"w{k}") for k in range(len(SPLITS))), *(F.min(F.col(f"l{k}") >= F.col("n")).alias(f"fits{k}") for k in range(len(SPLITS))))
        scores = F.array(*(F.struct((-F.ln(uniform(F.col("root"), F.lit(s), F.lit(seed))) / F.when(F.col(f"fits{k}") & (F.col(f"w{k}") > 0), F.col(f"w{k}"))).alias("score"), F.lit(s).alias("split")) for k, s in enumerate(SPLITS)))
        drawn = F.array_min(F.filter(scores, lambda x: x["score"].isNotNull()))["split"]
        most = F.array_max(F.array(*(F.struct(F.col(f"w{k}").alias("w"), F.lit(-k).alias("k"), F.lit(s).alias("split")) for k, s in enumerate(SPLITS))))["split"]
        placed.append(scratch.save(sums.select("root", F.coalesce(drawn, most).alias("split"))))
        lacks = less(lacks, placed[-1])
    return reduce(DataFrame.unionByName, placed)


def _greedy_split(rows: DataFrame, seed: int, fractions: tuple, train_only_source: str | None) -> DataFrame:
    from .relate import order_key

    held = _held(train_only_source)
    heads = rows.groupBy("root").agg(F.min(order_key()).alias("first"), held.alias("held"))
    bags = component_histogram(rows).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_label", "n")))).alias("bag"))
    one = heads.join(bags, "root").repartition(1).sortWithinPartitions("first").select("root", "bag", "held")
    kind = rows.schema["root"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        parts = [(r, dict(b), h) for p in batches for r, b, h in zip(p["root"].tolist(), p["bag"].tolist(), p["held"].tolist())]
        totals: Counter = Counter()
        for _, bag, _ in parts:
            totals.update(bag)
        done = list(greedy(parts, totals, seed, fractions))
        yield pd.DataFrame({"root": [k for k, _ in done], "split": [s for _, s in done]})

    return one.mapInPandas(run, f"root {kind}, split string")


def hash_split(rows: DataFrame, fractions: tuple = FRACTIONS, seed: int = 42) -> DataFrame:
    """Each row with the split that a hash of its component gives.

    Distributed and stable when data is added, but neither balanced by label
    nor sure to cover every label; an addition to the operators of the survey.
    The hash is the head of an MD5, which other engines have too.
    """
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("root").cast("string"), F.lit(seed))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.withColumn("split", F.when(spot < fractions[0], "train").when(spot < fractions[0] + fractions[1], "val").otherwise("test"))


def split_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "class_label").agg(F.count("*").alias("n"))


def split_class_grid(rows: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """Images of every label in every split, zeros included."""
    grid = labels.select("class_label", F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    return grid.join(split_distribution(rows), ["split", "class_label"], "left").select("split", "class_label", F.coalesce("n", F.lit(0)).alias("n"))


def data_summary(rows: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """Per split: images, groups, labels with images and labels without; all three splits have a row.

    A missing group id counts as no group.
    """
    grid = split_class_grid(rows, labels, spark)
    of_labels = grid.groupBy("split").agg(
        F.count_if(F.col("n") > 0).alias("supported_classes"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("class_label")))), ",").alias("missing_classes")
    )
    of_rows = rows.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))
    return of_labels.join(of_rows, "split", "left").select(
        "split", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("groups", F.lit(0)).alias("groups"), "supported_classes", "missing_classes"
    )
