"""Splits that keep related records together.

Hash-to-min: every node keeps a cluster of known relatives; each round it sends
the cluster to its smallest member and the smallest member to everyone in the
cluster, until nothing changes. Weighted rendezvous hashing then gives each
component a split by its name and by what each split still lacks in its source,
in rounds from large to small components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing_to_null, spelled, split_word
from ..session import Scratch

SPLITS = ("train", "val", "test")
SHARES = (0.8, 0.1, 0.1)


def hash_to_min(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Smallest relative of each node: ``node`` and ``root``.

    edges: ``a`` and ``b`` of one ordered type; self-links and nulls link
    nothing. Clusters are rows (``v`` knows ``u``), so a cluster of any size
    is spread over tasks and only its minimum is aggregated.
    """
    scratch = scratch or Scratch(spark, "hash-to-min")
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    pairs = F.array(*(F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x in "ab" for y in "ab"))
    knows = scratch.save(e.select(F.explode(pairs).alias("p")).select("p.v", "p.u").distinct())
    size = knows.count()
    while size:
        least = knows.groupBy("v").agg(F.min("u").alias("m"))
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        told = scratch.save(knows.join(least, "v").select(F.explode(sent).alias("p")).select("p.v", "p.u").distinct())
        following = told.count()
        stable = following == size and not told.join(knows, ["v", "u"], "left_anti").limit(1).count()
        scratch.drop(knows)
        knows, size = told, following
        if stable:
            break
    return knows.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def entities(manifest: DataFrame) -> DataFrame:
    """What each row must stay together with, as ``entity``, beside its item, split and source.

    The entity is the group in one spelling; a row without a group stands for
    its item, one without an item for its path; rows without all three are left out.
    """
    group = spelled("group_id")
    return manifest.select(
        group.alias("group_id"),
        F.coalesce(
            F.concat(F.lit("group:"), group),
            F.concat(F.lit("item:"), F.col("item_id").cast("string")),
            F.concat(F.lit("path:"), missing_to_null("image_path")),
        ).alias("entity"),
        F.coalesce(F.col("item_id").cast("string"), missing_to_null("image_path")).alias("item"),
        split_word("split").alias("split"),
        spelled("source_dataset").alias("source_dataset"),
    ).where("entity IS NOT NULL")


def split_components(spark: SparkSession, manifest: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per entity and source: component, rows and the splits that its rows name.

    Entities that share an item belong to one component, since the item's rows
    must not be parted either.
    """
    scratch = scratch or Scratch(spark, "splits")
    rows = entities(manifest)
    bit = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(SPLITS) for x in (s, 1 << k))), F.col("split"))
    per = scratch.save(rows.groupBy("item", "entity", "group_id", "source_dataset").agg(F.count("*").alias("n"), F.coalesce(F.bit_or(bit), F.lit(0)).alias("splits")))
    shared = per.where("item IS NOT NULL").groupBy("item").agg(F.min("entity").alias("a"), F.max("entity").alias("last")).where("a <> last")
    edges = per.join(shared, "item").where("entity <> a").select("a", F.col("entity").alias("b")).distinct()
    roots = hash_to_min(spark, edges, scratch)
    sums = per.groupBy("entity", "group_id", "source_dataset").agg(F.sum("n").alias("n"), F.bit_or("splits").alias("splits"))
    return sums.join(roots.withColumnRenamed("node", "entity"), "entity", "left").withColumn("component", F.coalesce("root", "entity")).drop("root")


def broken_groups(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Groups whose own rows name more than one split: ``group_id`` in one spelling and its ``component``.

    Rows without a known split or without a group count for nothing. A group
    lies in one component, so the components cannot change which groups these
    are; they tell which broken groups must be mended together.
    """
    members = split_components(spark, manifest).where("group_id IS NOT NULL")
    by_group = members.groupBy("component", "group_id").agg(F.bit_or("splits").alias("splits"))
    return by_group.where(F.bit_count("splits") > 1).select("group_id", "component")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


HALVES = 7


def rounds(n: Column, *name: Column) -> Column:
    """Round of a component, rising: the larger the rows the earlier, by powers of two; components of
    less than four rows in rounds that are halved each time, by a hash of their names."""
    size = F.greatest(F.floor(F.log2(n.cast("double"))), F.lit(1)).cast("int")
    half = F.least(F.floor(-F.log2(_uniform(*name, F.lit("round")))), F.lit(HALVES - 1)).cast("int")
    return F.when(size > 1, -size).otherwise(half).cast("int")


def assign(spark: SparkSession, manifest: DataFrame, shares: tuple = SHARES) -> DataFrame:
    """A new split per component: ``component``, ``entity``, ``group_id``, ``source_dataset``, ``n`` and ``new_split``.

    Every component, whatever its size, draws by weighted rendezvous hashing:
    the weight of a split is what it still lacks in the component's main source
    (the one with most of its rows), or nothing if the component does not fit
    there any more; where it fits nowhere, the split that lacks most gets it.
    The draws of a round are made at once, from what the rounds before left, so
    there is one Spark job for each power of two between the sizes, and a few
    for the small ones. What is lacking is a table with one row a source.
    """
    scratch = Scratch(spark, "assign")
    members = scratch.save(split_components(spark, manifest, scratch))
    source = F.coalesce("source_dataset", F.lit(""))
    per_source = scratch.save(members.groupBy("component", source.alias("source")).agg(F.sum("n").alias("n")))
    comps = per_source.groupBy("component").agg(F.max_by("source", F.struct("n", "source")).alias("main"), F.sum("n").alias("size"))
    comps = scratch.save(comps.withColumn("round", rounds(F.col("size"), F.col("component"))))
    lacks = scratch.save(per_source.groupBy("source").agg(*((F.sum("n") * s).alias(f"l{k}") for k, s in enumerate(shares))))
    placed = []
    for row in comps.select("round").distinct().orderBy("round").collect():  # at most 64 + HALVES rows
        now = comps.where(F.col("round") == row["round"]).join(lacks.withColumnRenamed("source", "main"), "main")
        fits = [F.when((F.col(f"l{k}") >= F.col("size")) & (F.col(f"l{k}") > 0), F.col(f"l{k}")) for k in range(len(SPLITS))]
        scores = F.array(*(F.struct((-F.ln(_uniform(F.col("component"), F.lit(s))) / fits[k]).alias("score"), F.lit(s).alias("split")) for k, s in enumerate(SPLITS)))
        drawn = F.array_min(F.filter(scores, lambda x: x["score"].isNotNull()))["split"]
        most = F.array_max(F.array(*(F.struct(F.col(f"l{k}").alias("l"), F.lit(-k).alias("k"), F.lit(s).alias("split")) for k, s in enumerate(SPLITS))))["split"]
        placed.append(scratch.save(now.select("component", F.coalesce(drawn, most).alias("new_split"))))
        taken = placed[-1].join(per_source, "component").groupBy("source").agg(*(F.sum(F.when(F.col("new_split") == s, F.col("n")).otherwise(0)).alias(f"t{k}") for k, s in enumerate(SPLITS)))
        lacks = scratch.save(lacks.join(taken, "source", "left").select("source", *((F.col(f"l{k}") - F.coalesce(f"t{k}", F.lit(0))).alias(f"l{k}") for k in range(len(SPLITS)))))
    if not placed:
        return members.withColumn("new_split", F.lit(None).cast("string")).select("component", "entity", "group_id", "source_dataset", "n", "new_split")
    drawn = placed[0]
    for more in placed[1:]:
        drawn = drawn.unionByName(more)
    return members.join(drawn, "component").select("component", "entity", "group_id", "source_dataset", "n", "new_split")


def balance(assigned: DataFrame) -> DataFrame:
    """Rows and share of each split, overall (source null) and within each source."""
    counts = assigned.groupBy("source_dataset", "new_split").agg(F.sum("n").alias("n_rows"))
    counts = counts.unionByName(assigned.groupBy("new_split").agg(F.sum("n").alias("n_rows")).withColumn("source_dataset", F.lit("(all)")))
    totals = counts.groupBy("source_dataset").agg(F.sum("n_rows").alias("total"))
    joined = counts.join(totals.withColumnRenamed("source_dataset", "s"), F.col("source_dataset").eqNullSafe(F.col("s")))
    return joined.select("source_dataset", "new_split", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"))
