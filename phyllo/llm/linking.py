"""Consolidating pairwise matches into groups.

Minimum labels travel along the edges and pointer jumping shortens the label
chains. After each round the edges are rewritten to the labels of their ends,
edges inside one label disappear and repeated edges fall together, so later
rounds work on a shrinking graph. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing_to_null, spelled
from ..session import Scratch


def _jump(scratch: Scratch, labels: DataFrame) -> DataFrame:
    """Replace each label by its label's label until none changes.

    A label is always a node of the same table, so the lookup never misses.
    Each pass doubles the length of the chains that it folds.
    """
    while True:
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        folded = scratch.save(
            labels.join(at, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
        )
        moved = folded.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = folded.drop("moved")
        labels._phyllo_path = folded._phyllo_path
        if not moved:
            return labels


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Smallest node linked to each node, directly or indirectly.

    edges: columns ``a`` and ``b`` (long); direction, repetition and order are
    free, self-links and rows with a null end link nothing. Returns ``node``
    and ``root`` for every node that has a link to another one; an empty edge
    table gives an empty result. A hub of any size is one key of a map-side
    combined minimum, never a collected list.
    """
    scratch = scratch or Scratch(spark, "components")
    live = scratch.save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    rounds: list[DataFrame] = []
    while live.limit(1).count():
        ends = live.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
            live.select(F.col("a").alias("node"), F.col("a").alias("label"))
        )
        labels = scratch.save(ends.groupBy("node").agg(F.min("label").alias("label")))
        labels = _jump(scratch, labels)
        rounds.append(labels)
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        following = scratch.save(
            live.join(at_a, "a")
            .join(at_b, "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
        )
        scratch.drop(live)
        live = following
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    # The last round is final; each earlier one looks its labels up in the next.
    out = rounds[-1].select("node", F.col("label").alias("root"))
    for labels in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("label"), "root")
        out = labels.join(later, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    return out


def resolve_ends(pairs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Links between records: ``a`` and ``b`` are item ids that exist.

    An end is its id or, where that is null, its path; the path must name a
    record exactly or, failing that, in another spelling (case, padding; the
    smallest such id counts). Pairs with an end that is no record are dropped.
    Columns other than the six that are read may be present under any name.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "ends")
    p = pairs.select(
        F.col("item_id_a").alias("a"),
        F.col("item_id_b").alias("b"),
        F.when(F.col("item_id_a").isNull(), missing_to_null("image_path_a")).alias("path_a"),
        F.when(F.col("item_id_b").isNull(), missing_to_null("image_path_b")).alias("path_b"),
    ).where("(a IS NOT NULL OR path_a IS NOT NULL) AND (b IS NOT NULL OR path_b IS NOT NULL)")
    whole = p.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    # Only ends without an id meet the paths; the others would all share the null key.
    partial = p.where("a IS NULL OR b IS NULL").distinct()
    known = items.select("item_id", missing_to_null("image_path").alias("path")).where("item_id IS NOT NULL")
    said = partial.select(F.explode(F.array("path_a", "path_b")).alias("said")).where("said IS NOT NULL").distinct()
    # Both ends read this table and the ids below, so they are written once instead of read from the items again.
    found = scratch.save(
        said.withColumn("key", spelled("said"))
        .join(known.where("path IS NOT NULL").withColumn("key", spelled("path")), "key")
        .groupBy("said")
        .agg(F.min(F.struct((F.col("path") != F.col("said")).alias("other"), "item_id"))["item_id"].alias("found"))
    )
    for end in "ab":
        named = partial.where(f"{end} IS NULL").drop(end).join(found.select(F.col("said").alias(f"path_{end}"), F.col("found").alias(end)), f"path_{end}")
        partial = partial.where(f"{end} IS NOT NULL").unionByName(named)
    out = whole.unionByName(partial.select("a", "b")).where("a <> b")
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = scratch.save(known.select("item_id").distinct())
    for end in "ab":
        out = out.join(ids.select(F.col("item_id").alias(end)), end, "left_semi")
    return out


def linked_groups(spark: SparkSession, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Group of each linked item: ``item_id`` and ``group_item_id``, the smallest id of its group."""
    scratch = Scratch(spark, "linking")
    out = components(spark, resolve_ends(pairs, items, scratch), scratch)
    return out.select(F.col("node").alias("item_id"), F.col("root").alias("group_item_id"))
