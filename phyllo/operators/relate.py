"""Relations between items: equal content, similar content and known groups.

The order of items is (source_dataset, relative_path, image_path). Operators
compare that key instead of a dense number, so nothing sorts the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import hamming, missing_to_null
from .graph import components, group_digests

ITEM_FIELDS = ("item_id", "image_path", "relative_path", "source_dataset", "class_label", "official_group", "reviewed_group", "sha256_pixels", "hashes")


def order_key(prefix: str = "") -> Column:
    return F.struct(*(F.coalesce(F.col(prefix + c), F.lit("")) for c in ("source_dataset", "relative_path", "image_path")), F.col(prefix + "item_id"))


def latest_items(items: DataFrame) -> DataFrame:
    """One row per item: the latest import of those delivered more than once.

    Missing texts are null. Rows without an item id are left out; among equal
    import times the largest path counts, so the result does not depend on the
    order of rows.
    """
    texts = ("image_path", "relative_path", "source_dataset", "class_label", "official_group", "reviewed_group", "sha256_pixels")
    rows = items.where("item_id IS NOT NULL").withColumns({c: missing_to_null(c) for c in texts})
    newest = Window.partitionBy("item_id").orderBy(F.desc_nulls_last("imported_at"), F.desc_nulls_last("image_path"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*ITEM_FIELDS)


def readable(items: DataFrame) -> DataFrame:
    return items.where("sha256_pixels IS NOT NULL AND hashes IS NOT NULL")


def ordinals(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Dense position ``ord`` from 0 in the order of the items.

    Ranges are sorted in parallel; each adds the number of rows in the ranges
    before it, a table with one row per range.
    """
    from ..session import Scratch

    keyed = rows.withColumn("_key", order_key()).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_range", F.spark_partition_id())
    placed = Scratch(spark, "ordinals").save(keyed.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(starts.select("_range", "_start"), "_range").withColumn("ord", F.col("_start") + F.col("_at")).drop("_key", "_range", "_at", "_start")


def first_occurrences(items: DataFrame) -> DataFrame:
    """Per content hash the first item in order, as ``first`` beside ``sha256_pixels``."""
    told = F.struct(order_key().alias("key"), "item_id", "image_path", "source_dataset", "class_label", "hashes")
    return readable(items).groupBy("sha256_pixels").agg(F.min(told).alias("first"), F.count("*").alias("n"))


def _pair(first: str, kind: str, distance: Column) -> list[Column]:
    a = {c: F.col(f"{first}.{c}") for c in ("item_id", "image_path", "source_dataset", "class_label")}
    return [
        a["item_id"].alias("item_id_a"), F.col("item_id").alias("item_id_b"), a["image_path"].alias("image_path_a"), F.col("image_path").alias("image_path_b"),
        a["source_dataset"].alias("source_a"), F.col("source_dataset").alias("source_b"), a["class_label"].alias("label_a"), F.col("class_label").alias("label_b"),
        F.lit(kind).alias("match_type"), distance.cast("int").alias("phash_distance"),
    ]


def exact_pairs(items: DataFrame) -> DataFrame:
    """Each later copy with the first item of equal content: a star, not all pairs."""
    firsts = first_occurrences(items).where("n > 1").select("sha256_pixels", F.col("first").alias("f"))
    later = readable(items).join(firsts, "sha256_pixels").where("item_id <> f.item_id")
    return later.select(*_pair("f", "exact_pixels", F.lit(0)))


def _bands(value: Column, radius: int) -> Column:
    """radius + 1 disjoint parts of 64 bits: two values within the radius share at least one whole part."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    parts = []
    for k in range(n):
        width = cuts[k + 1] - cuts[k]
        mask = -1 if width == 64 else (1 << width) - 1
        part = F.shiftrightunsigned(value, cuts[k]).bitwiseAND(F.lit(mask).cast("long"))
        parts.append(F.struct(F.lit(k).alias("band"), part.alias("part")))
    return F.array(*parts)


def near_pairs(items: DataFrame, radius: int = 4) -> DataFrame:
    """Similar items of different content: the later one's orientations against the earlier one's canonical hash.

    Only the first item of each content takes part. The distance of a pair is
    the least over the orientations and is at most ``radius`` (0 to 16). Up to
    a radius of 4 an equi-join on hash parts replaces the comparison of
    everything with everything; beyond, equal parts are short and common, and
    longer parts are looked up with flipped bits. Both carry ids and hashes
    only; what the pairs tell of their items is joined to the pairs found. The
    larger the radius, the shorter the parts: at 16 nearly all pairs are
    compared.
    """
    if not 0 <= radius <= 16:
        raise ValueError("the radius must be between 0 and 16")
    told = F.struct("key", "item_id", "image_path", "source_dataset", "class_label")
    firsts = first_occurrences(items).select("first.*").where("size(hashes) > 0")
    if radius > 4:
        firsts, near = _near_by_lookup(firsts, radius)
        near = near.join(firsts.select(F.col("list").alias("list_a"), told.alias("f")), "list_a").join(firsts.withColumnRenamed("list", "list_b"), "list_b")
        return near.where(F.col("f.key") < F.col("key")).select(*_pair("f", "perceptual_candidate", F.col("d")))
    canon = firsts.select(F.col("item_id").alias("a"), F.explode(_bands(F.element_at("hashes", 1), radius)).alias("p"), F.element_at("hashes", 1).alias("canonical"))
    turned = firsts.select(F.col("item_id").alias("b"), F.explode(F.array_distinct("hashes")).alias("turn"))
    turned = turned.select("b", "turn", F.explode(_bands(F.col("turn"), radius)).alias("p"))
    met = turned.select("b", "turn", "p.*").join(canon.select("a", "canonical", "p.*"), ["band", "part"]).where("a <> b")
    near = met.withColumn("d", hamming("turn", "canonical")).where(F.col("d") <= radius).groupBy("a", "b").agg(F.min("d").alias("d"))
    a = firsts.select(F.col("item_id").alias("a"), told.alias("f"))
    b = firsts.select("key", "item_id", "image_path", "source_dataset", "class_label", F.col("item_id").alias("b"))
    return near.join(a, "a").join(b, "b").where(F.col("f.key") < F.col("key")).select(*_pair("f", "perceptual_candidate", F.col("d")))


def _near_by_lookup(firsts: DataFrame, radius: int, rows: tuple[int, int] = (256_000, 512_000)) -> tuple[DataFrame, DataFrame]:
    """``firsts`` with ``list``, an id of their hash list, and the lists within the radius, in both orders of items.

    Equal lists are compared once. Every chunk of canonical hashes meets every
    chunk of orientations in one task; ``rows`` are the sizes of the chunks and
    change nothing in the result.
    """
    from ..functions.near import close_lists
    from ..session import Scratch

    spark = firsts.sparkSession
    firsts = Scratch(spark, "near").save(firsts.withColumn("list", F.min("item_id").over(Window.partitionBy("hashes"))))
    lists = firsts.where("list = item_id").select(F.col("item_id").alias("id"), "hashes")
    n = lists.count()
    across, down = (max(1, -(-n // size)) for size in rows)
    canon = lists.select("id", F.lit(False).alias("sought"), F.array(F.element_at("hashes", 1)).alias("values"), F.pmod(F.xxhash64("id"), F.lit(across)).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"))
    turned = lists.select("id", F.lit(True).alias("sought"), F.array_distinct("hashes").alias("values"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("column"), F.pmod(F.xxhash64("id"), F.lit(down)).alias("row"))
    sides = canon.unionByName(turned).withColumn("values", F.filter("values", lambda h: h.isNotNull()))
    placed = sides.repartitionById(across * down, (F.col("row") * across + F.col("column")).cast("int")).select("id", "sought", "values")
    kind = firsts.schema["item_id"].dataType
    met = placed.mapInArrow(close_lists(radius, to_arrow_type(kind)), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("d", T.IntegerType())]))
    same = firsts.where("list <> item_id AND element_at(hashes, 1) IS NOT NULL").select("list").distinct().select(F.col("list").alias("list_a"), F.col("list").alias("list_b"), F.lit(0).alias("d"))
    return firsts.drop("hashes"), met.groupBy(F.col("a").alias("list_a"), F.col("b").alias("list_b")).agg(F.min("d").alias("d")).unionByName(same)


def near_links(items: DataFrame, radius: int = 4) -> DataFrame:
    """Edges with the same components as ``near_pairs``, without all pairs of a crowd.

    Contents with equal hash lists (blank pictures, say) are linked as a star;
    only one of them meets other lists. Which of two items is the later one
    decides whose orientations count, so two lists are compared in a direction
    if some item of the one precedes some item of the other.
    """
    if not 0 <= radius <= 16:
        raise ValueError("the radius must be between 0 and 16")
    firsts = first_occurrences(items).select("first.key", "first.item_id", "first.hashes").where("size(hashes) > 0")
    lists = firsts.groupBy("hashes").agg(F.min_by("item_id", "key").alias("rep"), F.min("key").alias("earliest"), F.max("key").alias("last"), F.count("*").alias("n"))
    star = firsts.join(lists.where("n > 1").select("hashes", "rep"), "hashes").where("item_id <> rep").select(F.col("rep").alias("a"), F.col("item_id").alias("b"))
    canon = lists.select(F.col("rep").alias("a"), "earliest", F.element_at("hashes", 1).alias("canonical"))
    canon = canon.withColumn("p", F.explode(_bands(F.col("canonical"), radius))).select("a", "earliest", "canonical", "p.*")
    turned = lists.select(F.col("rep").alias("b"), "last", F.explode(F.array_distinct("hashes")).alias("turn"))
    turned = turned.withColumn("p", F.explode(_bands(F.col("turn"), radius))).select("b", "last", "turn", "p.*")
    met = turned.join(canon, ["band", "part"]).where((F.col("a") != F.col("b")) & (F.col("earliest") < F.col("last")) & (hamming("turn", "canonical") <= radius))
    return star.unionByName(met.select("a", "b").distinct())


def conflicting_content(items: DataFrame) -> DataFrame:
    """Content hashes whose copies have more than one label, with the number of copies and labels."""
    counts = readable(items).groupBy("sha256_pixels").agg(F.count("*").alias("n_images"), F.min("class_label").alias("l0"), F.max("class_label").alias("l1"), F.count_distinct("class_label").alias("n_labels"))
    return counts.where("l0 <> l1").drop("l0", "l1")


def conflict_pairs(exact: DataFrame) -> DataFrame:
    return exact.where("label_a <> label_b")


def review_candidates(near: DataFrame) -> DataFrame:
    """Similar pairs with different labels: both are kept and shown to a reviewer."""
    return near.where("label_a <> label_b")


def excluded_conflicts(items: DataFrame) -> DataFrame:
    """All copies of content with conflicting labels, and why they are left out."""
    reason = F.lit("copies with equal pixels have different labels")
    return readable(items).join(conflicting_content(items).select("sha256_pixels"), "sha256_pixels", "left_semi").withColumn("reason", reason)


def without_conflicts(items: DataFrame) -> DataFrame:
    """Readable items whose content has no conflicting labels."""
    return readable(items).join(conflicting_content(items).select("sha256_pixels"), "sha256_pixels", "left_anti")


def known_group_edges(items: DataFrame) -> DataFrame:
    """Links from the first holder of each official or reviewed group to the others.

    A group holds within its source; a reviewed one that begins with "global:"
    holds across sources. Missing groups never link.
    """
    official = F.struct(F.lit("official_group").alias("field"), F.col("source_dataset").alias("namespace"), F.col("official_group").alias("value"))
    reviewed = F.struct(
        F.lit("reviewed_group").alias("field"),
        F.when(F.col("reviewed_group").startswith("global:"), F.lit("global")).otherwise(F.col("source_dataset")).alias("namespace"),
        F.col("reviewed_group").alias("value"),
    )
    held = readable(items).withColumn("g", F.explode(F.array(official, reviewed))).where("g.value IS NOT NULL").select("item_id", order_key().alias("key"), "g.*")
    keys = ["field", "namespace", "value"]
    firsts = held.groupBy(*keys).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(*keys, F.col("first.item_id").alias("a"))
    return held.join(firsts, keys).where("a <> item_id").select("field", "a", F.col("item_id").alias("b"))


def links(*tables: DataFrame) -> DataFrame:
    """Union of edge tables; pair tables count with their item ids."""
    edges = [t.select(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b")) if "item_id_a" in t.columns else t.select("a", "b") for t in tables]
    return reduce(DataFrame.unionByName, edges).distinct()


def with_components(spark: SparkSession, items: DataFrame, edges: DataFrame) -> DataFrame:
    """``items`` with ``root``: the smallest id linked to the item, its own if there is none.

    Components are found before rows are left out, so removed rows still
    connect the remaining ones.
    """
    found = components(spark, edges)
    return items.join(found.withColumnRenamed("node", "item_id"), "item_id", "left").withColumn("root", F.coalesce("root", "item_id"))


def with_group_ids(items: DataFrame, prefix: str = "group_", name: str = "group_id") -> DataFrame:
    """Name each component after its members' sources and paths."""
    members = items.select("root", F.concat_ws(":", "source_dataset", "relative_path").alias("member"))
    names = group_digests(members, prefix).withColumnRenamed("name", name)
    return items.join(names, "root")


def duplicate_stats(bad: DataFrame, exact: DataFrame, near: DataFrame, items: DataFrame) -> DataFrame:
    """One row with the eight counts of a preparation report."""
    pairs = exact.unionByName(near)
    conflicts = conflicting_content(items)
    counts = pairs.agg(
        F.count_if(F.col("match_type") == "exact_pixels").alias("exact_duplicate_pairs"),
        F.count_if(F.col("match_type") == "perceptual_candidate").alias("perceptual_candidate_pairs"),
        F.count_if((F.col("match_type") == "perceptual_candidate") & (F.col("label_a") != F.col("label_b"))).alias("cross_label_perceptual_candidates"),
        F.count_if(F.col("source_a") != F.col("source_b")).alias("cross_dataset_duplicate_pairs"),
        F.count_if((F.col("match_type") == "exact_pixels") & (F.col("label_a") != F.col("label_b"))).alias("exact_cross_label_conflict_pairs"),
    )
    left_out = conflicts.agg(F.coalesce(F.sum("n_images"), F.lit(0)).alias("excluded_conflicting_images"), F.count("*").alias("excluded_conflicting_pixel_hashes"))
    unreadable = bad.agg(F.count("*").alias("unreadable_images"))
    # Three tables of one row each.
    return unreadable.withColumn("_1", F.lit(1)).join(counts.withColumn("_1", F.lit(1)), "_1").join(left_out.withColumn("_1", F.lit(1)), "_1").drop("_1")
