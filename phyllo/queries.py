"""Queries over the curation and evaluation operators. ``oracles`` holds their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import checks, curate, metrics, relate, split
from .oracles import oracle_sql  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.latest_items(table(spark, sf_dir, "items"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "class_labels")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each item, in canonical spelling."""
    rows = table(spark, sf_dir, "manifest").where("item_id IS NOT NULL")
    told = F.struct(
        X.split_word("split").alias("split"), X.spelled("group_id").alias("group_id"), "image_path", "source_dataset", "tree_type", "condition", "class_label", "relative_path"
    )
    return rows.groupBy("item_id").agg(F.max(F.struct("written_at", told.alias("r")))["r"].alias("r")).select("item_id", "r.*")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the manifest, with split words and groups in canonical spelling."""
    return table(spark, sf_dir, "manifest").withColumns({"split": X.split_word("split"), "group_id": X.spelled("group_id")})


# Scans, projections and scalar functions


@query
def image_files(spark, sf_dir):
    """Rows whose path has a picture suffix and no hidden part."""
    from .sources.images import is_image_path

    return table(spark, sf_dir, "items").where(is_image_path("relative_path")).select("item_id", "relative_path").distinct()


@query
def name_parts(spark, sf_dir):
    """Photo id, normalised folder, base name, stem, suffix, parent of each path."""
    p = F.col("image_path")
    return table(spark, sf_dir, "items").where("image_path IS NOT NULL").select(
        "item_id", X.photo_id(p).alias("photo_id"), X.base_name(p).alias("base_name"), X.stem(p).alias("stem"), F.lower(X.suffix(p)).alias("suffix"),
        X.parent_name(p).alias("parent"), X.normalize_name(X.parent_name(p)).alias("folder_key"), X.copy_markers(p).cast("long").alias("markers"),
    ).distinct()


@query
def capture_details(spark, sf_dir):
    """What each reading says."""
    read = curate.capture_details(table(spark, sf_dir, "mango_captures"))
    return read.select("item_id", "read_at", "capture_time", "capture_id", "camera", "area", "edited").distinct()


@query
def one_hot_decode(spark, sf_dir):
    """Decode a one-hot label row; here built from the labels of one source."""
    names = ["healthy", "multiple_diseases", "rust", "scab"]
    spelled = F.when(F.col("condition") == "cedar_apple_rust", "rust").otherwise(F.col("condition"))
    hot = F.array(*(F.when(spelled == n, 1).otherwise(0) for n in names))
    rows = table(spark, sf_dir, "items").where("source_dataset = 'cornell' AND tree_type = 'apple'").select("item_id", hot.alias("hot")).distinct()
    decoded = F.when(F.aggregate("hot", F.lit(0), lambda a, x: a + x) == 1, F.element_at(F.array(*map(F.lit, names)), F.array_position("hot", 1).cast("int")))
    return rows.select("item_id", decoded.alias("condition"))


@query
def display_names(spark, sf_dir):
    """Labels as a person reads them."""
    return _labels(spark, sf_dir).select("class_label", X.display_name("class_label").alias("shown"))


@query
def hamming_distances(spark, sf_dir):
    """P20: distance of each orientation from the canonical hash."""
    h = table(spark, sf_dir, "items").where("hashes IS NOT NULL").select("item_id", "hashes").distinct()
    turns = h.select("item_id", F.element_at("hashes", 1).alias("canonical"), F.posexplode("hashes").alias("turn", "h"))
    return turns.select("item_id", "canonical", "turn", X.hamming("canonical", "h").alias("distance"))


@query
def split_rows(spark, sf_dir):
    """Rows of the training split in any spelling."""
    return table(spark, sf_dir, "manifest").where(X.split_word("split") == "train").select("item_id", "class_label").distinct()


@query
def softmax_argmax(spark, sf_dir):
    """Softmax over the vector of scores, and its greatest entry."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    e = e.withColumn("top", F.array_max("z"))
    e = e.withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return e.select("vec_id", (F.array_position("z", F.col("top")) - 1).alias("prediction"), F.round(F.lit(1.0) / F.col("total"), 9).alias("confidence"))


# Joins


@query
def label_join(spark, sf_dir):
    """Every item with the parts of its label."""
    from .labels import with_label

    return with_label(_items(spark, sf_dir).select("item_id", "class_label"), _labels(spark, sf_dir))


@query
def label_of_folder(spark, sf_dir):
    """Label of each item from the folders of its path, and whether it is the one given."""
    mapping = table(spark, sf_dir, "label_map").select("source_dataset", X.normalize_name("source_label").alias("key"), F.col("class_label").alias("found"))
    parts = _items(spark, sf_dir).select("item_id", "source_dataset", "class_label", F.explode(F.split("relative_path", "/")).alias("part"))
    found = parts.withColumn("key", X.normalize_name("part")).join(mapping, ["source_dataset", "key"])
    return found.groupBy("item_id").agg(F.min("found").alias("found_label"), F.count_distinct("found").alias("n_labels"), F.min(F.col("found") == F.col("class_label")).alias("agrees"))


@query
def leaf_group_lookup(spark, sf_dir):
    """Official group of each item from a leaf map; the map is made of the groups that the items name."""
    from .sources.importers import leaf_groups

    items = _items(spark, sf_dir).where("source_dataset = 'plantvillage'").select("item_id", "image_path", "relative_path", "official_group")
    leaf_map = items.where("official_group IS NOT NULL").groupBy(X.photo_id("image_path").alias("photo_id")).agg(F.array_sort(F.collect_set("official_group")).alias("groups"))
    return leaf_groups(items.select("item_id", "image_path", F.element_at(F.split("relative_path", "/"), 1).alias("folder")), leaf_map).select("item_id", "found_group")


@query
def reviewed_group_join(spark, sf_dir):
    """Reviewed groups matched by any of an item's names; here the manifest's rows are the review."""
    from .sources.importers import match_reviewed

    review = table(spark, sf_dir, "manifest").where("trim(reviewed_group) <> ''").select("source_dataset", F.col("relative_path").alias("image_path"), F.col("reviewed_group").alias("group_id")).distinct()
    items = _items(spark, sf_dir).select("item_id", "image_path", "relative_path", "source_dataset")
    return match_reviewed(items, review).groupBy("problem").agg(F.count("*").alias("n_records"), F.count_distinct("item_id").alias("n_items"))


@query
def exact_pairs(spark, sf_dir):
    """J4."""
    return relate.exact_pairs(_items(spark, sf_dir))


@query
def near_pairs(spark, sf_dir):
    """J5 at the default radius of 4."""
    return relate.near_pairs(_items(spark, sf_dir), 4)


@query
def near_pairs_radius_8(spark, sf_dir):
    """J5 at a radius of 8."""
    return relate.near_pairs(_items(spark, sf_dir), 8).select("item_id_a", "item_id_b", "phash_distance")


@query
def known_group_edges(spark, sf_dir):
    """J6."""
    return relate.known_group_edges(_items(spark, sf_dir))


@query
def capture_edges(spark, sf_dir):
    """J7."""
    details = curate.capture_details(curate.latest_captures(table(spark, sf_dir, "mango_captures")))
    items = relate.readable(_items(spark, sf_dir)).where(F.col("source_dataset") == curate.CURATED_SOURCE)
    return curate.capture_edges(items, details)


@query
def missing_members(spark, sf_dir):
    """Paths named by the older run's pairs that are no item's."""
    named = table(spark, sf_dir, "match_pairs").select(F.explode(F.array("image_path_a", "image_path_b")).alias("image_path"))
    return checks.missing_members(named.where("trim(image_path) <> ''").distinct(), table(spark, sf_dir, "items"))


@query
def conflict_exclusion(spark, sf_dir):
    """Readable items whose content has no conflicting labels."""
    return relate.without_conflicts(_items(spark, sf_dir)).select("item_id", "class_label")


@query
def excluded_conflicts(spark, sf_dir):
    """K3: the items that J9 leaves out."""
    return relate.excluded_conflicts(_items(spark, sf_dir)).select("item_id", "image_path", "source_dataset", "class_label", "sha256_pixels")


@query
def split_class_grid(spark, sf_dir):
    """Images of every label in every split."""
    return split.split_class_grid(_manifest(spark, sf_dir), _labels(spark, sf_dir), spark)


# Graph and identity


def related(spark: SparkSession, sf_dir: str, radius: int = 4) -> DataFrame:
    """Readable items with the component that equal and similar content and known groups make."""
    from .session import Scratch

    items = Scratch(spark, "items").save(_items(spark, sf_dir))
    edges = relate.links(relate.exact_pairs(items), relate.near_links(items, radius), relate.known_group_edges(items))
    return relate.with_components(spark, relate.readable(items), edges)


@query
def component_roots(spark, sf_dir):
    """The component of each readable item."""
    return related(spark, sf_dir).select("item_id", "root")


@query
def related_groups(spark, sf_dir):
    """Group name of each item that stays after label conflicts are left out; removed items still link the others."""
    kept = relate.without_conflicts(related(spark, sf_dir))
    return relate.with_group_ids(kept).select("item_id", "group_id")


@query
def component_sizes(spark, sf_dir):
    """How many components have how many items and labels."""
    sizes = related(spark, sf_dir).groupBy("root").agg(F.count("*").alias("n_items"), F.count_distinct("class_label").alias("n_labels"))
    return sizes.groupBy("n_items", "n_labels").agg(F.count("*").alias("n_components"))


# Aggregations


@query
def counts_by_source(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("source_dataset").agg(F.count("*").alias("n"))


@query
def counts_by_class(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("class_label").agg(F.count("*").alias("n"))


@query
def counts_by_split(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query
def groups_by_split(spark, sf_dir):
    """A2, with the total as split "(all)"."""
    rows = _manifest(spark, sf_dir)
    by = rows.groupBy("split").agg(F.count_distinct("group_id").alias("n_groups"))
    return by.unionByName(rows.agg(F.count_distinct("group_id").alias("n_groups")).select(F.lit("(all)").alias("split"), "n_groups"))


@query
def missing_classes(spark, sf_dir):
    """A3, V10, on every row of the manifest."""
    return checks.missing_classes(_written(spark, sf_dir), _labels(spark, sf_dir))


@query
def duplicate_stats(spark, sf_dir):
    """A4."""
    items = _items(spark, sf_dir)
    return relate.duplicate_stats(table(spark, sf_dir, "bad_images").select("item_id").distinct(), relate.exact_pairs(items), relate.near_pairs(items), items)


@query
def conflicting_content(spark, sf_dir):
    """A5."""
    return relate.conflicting_content(_items(spark, sf_dir))


@query
def conflict_pairs(spark, sf_dir):
    """A6."""
    return relate.conflict_pairs(relate.exact_pairs(_items(spark, sf_dir))).select("item_id_a", "item_id_b", "label_a", "label_b")


@query
def review_candidates(spark, sf_dir):
    """A7."""
    return relate.review_candidates(relate.near_pairs(_items(spark, sf_dir))).select("item_id_a", "item_id_b", "label_a", "label_b", "phash_distance")


def _curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .session import Scratch

    scratch = Scratch(spark, "curation")
    items = scratch.save(_items(spark, sf_dir))
    details = scratch.save(curate.capture_details(curate.latest_captures(table(spark, sf_dir, "mango_captures"))))
    mine = relate.readable(items).where(F.col("source_dataset") == curate.CURATED_SOURCE)
    edges = relate.links(relate.exact_pairs(items), relate.near_links(items), relate.known_group_edges(items), curate.capture_edges(mine, details))
    return curate.curate(spark, relate.without_conflicts(relate.with_components(spark, relate.readable(items), edges)), details)


@query
def curation_audit(spark, sf_dir):
    """Decision on each item of the curated source."""
    return _curated(spark, sf_dir)[1].drop("sha256_pixels")


@query
def curation_by_class(spark, sf_dir):
    """A8."""
    return curate.curation_by_class(_curated(spark, sf_dir)[1])


@query
def curation_summary(spark, sf_dir):
    """A9."""
    return curate.curation_summary(_curated(spark, sf_dir)[1])


@query
def representatives(spark, sf_dir):
    """T2 on an older run's families: best record of each family and label."""
    families = table(spark, sf_dir, "mango_curation").select("item_id", "image_path", "relative_path", "class_label", X.spelled("family_id").alias("root")).where("root IS NOT NULL").distinct()
    details = curate.capture_details(curate.latest_captures(table(spark, sf_dir, "mango_captures")))
    ranked = families.join(details.select("item_id", "edited", "area"), "item_id", "left")
    return curate.representatives(ranked).select("root", "class_label", F.col("best.item_id").alias("item_id"), "members")


@query
def reviewed_flag(spark, sf_dir):
    """A10: whether all items of a source are reviewed."""
    return _items(spark, sf_dir).groupBy("source_dataset").agg(F.coalesce(F.bool_and(F.col("reviewed_group").isNotNull()), F.lit(False)).alias("all_reviewed"))


@query
def receipt_totals(spark, sf_dir):
    """Files and bytes per category and mode of a picture archive; here pixels stand for bytes."""
    rows = curate.latest_captures(table(spark, sf_dir, "mango_captures")).join(_items(spark, sf_dir).select("item_id", "class_label"), "item_id")
    mode = F.when(F.col("width") > F.col("height"), "wide").when(F.col("width") < F.col("height"), "tall")
    return rows.groupBy("class_label", mode.alias("mode")).agg(F.count("*").alias("n_files"), F.sum(F.col("width").cast("long") * F.col("height")).alias("total"))


@query
def file_receipts(spark, sf_dir):
    """H6, K6: digest and size of each file; the texts of documents stand for the files."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query
def imports_over_time(spark, sf_dir):
    """Imports per source and hour, as the stream counts them (an addition)."""
    items = table(spark, sf_dir, "items").where("imported_at IS NOT NULL")
    unreadable = F.count_if(X.missing_to_null("sha256_pixels").isNull())
    hours = items.groupBy(F.window(F.col("imported_at").cast("timestamp"), "1 hour").alias("w"), "source_dataset").agg(F.count("*").alias("n"), unreadable.alias("n_unreadable"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "source_dataset", "n", "n_unreadable")


@query
def data_summary(spark, sf_dir):
    """A11."""
    return split.data_summary(_manifest(spark, sf_dir).where("split IS NOT NULL"), _labels(spark, sf_dir), spark)


# Splits


@query
def component_histogram(spark, sf_dir):
    """G1 on the groups of the manifest; a row without a group is one by itself."""
    return split.component_histogram(_grouped(spark, sf_dir))


@query
def split_targets(spark, sf_dir):
    """G2."""
    return split.split_targets(_manifest(spark, sf_dir)).withColumn("target", F.round("target", 6))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("item_id", "image_path", "relative_path", "source_dataset", "class_label", F.coalesce("group_id", F.concat(F.lit("item:"), F.col("item_id"))).alias("root"))


@query
def grouped_split(spark, sf_dir):
    """A new split of the manifest's groups, by the sequential choice."""
    return split.grouped_split(_grouped(spark, sf_dir), exact=True)


@query
def split_by_rounds(spark, sf_dir):
    """G3 by all tasks, in rounds."""
    return split.grouped_split(_grouped(spark, sf_dir))


@query
def split_distribution(spark, sf_dir):
    """G4 of the sequential split."""
    rows = _grouped(spark, sf_dir)
    return split.split_distribution(rows.join(split.grouped_split(rows, exact=True), "root"))


@query
def split_properties(spark, sf_dir):
    """What must hold for both ways of splitting: no group is parted or left out, and every label
    with three groups has images in all splits."""
    rows = _grouped(spark, sf_dir)
    out = []
    for way, exact in (("sequential", True), ("rounds", False)):
        done = split.grouped_split(rows, exact=exact)
        joined = rows.join(done, "root", "left")
        parted = joined.groupBy("root").agg(F.count_distinct("split").alias("k")).where("k <> 1").agg(F.count("*").alias("n"))
        short = joined.groupBy("class_label").agg(F.count_distinct("root").alias("groups"), F.count_distinct("split").alias("k")).where("groups >= 3 AND k < 3").agg(F.count("*").alias("n"))
        out += [df.select(F.lit(way).alias("way"), F.lit(name).alias("property"), "n") for name, df in (("groups parted or left out", parted), ("labels without all splits", short))]
        off = [(F.abs(F.avg((F.col("split") == s).cast("int")) - share) > 0.02).cast("long") for s, share in zip(split.SPLITS, split.FRACTIONS)]
        out.append(joined.agg(sum(off[1:], off[0]).alias("n")).select(F.lit(way).alias("way"), F.lit("splits off their share").alias("property"), "n"))
    return reduce(DataFrame.unionByName, out)


@query
def hash_split(spark, sf_dir):
    """G5, an addition."""
    return split.hash_split(_grouped(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))


# Evaluation: the latest import is the truth; the label at the other end of an item's first match stands for a prediction


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _labels(spark, sf_dir).select("class_label", "label_index")
    truth = _items(spark, sf_dir).select("item_id", "source_dataset", "class_label").join(at.withColumnRenamed("label_index", "target"), "class_label").drop("class_label")
    said = table(spark, sf_dir, "match_pairs").where("item_id_a IS NOT NULL").groupBy(F.col("item_id_a").alias("item_id")).agg(F.min_by("label_b", "pair_id").alias("class_label"))
    return truth.join(said.join(at.withColumnRenamed("label_index", "prediction"), "class_label").drop("class_label"), "item_id")


def _per_class(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    matrix = metrics.confusion(_predictions(spark, sf_dir), *keys)
    return metrics.per_class_metrics(metrics.class_marginals(matrix, _labels(spark, sf_dir), *keys))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


@query
def confusion(spark, sf_dir):
    """M1."""
    return metrics.confusion(_predictions(spark, sf_dir))


@query
def confusion_by_source(spark, sf_dir):
    """M2."""
    return metrics.confusion(_predictions(spark, sf_dir), "source_dataset")


@query
def class_marginals(spark, sf_dir):
    """M3."""
    return metrics.class_marginals(metrics.confusion(_predictions(spark, sf_dir)), _labels(spark, sf_dir))


@query
def per_class_metrics(spark, sf_dir):
    """M4."""
    return _rounded(_per_class(spark, sf_dir))


@query
def summary_metrics(spark, sf_dir):
    """M5."""
    return _rounded(metrics.summary_metrics(_per_class(spark, sf_dir)))


@query
def metrics_by_source(spark, sf_dir):
    """M6."""
    return _rounded(metrics.summary_metrics(_per_class(spark, sf_dir, "source_dataset"), "source_dataset"))


@query
def weighted_loss(spark, sf_dir):
    """M7: mean distance of the pairs, weighted by the size of the batch (a month of one match type)."""
    month = F.date_format("found_at", "yyyy-MM")
    batches = table(spark, sf_dir, "match_pairs").groupBy("match_type", month.alias("month")).agg(F.avg("phash_distance").alias("loss"), F.count("phash_distance").alias("n"))
    return _rounded(metrics.weighted_loss(batches, "match_type"))


@query
def top_errors(spark, sf_dir):
    """T4."""
    return metrics.top_errors(metrics.confusion(_predictions(spark, sf_dir)))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of agreeing labels per month of the older run's matches, as a training history."""
    pairs = table(spark, sf_dir, "match_pairs").where("found_at IS NOT NULL")
    month = F.year("found_at") * 12 + F.month("found_at") - 2022 * 12
    return pairs.groupBy(month.alias("epoch")).agg(F.round(F.avg((F.col("label_a") == F.col("label_b")).cast("double")), 2).alias("macro_f1"))


@query
def best_epoch(spark, sf_dir):
    """T3."""
    return metrics.best_epoch(_history(spark, sf_dir))


@query
def history_epochs(spark, sf_dir):
    """Epochs of the history that do not count from 1 without gaps."""
    return checks.bad_epochs(_history(spark, sf_dir))


@query
def matrix_violations(spark, sf_dir):
    """Cells of the confusion matrix that are negative or outside the labels."""
    return checks.bad_matrix(metrics.confusion(_predictions(spark, sf_dir)), _labels(spark, sf_dir))


@query
def totals_disagree(spark, sf_dir):
    """Totals of the matrix, of the manifest's items and of the labels' supports, if they differ."""
    matrix = metrics.confusion(_predictions(spark, sf_dir))
    return checks.totals_disagree(matrix=matrix.agg(F.sum("n").alias("n")), manifest=_manifest(spark, sf_dir).agg(F.count("*").alias("n")), support=_per_class(spark, sf_dir).agg(F.sum("support").alias("n")))


@query
def checkpoint_disagrees(spark, sf_dir):
    """The last epoch of the history as the selected checkpoint, if it is not the best."""
    history = _history(spark, sf_dir)
    last = history.agg(F.max_by("macro_f1", "epoch").alias("macro_f1"), F.max("epoch").alias("epoch"))
    return checks.checkpoint_disagrees(history, last)


@query
def label_dimension(spark, sf_dir):
    """The labels, made from the conditions of each tree."""
    from . import labels

    return labels.labels(spark)


@query
def observed_labels(spark, sf_dir):
    """Labels with test rows in the manifest, numbered again."""
    from . import labels

    return labels.reindex(_labels(spark, sf_dir), _written(spark, sf_dir).where("split = 'test'"))


# Files


@query
def label_file(spark, sf_dir):
    """The labels, written as a file and read with all checks."""
    from .session import Scratch
    from .sources import tables

    path = f"{Scratch(spark, 'label-file').root}/labels.json"
    tables.write_json(spark, path, tables.label_json(_labels(spark, sf_dir)))
    return tables.read_labels(spark, path)


@query
def manifest_file(spark, sf_dir):
    """Items as a manifest, each its own group, written as CSV and read with all checks."""
    from . import schemas
    from .labels import with_label
    from .session import Scratch
    from .sources import tables

    rows = with_label(_items(spark, sf_dir).where("image_path IS NOT NULL AND source_dataset IS NOT NULL"), _labels(spark, sf_dir))
    rows = rows.withColumns({"group_id": F.concat(F.lit("item:"), F.col("item_id")), "split": F.lit("train")}).fillna("")
    path = f"{Scratch(spark, 'manifest-file').root}/manifest"
    tables.write_csv(rows, path, schemas.MANIFEST_FIELDS, ("source_dataset", "relative_path"))
    read = tables.read_manifest(spark, path, _labels(spark, sf_dir))
    return read.select("image_path", "source_dataset", "class_label", "group_id", "official_group", "target")


# Order and limits


@query
def ordered_rows(spark, sf_dir):
    """Dense position of each item in the order of the items."""
    return relate.ordinals(_items(spark, sf_dir), spark).select("item_id", "ord")


@query
def limit_per_class(spark, sf_dir):
    """The first three items of each label by path."""
    from .sources.importers import limit_per_category

    return limit_per_category(_items(spark, sf_dir), "class_label", "relative_path", 3, "item_id").select("item_id", "class_label")


# Set operations


@query
def path_union(spark, sf_dir):
    """Distinct union of two path lists (2.12)."""
    a, b = (table(spark, sf_dir, t).select("image_path") for t in ("bad_images", "mango_captures"))
    return a.union(b).where("image_path IS NOT NULL").distinct()


@query
def path_difference(spark, sf_dir):
    """Set difference of two id lists (2.12)."""
    return table(spark, sf_dir, "items").select("item_id").subtract(table(spark, sf_dir, "manifest").select("item_id"))


@query
def set_differences(spark, sf_dir):
    """Equality of two sets of ids (2.12): what each side lacks."""
    items, manifest = (table(spark, sf_dir, t).where("item_id IS NOT NULL") for t in ("items", "manifest"))
    return checks.set_differences(items, manifest, "item_id").groupBy("only_in").agg(F.count("*").alias("n"))


# Constraints


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as written, repeated rows once."""
    return table(spark, sf_dir, "manifest").drop("written_at").distinct()


@query
def unknown_splits(spark, sf_dir):
    """V1: split words as written."""
    return checks.unknown_splits(_told(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))


@query
def unknown_labels(spark, sf_dir):
    """V2, on every row of the manifest against all labels."""
    return checks.unknown_labels(_written(spark, sf_dir), _labels(spark, sf_dir)).groupBy("class_label").agg(F.count("*").alias("n"))


@query
def label_parts_disagree(spark, sf_dir):
    """V3, on every row of the manifest."""
    rows = table(spark, sf_dir, "manifest").select("item_id", "class_label", "tree_type", "condition")
    return checks.label_parts_disagree(rows, _labels(spark, sf_dir)).distinct()


@query
def without_group_or_source(spark, sf_dir):
    """V4."""
    return checks.without_group_or_source(_told(spark, sf_dir)).select("item_id").distinct()


@query
def groups_across_splits(spark, sf_dir):
    """V5: leakage in the manifest as last written."""
    return checks.groups_across_splits(_manifest(spark, sf_dir))


@query
def repeated_paths(spark, sf_dir):
    """V7."""
    return checks.repeated(table(spark, sf_dir, "manifest"), "image_path")


@query
def empty_splits(spark, sf_dir):
    """V8, on every row of the manifest."""
    return checks.empty_splits(_written(spark, sf_dir), spark)


@query
def labels_without_training(spark, sf_dir):
    """V9, on every row of the manifest."""
    return checks.labels_without_rows(_written(spark, sf_dir), _labels(spark, sf_dir), "train")


@query
def one_hot_violations(spark, sf_dir):
    """One-hot rows made of the items, whose labels and ids are partly wrong for the table."""
    names = {"healthy": "apple_healthy", "scab": "apple_scab", "rust": "apple_cedar_apple_rust", "multiple_diseases": "apple_multiple_diseases"}
    rows = _items(spark, sf_dir).where("source_dataset = 'cornell'").select(X.stem("image_path").alias("image_id"), *(F.when(F.col("class_label") == v, 1.0).otherwise(0.0).alias(k) for k, v in names.items()))
    return checks.bad_one_hot(rows, list(names)).groupBy("problem").agg(F.count("*").alias("n"))


@query
def not_exactly_one(spark, sf_dir):
    """Stems of the readings' file names, in lower case, that match no or several readable items."""
    wanted = table(spark, sf_dir, "mango_captures").where("image_path IS NOT NULL").select(F.lower(X.stem("image_path")).alias("name"))
    found = relate.readable(_items(spark, sf_dir)).where("image_path IS NOT NULL").select(F.lower(X.stem("image_path")).alias("name"))
    return checks.not_exactly_one(wanted, found, "name")


@query
def inventory_violations(spark, sf_dir):
    """V14 on the curated source's paths."""
    files = _items(spark, sf_dir).where(F.col("source_dataset") == curate.CURATED_SOURCE).select(F.regexp_replace("relative_path", "/lot_[0-9]+/", "/").alias("path"))
    categories = table(spark, sf_dir, "label_map").where("source_dataset = 'mangoleafbd'").select(F.col("source_label").alias("category"))
    return checks.bad_inventory(files, categories, 500, 2).groupBy("problem").agg(F.count("*").alias("n_paths"), F.sum("n").alias("n"))


@query
def support_disagrees(spark, sf_dir):
    """Labels whose support in the manifest is not that among the predictions."""
    at = _labels(spark, sf_dir).select("class_label", "label_index")
    support = _manifest(spark, sf_dir).join(at, "class_label").groupBy("label_index").agg(F.count("*").alias("support"))
    return checks.support_disagrees(metrics.confusion(_predictions(spark, sf_dir)), support)


@query
def manifest_violations(spark, sf_dir):
    """V1 to V9 in one table, on every row of the manifest."""
    return checks.manifest_violations(_written(spark, sf_dir), _labels(spark, sf_dir), spark, table(spark, sf_dir, "items"))
