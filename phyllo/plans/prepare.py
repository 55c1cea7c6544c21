"""From imported rows to a checked manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels as label_tables
from .. import schemas
from ..functions.text import missing_to_null
from ..operators import checks, curate, relate, split
from ..session import Scratch
from ..sources import images, tables


@dataclass
class Prepared:
    """Results of a preparation. All tables are lazy reads of written scratch tables."""

    manifest: DataFrame
    labels: DataFrame
    bad_images: DataFrame
    pairs: DataFrame
    conflicts: DataFrame
    review: DataFrame
    excluded: DataFrame
    curation: DataFrame | None
    report: dict = field(default_factory=dict)


def fingerprinted(spark: SparkSession, rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported rows with pixel and perceptual hashes, and the unreadable ones.

    files: ``image_path`` and ``content`` of the rows' pictures.
    """
    good, bad = images.fingerprints(files)
    known = Scratch(spark, "fingerprints").save(rows.join(good, "image_path", "left").join(bad, "image_path", "left"))
    readable = known.where("sha256_pixels IS NOT NULL").drop("error")
    return readable, known.where("sha256_pixels IS NULL").select("image_path", "source_dataset", F.coalesce("error", F.lit("file not found")).alias("error"))


def prepare(
    spark: SparkSession,
    items: DataFrame,
    bad_images: DataFrame | None = None,
    captures: DataFrame | None = None,
    labels: DataFrame | None = None,
    near_threshold: int = 4,
    curation: str = "train-only",
    conflicts: str = "raise",
    allow_partial: bool = False,
    seed: int = 42,
    exact_split: bool = True,
    output: str | None = None,
) -> Prepared:
    """Link, clean, curate and split readable items.

    items: the fields of ``relate.ITEM_FIELDS`` (``item_id`` is made from the
    order if it is missing). curation: "train-only" keeps the curated source in
    train unless all its items have reviewed groups; "deduplicate" keeps one
    representative per family and label, for which ``captures`` is needed.
    conflicts: "raise" or "exclude" items whose equal pixels have different
    labels. exact_split: the sequential split of one task, or the one by
    rounds. Audit tables are written to ``output`` even if the run then fails;
    the manifest only after every check.
    """
    checks.check_radius(near_threshold)
    if curation not in ("train-only", "deduplicate") or conflicts not in ("raise", "exclude"):
        raise ValueError("curation is 'train-only' or 'deduplicate', conflicts is 'raise' or 'exclude'")
    if output:
        tables.guard_output(spark, output)
    scratch = Scratch(spark, "prepare")
    labels = labels if labels is not None else label_tables.labels(spark)
    texts = ("official_group", "reviewed_group", "sha256_pixels")
    items = items.withColumns({c: missing_to_null(c) for c in texts})
    if "item_id" not in items.columns:
        items = relate.ordinals(items.withColumn("item_id", F.lit(0).cast("long")), spark).drop("item_id").withColumnRenamed("ord", "item_id")
    items = scratch.save(items)
    if not items.limit(1).count():
        raise ValueError("there are no pictures")
    bad = bad_images if bad_images is not None else spark.createDataFrame([], schemas.strings(schemas.BAD_FIELDS))
    exact, near = scratch.save(relate.exact_pairs(items)), scratch.save(relate.near_pairs(items, near_threshold))
    pairs, conflicting, review = exact.unionByName(near), relate.conflict_pairs(exact), relate.review_candidates(near)
    left_out = relate.excluded_conflicts(items) if conflicts == "exclude" else relate.excluded_conflicts(items).limit(0)
    if output:
        by_path = ("image_path_a", "image_path_b")
        tables.write_csv(bad, f"{output}/bad_images", schemas.BAD_FIELDS, ("image_path",))
        for name, df in (("duplicate_pairs", pairs), ("conflicts", conflicting), ("review_candidates", review)):
            tables.write_csv(df, f"{output}/{name}", schemas.PAIR_FIELDS, by_path)
        tables.write_csv(left_out, f"{output}/excluded_conflicts", schemas.EXCLUDED_FIELDS, ("image_path",))
    if conflicts == "raise":
        checks.enforce("equal pixels have one label", conflicting.select(*schemas.PAIR_FIELDS[:2], "label_a", "label_b"))
    edges = [exact, near, relate.known_group_edges(items)]
    mine = F.col("source_dataset") == curate.CURATED_SOURCE
    details = None
    if curation == "deduplicate" and captures is not None:
        details = scratch.save(curate.capture_details(captures))
        edges.append(curate.capture_edges(items.where(mine), details))
    related = relate.with_components(spark, relate.readable(items), relate.links(*edges))
    kept = scratch.save(relate.without_conflicts(related) if conflicts == "exclude" else related)
    reviewed = kept.where(mine).agg(F.coalesce(F.bool_and(F.col("reviewed_group").isNotNull()), F.lit(False))).first()[0]
    audit = None
    if curation == "deduplicate" and kept.where(mine).limit(1).count():
        if details is None:
            raise ValueError("deduplication needs capture metadata")
        checks.enforce("every item of the curated source has capture metadata", kept.where(mine).join(details.select("item_id"), "item_id", "left_anti").select("image_path"))
        kept, audit = curate.curate(spark, kept, details)
        kept, audit = scratch.save(kept), scratch.save(audit)
    if output:
        empty = spark.createDataFrame([], schemas.strings(schemas.CURATION_FIELDS))
        tables.write_csv(audit if audit is not None else empty, f"{output}/mango_curation", schemas.CURATION_FIELDS, ("relative_path", "image_path"))
    if not kept.limit(1).count():
        raise ValueError("no picture is left after readability and conflict checks")
    if not allow_partial:
        checks.enforce("all labels have pictures", checks.labels_without_rows(kept, labels))
    hold = None if reviewed or curation == "deduplicate" else curate.CURATED_SOURCE
    splits = split.grouped_split(kept, seed, train_only_source=hold, exact=exact_split)
    named = relate.with_group_ids(kept.join(splits, "root"))
    observed = label_tables.reindex(labels, kept)
    manifest = scratch.save(label_tables.with_label(named, observed).fillna("", ["official_group", "reviewed_group"]))
    checks.enforce("groups stay in one split", checks.groups_across_splits(manifest))
    result = Prepared(manifest, observed, bad, pairs, conflicting, review, left_out, audit)
    result.report = report(spark, result, labels, items.count(), bad, exact, near, items, seed=seed, near_threshold=near_threshold, curation=curation, conflicts=conflicts)
    if output:
        tables.write_csv(manifest, f"{output}/manifest", schemas.MANIFEST_FIELDS, ("source_dataset", "relative_path"))
        tables.write_json(spark, f"{output}/labels.json", tables.label_json(observed))
        tables.write_json(spark, f"{output}/report.json", result.report)
    return result


def report(spark: SparkSession, done: Prepared, labels: DataFrame, imported: int, bad: DataFrame, exact: DataFrame, near: DataFrame, items: DataFrame, **settings) -> dict:
    """Counts of a preparation, from aggregates with one row per source, label or split."""
    m = done.manifest

    def counts(*keys: str) -> dict:
        return {"/".join(str(r[k]) for k in keys): r["n"] for r in sorted(m.groupBy(*keys).agg(F.count("*").alias("n")).collect(), key=str)}

    out = {"imported_images": imported, "retained_images": m.count(), "by_source": counts("source_dataset"), "by_class": counts("class_label"), "by_split": counts("split"), "by_split_and_class": counts("split", "class_label")}
    out["groups"] = m.agg(F.count_distinct("group_id")).first()[0]
    out["groups_by_split"] = {r["split"]: r["n"] for r in m.groupBy("split").agg(F.count_distinct("group_id").alias("n")).collect()}
    missing: dict[str, list] = {}
    for r in checks.missing_classes(m, labels).collect():
        missing.setdefault(r["scope"], []).append(r["class_label"])
    out["missing_classes"] = {k: sorted(v) for k, v in sorted(missing.items())}
    out.update(relate.duplicate_stats(bad, exact, near, items).first().asDict())
    if settings.get("conflicts") != "exclude":
        out["excluded_conflicting_images"] = out["excluded_conflicting_pixel_hashes"] = 0
    if done.curation is not None:
        out["curation_summary"] = curate.curation_summary(done.curation).first().asDict()
        out["curation_by_class"] = {r["class_label"]: r.asDict() for r in curate.curation_by_class(done.curation).collect()}
    return {**out, **settings}
