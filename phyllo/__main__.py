"""Command line: python -m phyllo prepare | train | evaluate | predict | unpack | smoke | query."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phyllo", description="Curate image collections on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="import folders, link related pictures and write a grouped split")
    a.add_argument("--folders", help="source with one folder per label")
    a.add_argument("--leaf-map", help="JSON file with the official groups of that source")
    a.add_argument("--one-hot", help="source with a one-hot train.csv")
    a.add_argument("--ancestors", help="source whose labels are names of folders above")
    a.add_argument("--groups", help="CSV file of reviewed groups: source_dataset, image_path, group_id")
    a.add_argument("--output", required=True)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--near-threshold", type=int, default=4)
    a.add_argument("--curation", choices=("train-only", "deduplicate"), default="train-only")
    a.add_argument("--allow-partial", action="store_true")
    a.add_argument("--exclude-conflicts", action="store_true")
    a.add_argument("--split-by-rounds", action="store_true", help="split by all tasks in rounds, for components that no single task can hold")
    e = sub.add_parser("evaluate", help="metrics of a table of predictions")
    e.add_argument("--predictions", required=True, help="parquet with target, prediction, source_dataset")
    e.add_argument("--labels", required=True, help="labels.json of the manifest")
    e.add_argument("--output", required=True)
    q = sub.add_parser("query", help="run one query and print its first rows")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--output", help="write parquet there instead")
    t = sub.add_parser("train", help="fit a linear head on fixed features of the pictures")
    t.add_argument("--manifest", required=True, help="output folder of prepare")
    t.add_argument("--images", required=True, nargs="+", help="folders with the pictures")
    t.add_argument("--output", required=True)
    f = sub.add_parser("predict", help="labels of all pictures below some folders")
    f.add_argument("--run", required=True, help="output folder of train")
    f.add_argument("--images", required=True, nargs="+")
    f.add_argument("--top", type=int, default=3)
    u = sub.add_parser("unpack", help="unpack an archive after checking its inventory")
    u.add_argument("kind", choices=("one-hot", "categories"))
    u.add_argument("--archive", required=True)
    u.add_argument("--output", required=True)
    u.add_argument("--per-category", type=int, default=500)
    s = sub.add_parser("smoke", help="make a small collection, prepare it, train on it and predict")
    s.add_argument("--output", required=True)
    for x in (a, e, q, t, f, u, s):
        x.add_argument("--master", help="Spark master; the environment's by default")
    return p


def check(args: argparse.Namespace) -> None:
    """Everything that can be known before the work begins."""
    from .operators.checks import check_radius

    if args.command == "prepare":
        check_radius(args.near_threshold)
        given = [x for x in (args.folders, args.one_hot, args.ancestors) if x]
        if not given:
            raise ValueError("name at least one source")
        if len(given) < 3 and not args.allow_partial:
            raise ValueError("name all three sources, or allow a partial collection")
        for path in (*given, args.leaf_map, args.groups):
            if path and "://" not in path and not os.path.exists(path):
                raise ValueError(f"{path} does not exist")


def run(args: argparse.Namespace) -> int:
    from .session import clean, get_session

    spark = get_session(master=args.master)
    if args.command == "query":
        from .queries import queries

        df = queries()[args.name](spark, args.data)
        df.write.parquet(args.output) if args.output else df.show(20, False)
        clean(spark)
        return 0
    if args.command in ("train", "predict"):
        from .plans import head

        if args.command == "train":
            print(head.train(spark, args.manifest, args.images, args.output))
        else:
            head.predict(spark, args.run, args.images, args.top).orderBy("image_path", "rank").show(60, False)
        clean(spark)
        return 0
    if args.command == "unpack":
        from . import labels
        from .sources import archives

        if args.kind == "one-hot":
            done = archives.unpack_one_hot(spark, args.archive, args.output, list(labels.SOURCE_LABELS["cornell"]))
        else:
            categories = labels.label_map(spark).where("source_dataset = 'mangoleafbd'").selectExpr("source_label AS category")
            done = archives.unpack_categories(spark, args.archive, args.output, categories, args.per_category)
        print({k: v for k, v in done.items() if k != "files"})
        return 0
    if args.command == "smoke":
        from .plans import head
        from .sources import synthetic

        root = f"{args.output}/sources"
        synthetic.make_sources(root, tinted=True)
        again = ["prepare", "--folders", f"{root}/plantvillage", "--one-hot", f"{root}/cornell", "--ancestors", f"{root}/mangoleafbd", "--groups", f"{root}/groups.csv", "--output", f"{args.output}/prepared"]
        run(parser().parse_args(again))
        print(head.train(spark, f"{args.output}/prepared", [f"{root}/{s}" for s in ("plantvillage", "cornell", "mangoleafbd")], f"{args.output}/run"))
        head.predict(spark, f"{args.output}/run", [f"{root}/cornell"]).orderBy("image_path", "rank").show(6, False)
        clean(spark)
        return 0
    if args.command == "evaluate":
        from .plans.evaluate import save_reports
        from .sources.tables import read_labels

        print(save_reports(spark, args.output, spark.read.parquet(args.predictions), read_labels(spark, args.labels)))
        return 0
    from pyspark.sql import functions as F

    from . import labels
    from .operators import relate
    from .operators.checks import enforce
    from .operators.curate import CURATED_SOURCE
    from .plans import prepare as plan
    from .sources import images, importers, tables

    mapping, parts = labels.label_map(spark), []
    if args.folders:
        args.folders = args.folders if "://" in args.folders else importers.picture_root(args.folders, list(labels.SOURCE_LABELS["plantvillage"]))
        leaf_map = importers.read_leaf_map(spark, args.leaf_map) if args.leaf_map else None
        parts.append(importers.import_folders(spark, args.folders, mapping, "plantvillage", leaf_map))
    if args.one_hot:
        parts.append(importers.import_one_hot(spark, args.one_hot, mapping, "cornell"))
    if args.ancestors:
        parts.append(importers.import_ancestors(spark, args.ancestors, mapping, "mangoleafbd"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = relate.ordinals(rows.withColumn("item_id", F.lit(0).cast("long")), spark).drop("item_id").withColumnRenamed("ord", "item_id")
    if args.groups:
        rows = importers.apply_reviewed(rows, tables.read_csv(spark, args.groups, ("source_dataset", "image_path", "group_id")))
    files = None
    for path in (args.folders, args.one_hot, args.ancestors):
        if path:
            found = images.find_images(spark, path, True).select("image_path", "content")
            files = found if files is None else files.unionByName(found)
    items, bad = plan.fingerprinted(spark, rows, files)
    captures = None
    if args.curation == "deduplicate":
        read = images.capture_metadata(files)
        mine = items.where(F.col("source_dataset") == CURATED_SOURCE).select("image_path")
        enforce("capture metadata can be read", read.where("error IS NOT NULL").join(mine, "image_path", "left_semi").select("image_path", "error"))
        read = read.drop("width", "height", "error")
        captures = items.select("item_id", "image_path", "width", "height").join(read, "image_path").withColumn("read_at", F.current_timestamp())
    done = plan.prepare(
        spark, items, bad, captures, near_threshold=args.near_threshold, curation=args.curation, conflicts="exclude" if args.exclude_conflicts else "raise",
        allow_partial=args.allow_partial, seed=args.seed, exact_split=not args.split_by_rounds, output=args.output,
    )
    print({k: done.report[k] for k in ("imported_images", "retained_images", "groups", "by_split")})
    clean(spark)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    try:
        check(args)
        return run(args)
    except (ValueError, OSError) as e:
        p.error(str(e))


if __name__ == "__main__":
    sys.exit(main())
