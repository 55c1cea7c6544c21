"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node linked to it, for each node with a link.

    edges: ``a`` and ``b`` of one ordered type. Self-links, repetitions and
    directions do not matter, null ends link nothing. Neighbourhoods are never
    collected: each step is a map-side combined minimum and a join.
    """
    scratch = Scratch(spark, "stars")
    e = scratch.save(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    size = e.count()
    while size:
        following = scratch.save(_small_star(_large_star(e).where("a <> b").distinct()))
        # All edges lead to a root when a step changes nothing.
        count = following.count()
        stable = count == size and not following.join(e, ["a", "b"], "left_anti").limit(1).count()
        scratch.drop(e)
        e, size = following, count
        if stable:
            break
    linked = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return linked.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


PIECE = 1 << 20  # characters


def _pieces(prefix: str, kind: pa.DataType, most: int):
    """Names of the groups that lie within one range of the sorted members; the text of the groups at its
    borders, and of long ones, in pieces, since they may go on beside it or fill no memory."""
    schema = pa.schema([("root", kind), ("part", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, lines, size, seq, border = None, [], 0, 0, True
        rows: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal lines, size, seq
            text = "\n".join(lines)
            name = prefix + hashlib.sha256(text.encode("utf-8")).hexdigest()[:16] if whole and not seq else None
            rows.append((root, part, seq, None if name else text, name))
            lines, size, seq = [], 0, seq + 1

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for r, m in zip(batch.column("root").to_pylist(), batch.column("member").to_pylist()):
                if r != root:
                    if lines:
                        close(not border)
                    border = root is None
                    root, seq = r, 0
                elif size >= most:
                    close(False)
                lines.append(m)
                size += len(m)
            if len(rows) > 5000 or any(row[3] for row in rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if lines:
            close(False)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _joined(prefix: str, kind: pa.DataType):
    """Names of the groups whose pieces come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, state, roots, names = None, None, [], []
        for batch in batches:
            for r, text in zip(batch.column("root").to_pylist(), batch.column("text").to_pylist()):
                if state is not None and r == root:
                    state.update(b"\n")
                else:
                    if state is not None:
                        roots.append(root)
                        names.append(prefix + state.hexdigest()[:16])
                    root, state = r, hashlib.sha256()
                state.update(text.encode("utf-8"))
        if state is not None:
            roots.append(root)
            names.append(prefix + state.hexdigest()[:16])
        yield pa.RecordBatch.from_arrays([pa.array(roots, kind), pa.array(names, pa.string())], names=["root", "name"])

    return run


def group_digests(members: DataFrame, prefix: str, piece: int = PIECE) -> DataFrame:
    """Name of each group: ``prefix`` and 16 hex digits of the SHA-256 of its sorted members, one a line.

    members: ``root`` and ``member`` (string). Ranges of the sorted members
    cut large groups, so a group of any size is sorted and joined by many
    tasks. What is left to one task is the digest of its text, in pieces: a
    SHA-256 runs from the first byte to the last, at hundreds of MB a second,
    and holds one piece at a time.
    """
    kind = members.schema["root"].dataType
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]
    ordered = members.select("root", "member").where("member IS NOT NULL").repartitionByRange("root", "member").sortWithinPartitions("root", "member")
    fields = [T.StructField("root", kind), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("name", T.StringType())]
    told = Scratch(members.sparkSession, "digests").save(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_pieces(prefix, arrow, piece), T.StructType(fields)))
    pieces = told.where("name IS NULL").repartition("root").sortWithinPartitions("root", "part", "seq").select("root", "text")
    joined = pieces.mapInArrow(_joined(prefix, arrow), T.StructType([T.StructField("root", kind), T.StructField("name", T.StringType())]))
    return told.where("name IS NOT NULL").select("root", "name").unionByName(joined)
