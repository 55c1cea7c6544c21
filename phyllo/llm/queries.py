"""Queries over the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import linking, neardup, overlap, packing, reading, splitting, survivors, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.linked_groups(spark, table(spark, sf_dir, "match_pairs"), table(spark, sf_dir, "items"))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have how many members."""
    sizes = p4_found(spark, sf_dir).groupBy("group_item_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("n_groups"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_pairs(neardup.photographs(spark, table(spark, sf_dir, "items")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its photograph, which is its own id where it has no copy, and the number of its copies."""
    items = table(spark, sf_dir, "items")
    groups = neardup.photographs(spark, items)
    sizes = groups.groupBy("group_item_id").agg((F.count("*") - 1).alias("n_copies"))
    found = groups.join(sizes, "group_item_id")
    rows = items.select("item_id").distinct().join(found, "item_id", "left")
    return rows.select("item_id", F.coalesce("group_item_id", "item_id").alias("group_item_id"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(spark, table(spark, sf_dir, "items"), table(spark, sf_dir, "manifest"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the overlaps per evaluation split and source."""
    photos = Scratch(spark, "report").save(overlap.photographs(spark, table(spark, sf_dir, "items")))
    return overlap.overlap_report(photos, table(spark, sf_dir, "manifest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.broken_groups(spark, table(spark, sf_dir, "manifest")).select("group_id")


def p3_broken_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with broken groups: how many of these each holds. They are mended together, since they share items."""
    return splitting.broken_groups(spark, table(spark, sf_dir, "manifest")).groupBy("component").agg(F.count("*").alias("n_broken"))


def p3_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in more than one split, by the published splits and by the new ones."""
    manifest = table(spark, sf_dir, "manifest")
    new = splitting.assign(spark, manifest).where("group_id IS NOT NULL").groupBy("group_id").agg(F.count_distinct("new_split").alias("k")).where("k > 1")
    counts = [d.agg(F.count("*").alias("n_parted")).withColumn("splits", F.lit(name)) for name, d in (("published", splitting.broken_groups(spark, manifest)), ("new", new))]
    return counts[0].unionByName(counts[1])


def p3_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New split of every group, or of the item or path where there is no group."""
    return splitting.assign(spark, table(spark, sf_dir, "manifest")).groupBy("component", "entity", "new_split").agg(F.sum("n").alias("n_rows"))


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each new split, overall and within each source."""
    return splitting.balance(splitting.assign(spark, table(spark, sf_dir, "manifest")))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "mango_curation"), table(spark, sf_dir, "mango_captures"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select("family_id", "item_id").distinct()


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors with the best values known for their fields."""
    return _survivors(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scratch(spark, "packing").save(tokens.token_counts(table(spark, sf_dir, "documents")))
    return packing.pack(spark, counts, table(spark, sf_dir, "pack_sizes"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text, or of each piece of a text longer than the container."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill(_packed(spark, sf_dir))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every document, null for those that are not running prose."""
    return reading.levels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_grades")).select("doc_id", "level")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("level >= 4").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


P4_LINKS = """
    known AS (SELECT DISTINCT item_id, image_path FROM items),
    ends AS (
        SELECT coalesce(m.item_id_a, pa.item_id) AS a, coalesce(m.item_id_b, pb.item_id) AS b
        FROM match_pairs m
        LEFT JOIN known pa ON m.item_id_a IS NULL AND m.image_path_a = pa.image_path
        LEFT JOIN known pb ON m.item_id_b IS NULL AND m.image_path_b = pb.image_path),
    valid AS (
        SELECT DISTINCT a, b FROM ends
        WHERE a <> b AND a IN (SELECT item_id FROM known) AND b IN (SELECT item_id FROM known)),
    both_ways AS (SELECT a, b FROM valid UNION SELECT b, a FROM valid),
    walk(item_id, seen) AS (
        SELECT a, a FROM both_ways
        UNION
        SELECT w.item_id, e.b FROM walk w JOIN both_ways e ON w.seen = e.a),
    grouped AS (SELECT item_id, min(seen) AS group_item_id FROM walk GROUP BY item_id)
"""


# The marks of a copy and of an editor, as the operators count them.
P5_RANKED = r"""
    best AS (
        SELECT item_id,
            arg_max(software, read_at) FILTER (trim(software) <> '') AS software,
            arg_max(width, read_at) FILTER (width IS NOT NULL) AS width,
            arg_max(height, read_at) FILTER (height IS NOT NULL) AS height
        FROM mango_captures GROUP BY item_id),
    ranked AS (
        SELECT DISTINCT lower(trim(family_id)) AS family_id, c.class_label, c.item_id, c.relative_path,
            coalesce(regexp_matches(lower(software), 'photo editor|photoshop|gimp'), false) AS edited,
            coalesce(width::BIGINT * height, 0) AS area,
            regexp_replace(regexp_extract(c.relative_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem
        FROM mango_curation c LEFT JOIN best USING (item_id) WHERE trim(family_id) <> ''),
    marked AS (
        SELECT *, len(regexp_extract_all(stem, '(?i)\(\s*custom\s*\)|\bcopy\b'))
            + regexp_matches(stem, '[ _-]\d{1,3}\s*(?:\([^)]*\)\s*)*$')::INT
            + len(regexp_extract_all(regexp_extract(stem, '(?:\([^)]*\)\s*)*$'), '\(\d+\)')) AS about
        FROM ranked),
    chosen AS (
        SELECT family_id, item_id, row_number() OVER (
            PARTITION BY family_id, class_label ORDER BY edited, area DESC, about, relative_path, item_id) AS place
        FROM marked)
"""


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_SPLIT = f"""CASE lower(trim(split, {_BLANKS})) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val'
    WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' END"""

# All pairs are compared: no fragments, no bands, no suffixes.
P1_GROUPED = rf"""
    every AS (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL),
    seen_hashes AS (SELECT DISTINCT item_id, list_filter(hashes, lambda x: x IS NOT NULL) AS hs FROM items WHERE item_id IS NOT NULL AND len(hashes) > 0),
    names AS (
        SELECT item_id, min(regexp_extract(image_path, '[^/]*$')) AS name FROM items
        WHERE item_id IS NOT NULL AND trim(image_path, {_BLANKS}) <> '' AND len(hashes) > 0 GROUP BY 1),
    words AS (
        SELECT item_id, trim(regexp_replace(regexp_replace(lower(name), '^(.+)\.[^.]*$', '\1', 's'), '%[0-9a-f]{{2}}|[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w FROM names),
    cores AS (SELECT item_id, ' ' || regexp_replace(w, ' +', ' ', 'g') || ' ' AS core FROM words WHERE w <> ''),
    grams AS (
        SELECT DISTINCT item_id, substr(core, i, 3) AS g FROM (SELECT item_id, core, unnest(range(1, length(core) - 1)) AS i FROM cores)
        WHERE substr(core, i + 1, 1) <> ' '),
    counted AS (SELECT g, count(*) AS n FROM grams GROUP BY g),
    weighed AS (SELECT g, ln(1 + (SELECT max(n) FROM counted) / n) AS weight FROM counted),
    heavy AS (SELECT item_id, sum(weight) AS total FROM grams JOIN weighed USING (g) GROUP BY 1),
    turns AS (SELECT DISTINCT item_id, unnest(hs) AS h FROM seen_hashes SEMI JOIN cores USING (item_id)),
    canonical AS (SELECT DISTINCT item_id, hs[1] AS c FROM seen_hashes SEMI JOIN cores USING (item_id)),
    near AS (
        SELECT DISTINCT least(t.item_id, c.item_id) AS a, greatest(t.item_id, c.item_id) AS b
        FROM turns t JOIN canonical c ON t.item_id <> c.item_id AND bit_count(xor(t.h, c.c)) <= 4),
    alike AS (
        SELECT a, b FROM near JOIN grams x ON x.item_id = a JOIN grams y ON y.item_id = b AND x.g = y.g JOIN weighed w ON w.g = x.g
        JOIN heavy ha ON ha.item_id = a JOIN heavy hb ON hb.item_id = b
        GROUP BY a, b, ha.total, hb.total HAVING sum(weight) >= 0.3 * least(ha.total, hb.total)),
    pixels AS (SELECT DISTINCT item_id, lower(trim(sha256_pixels, {_BLANKS})) AS p FROM items WHERE item_id IS NOT NULL AND trim(sha256_pixels, {_BLANKS}) <> ''),
    links AS (SELECT a, b FROM alike UNION SELECT x.item_id, y.item_id FROM pixels x JOIN pixels y USING (p) WHERE x.item_id < y.item_id),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(item_id, seen) AS (SELECT a, a FROM both_ways UNION SELECT w.item_id, e.b FROM walk w JOIN both_ways e ON w.seen = e.a),
    photos AS (SELECT item_id, min(seen) AS group_item_id FROM walk GROUP BY item_id)
"""

P2_STANDS = f"""
    stands AS (SELECT DISTINCT item_id, {_SPLIT} AS split, lower(trim(source_dataset, {_BLANKS})) AS source_dataset FROM manifest WHERE item_id IS NOT NULL AND {_SPLIT} IS NOT NULL),
    trained AS (SELECT DISTINCT item_id FROM stands WHERE split = 'train'),
    held AS (SELECT DISTINCT item_id, split, source_dataset FROM stands WHERE split <> 'train'),
    crossed AS (
        SELECT DISTINCT e.item_id AS e, t.item_id AS t FROM photos e JOIN photos t USING (group_item_id)
        WHERE e.item_id <> t.item_id AND t.item_id IN (FROM trained) AND e.item_id IN (SELECT item_id FROM held))
"""

_FOLDED = r"trim(regexp_replace(replace(coalesce({0}, ''), chr(0), ''), '[\s\x{{a0}}]+', ' ', 'g'))"


def _latest(field: str, value: str) -> str:
    return f"(list({value} ORDER BY read_at NULLS FIRST, {value}) FILTER ({value} IS NOT NULL))[-1] AS {field}"


def _known(c: str) -> str:
    return f"CASE WHEN trim({c}, {_BLANKS}) <> '' THEN {c} END AS {c}"


_ORDER = "edited, -area, about, coalesce(relative_path, chr(1114111)), item_id"
_TIME = _FOLDED.format("capture_time")

# Layers are the longest chains of records that dominate a record, found step by step.
P5_SURVIVORS = rf"""WITH RECURSIVE
    told AS (
        SELECT item_id, read_at, {", ".join(f"nullif({_FOLDED.format(c)}, '') AS {c}" for c in ("make", "model", "software"))}, width, height,
            CASE WHEN regexp_full_match({_TIME}, '\d{{4}}:\d\d:\d\d \d\d:\d\d:\d\d') AND {_TIME} >= '0001' AND try_strptime({_TIME}, '%Y:%m:%d %H:%M:%S') IS NOT NULL THEN {_TIME} END AS capture_time
        FROM mango_captures WHERE item_id IS NOT NULL),
    best AS (
        SELECT item_id, {", ".join(_latest(c, c) for c in ("make", "model", "capture_time", "software", "width", "height"))},
            coalesce(year(max(read_at)) * 12 + month(max(read_at)), 0) AS month FROM told GROUP BY 1),
    ranked AS (
        SELECT DISTINCT lower(trim(family_id, {_BLANKS})) AS family_id, coalesce(lower(trim(class_label, {_BLANKS})), '') AS class_label, c.item_id, {_known("relative_path")},
            {_known("sha256_pixels")}, {_known("capture_id")}, {_known("camera")}, make, model, best.capture_time AS capture_time, software, width, height, coalesce(month, 0) AS month,
            coalesce(regexp_matches(lower(software), 'photo editor|photoshop|gimp'), false)::INT AS edited, coalesce(width::BIGINT * height, 0) AS area
        FROM mango_curation c LEFT JOIN best USING (item_id) WHERE trim(family_id, {_BLANKS}) <> '' AND c.item_id IS NOT NULL),
    stems AS (SELECT *, regexp_replace(regexp_extract(relative_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM ranked),
    marked AS (
        SELECT *, coalesce(len(regexp_extract_all(stem, '(?i)\(\s*custom\s*\)|\bcopy\b'))
            + regexp_matches(stem, '[ _-]\d{{1,3}}\s*(?:\([^)]*\)\s*)*$')::INT
            + len(regexp_extract_all(regexp_extract(stem, '(?:\([^)]*\)\s*)*$'), '\(\d+\)')), 0) AS about FROM stems),
    vectors AS (SELECT family_id, class_label, edited, area, about, month, count(DISTINCT item_id) AS n FROM marked GROUP BY ALL),
    beats AS (
        SELECT x.family_id, x.class_label, x.edited AS e, x.area AS ar, x.about AS ab, x.month AS mo, y.edited, y.area, y.about, y.month
        FROM vectors x JOIN vectors y ON x.family_id = y.family_id AND x.class_label = y.class_label AND x.edited <= y.edited AND x.area >= y.area AND x.about <= y.about AND x.month >= y.month
            AND (x.edited, x.area, x.about) <> (y.edited, y.area, y.about)),
    chain(family_id, class_label, edited, area, about, month, layer) AS (
        SELECT family_id, class_label, edited, area, about, month, 1 FROM vectors
        UNION
        SELECT b.family_id, b.class_label, b.edited, b.area, b.about, b.month, c.layer + 1 FROM chain c JOIN beats b
            ON b.family_id = c.family_id AND b.class_label = c.class_label AND b.e = c.edited AND b.ar = c.area AND b.ab = c.about AND b.mo = c.month),
    layers AS (SELECT family_id, class_label, edited, area, about, month, max(layer) AS layer FROM chain GROUP BY ALL),
    placed AS (SELECT * FROM marked JOIN layers USING (family_id, class_label, edited, area, about, month)),
    sums AS (SELECT family_id, class_label, sum(n)::BIGINT AS n_records FROM vectors GROUP BY 1, 2)
    SELECT family_id, class_label, (list(item_id ORDER BY {_ORDER}) FILTER (layer = 1))[1] AS item_id,
        (list(coalesce(relative_path, chr(1114111)) ORDER BY {_ORDER}) FILTER (layer = 1))[1] AS relative_path,
        {", ".join(f"(list({c} ORDER BY layer, {_ORDER}, {c}) FILTER ({c} IS NOT NULL))[1] AS {c}" for c in survivors.FILLED)},
        any_value(n_records) AS n_records, max(layer) AS n_layers
    FROM placed JOIN sums USING (family_id, class_label) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    p1 = f"WITH RECURSIVE {P1_GROUPED}"
    p2 = f"{p1}, {P2_STANDS}"
    broken = f"""SELECT lower(trim(group_id, {_BLANKS})) AS group_id FROM manifest WHERE trim(group_id, {_BLANKS}) <> '' GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1"""
    return {
        "p1_found": f"{p1} SELECT x.item_id AS item_id_a, y.item_id AS item_id_b FROM photos x JOIN photos y USING (group_item_id) WHERE x.item_id < y.item_id",
        "p1_groups": f"""{p1}, sizes AS (SELECT group_item_id, count(*) - 1 AS n_copies FROM photos GROUP BY 1)
            SELECT item_id, coalesce(group_item_id, item_id) AS group_item_id, coalesce(n_copies, 0) AS n_copies
            FROM every LEFT JOIN photos USING (item_id) LEFT JOIN sizes USING (group_item_id)""",
        "p2_found": f"{p2} SELECT DISTINCT least(e, t) AS item_id_a, greatest(e, t) AS item_id_b FROM crossed",
        "p2_report": f"""{p2},
            told AS (SELECT e AS item_id, t FROM crossed UNION ALL SELECT item_id, NULL FROM trained)
            SELECT split, source_dataset, count(DISTINCT item_id) AS n_items, count(DISTINCT CASE WHEN t IS NULL THEN item_id END) AS n_own, count(DISTINCT CASE WHEN t IS NOT NULL THEN (item_id, t) END) AS n_pairs
            FROM told JOIN held USING (item_id) GROUP BY 1, 2""",
        "p3_parted": f"SELECT 'published' AS splits, count(*) AS n_parted FROM ({broken}) UNION ALL SELECT 'new', 0",
        "p3_broken_components": f"""WITH RECURSIVE
            said AS (
                SELECT DISTINCT coalesce('group:' || nullif(lower(trim(group_id, {_BLANKS})), ''), 'item:' || item_id, 'path:' || CASE WHEN trim(image_path, {_BLANKS}) <> '' THEN image_path END) AS entity,
                    coalesce(item_id::VARCHAR, CASE WHEN trim(image_path, {_BLANKS}) <> '' THEN image_path END) AS item FROM manifest),
            linked AS (SELECT DISTINCT x.entity AS a, y.entity AS b FROM said x JOIN said y USING (item) WHERE x.entity IS NOT NULL AND y.entity IS NOT NULL),
            walk(a, b) AS (SELECT a, b FROM linked UNION SELECT w.a, l.b FROM walk w JOIN linked l ON w.b = l.a),
            least_of AS (SELECT a, min(b) AS component FROM walk GROUP BY a)
            SELECT coalesce(component, 'group:' || group_id) AS component, count(*) AS n_broken FROM ({broken}) LEFT JOIN least_of ON a = 'group:' || group_id GROUP BY 1""",
        "p3_found": """SELECT lower(trim(group_id)) AS group_id FROM manifest
            WHERE trim(group_id, chr(9) || chr(10) || chr(13) || ' ') <> '' GROUP BY 1
            HAVING count(DISTINCT CASE lower(trim(split, chr(9) || chr(10) || chr(13) || ' '))
                WHEN 'train' THEN 1 WHEN 'training' THEN 1 WHEN 'val' THEN 2 WHEN 'valid' THEN 2
                WHEN 'validation' THEN 2 WHEN 'test' THEN 3 WHEN 'testing' THEN 3 END) > 1""",
        "p5_survivors": P5_SURVIVORS,
        "p5_found": f"WITH {P5_RANKED} SELECT DISTINCT family_id, item_id FROM chosen WHERE place = 1",
        "p4_found": f"WITH RECURSIVE {P4_LINKS} SELECT item_id, group_item_id FROM grouped",
        "p4_group_sizes": f"""WITH RECURSIVE {P4_LINKS},
            sizes AS (SELECT group_item_id, count(*) AS members FROM grouped GROUP BY 1)
            SELECT members, count(*) AS n_groups FROM sizes GROUP BY 1""",
    }
