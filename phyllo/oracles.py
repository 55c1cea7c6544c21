"""SQL of the queries for a plain engine over the same tables, written independently of the operators."""

from __future__ import annotations

BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _spelled(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS})), '')"


def _missing(c: str) -> str:
    return f"CASE WHEN trim({c}, {BLANKS}) <> '' THEN {c} END"


_SPLIT = f"""CASE {_spelled("split")} WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val'
    WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' END"""

#: Latest import of each item, missing texts null, with the order key ``k``.
ITEMS = f"""it AS (
    SELECT item_id, {", ".join(f"{_missing(c)} AS {c}" for c in ("image_path", "relative_path", "source_dataset", "class_label", "official_group", "reviewed_group", "sha256_pixels"))},
        hashes, row(coalesce(source_dataset, ''), coalesce(relative_path, ''), coalesce(image_path, ''), item_id) AS k
    FROM items WHERE item_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY imported_at DESC NULLS LAST, image_path DESC NULLS LAST) = 1),
ok AS (SELECT * FROM it WHERE sha256_pixels IS NOT NULL AND hashes IS NOT NULL)"""

FIRSTS = "firsts AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY sha256_pixels ORDER BY k) = 1)"

_PAIR = """f.item_id AS item_id_a, x.item_id AS item_id_b, f.image_path AS image_path_a, x.image_path AS image_path_b,
    f.source_dataset AS source_a, x.source_dataset AS source_b, f.class_label AS label_a, x.class_label AS label_b"""

EXACT = f"""exact AS (
    SELECT {_PAIR}, 'exact_pixels' AS match_type, 0 AS phash_distance
    FROM ok x JOIN firsts f USING (sha256_pixels) WHERE x.item_id <> f.item_id)"""


def _near(radius: int) -> str:
    # Both orders of a comparison with the eight orientations of the later row.
    turns = ", ".join(f"bit_count(xor(x.hashes[{k}], f.hashes[1]))" for k in range(1, 9))
    return f"""near AS (
    SELECT {_PAIR}, 'perceptual_candidate' AS match_type, least({turns})::INT AS phash_distance
    FROM firsts f JOIN firsts x ON f.k < x.k AND least({turns}) <= {radius})"""


NEAR = _near(4)

KNOWN = """held AS (
    SELECT item_id, k, 'official_group' AS field, source_dataset AS namespace, official_group AS value FROM ok WHERE official_group IS NOT NULL
    UNION ALL
    SELECT item_id, k, 'reviewed_group', CASE WHEN starts_with(reviewed_group, 'global:') THEN 'global' ELSE source_dataset END, reviewed_group
    FROM ok WHERE reviewed_group IS NOT NULL),
known AS (
    SELECT * FROM (SELECT field, first_value(item_id) OVER (PARTITION BY field, namespace, value ORDER BY k) AS a, item_id AS b FROM held
        WHERE namespace IS NOT NULL) WHERE a <> b)"""

CAPTURES = rf"""read AS (
    SELECT item_id, read_at, width, height,
        trim(regexp_replace(replace(coalesce(make, ''), chr(0), ''), '\s+', ' ', 'g')) AS make,
        trim(regexp_replace(replace(coalesce(model, ''), chr(0), ''), '\s+', ' ', 'g')) AS model,
        trim(regexp_replace(replace(coalesce(capture_time, ''), chr(0), ''), '\s+', ' ', 'g')) AS raw_time,
        lower(trim(regexp_replace(replace(coalesce(software, ''), chr(0), ''), '\s+', ' ', 'g'))) AS software,
        row_number() OVER (PARTITION BY item_id ORDER BY read_at DESC NULLS LAST, make DESC NULLS LAST, model DESC NULLS LAST,
            capture_time DESC NULLS LAST, software DESC NULLS LAST, width DESC NULLS LAST, height DESC NULLS LAST) AS place
    FROM mango_captures),
timed AS (
    SELECT *, CASE WHEN regexp_full_match(raw_time, '\d{{4}}:\d{{2}}:\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}') AND raw_time >= '0001'
        THEN coalesce(strftime(try_strptime(raw_time, '%Y:%m:%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S'), '') ELSE '' END AS capture_time
    FROM read),
details AS (
    SELECT item_id, read_at, place, capture_time,
        CASE WHEN make <> '' AND model <> '' AND capture_time <> '' THEN lower(make) || chr(10) || lower(model) || chr(10) || capture_time END AS capture_key,
        concat_ws(' | ', nullif(make, ''), nullif(model, '')) AS camera, coalesce(width::BIGINT * height, 0) AS area,
        regexp_matches(software, 'photo editor|photoshop|gimp') AS edited,
        width, height
    FROM timed)"""

CAPTURE_EDGES = f"""capture_links AS (
    SELECT * FROM (
        SELECT first_value(i.item_id) OVER (PARTITION BY d.capture_key ORDER BY i.k) AS a, i.item_id AS b
        FROM ok i JOIN details d ON d.item_id = i.item_id AND d.place = 1
        WHERE d.capture_key IS NOT NULL AND i.source_dataset = 'mangoleafbd') WHERE a <> b)"""


def _components(*edges: str) -> str:
    """Smallest linked id of each readable item; the walk keeps one label per item."""
    union = " UNION ".join(f"SELECT {a} AS a, {b} AS b FROM {t}" for t, a, b in edges)
    return f"""edges AS ({union}),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(node, root) USING KEY (node) AS (
    SELECT item_id, item_id FROM ok
    UNION
    SELECT e.b, min(w.root) FROM walk w JOIN both_ways e ON e.a = w.node JOIN recurring.walk r ON r.node = e.b
    WHERE w.root < r.root GROUP BY e.b),
related AS (SELECT ok.*, root FROM ok JOIN walk ON walk.node = ok.item_id)"""


_IDS = ("item_id_a", "item_id_b")
RELATED = f"{ITEMS}, {FIRSTS}, {EXACT}, {NEAR}, {KNOWN}, " + _components(("exact", *_IDS), ("near", *_IDS), ("known", "a", "b"))
CONFLICTING = "conflicting AS (SELECT sha256_pixels, count(*) AS n_images, count(DISTINCT class_label) AS n_labels FROM ok GROUP BY 1 HAVING count(DISTINCT class_label) > 1)"

STEM = r"regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\.[^.]*$', '\1')"


def _markers(path: str) -> str:
    s = STEM.format(path)
    return rf"""(len(regexp_extract_all({s}, '(?i)\(\s*custom\s*\)|\bcopy\b'))
        + regexp_matches({s}, '[ _-]\d{{1,3}}\s*(?:\([^)]*\)\s*)*$')::INT
        + len(regexp_extract_all(regexp_extract({s}, '(?:\([^)]*\)\s*)*$'), '\(\d+\)')))"""


CURATED = (
    f"{ITEMS}, {FIRSTS}, {EXACT}, {NEAR}, {KNOWN}, {CAPTURES}, {CAPTURE_EDGES}, {CONFLICTING}, "
    + _components(("exact", *_IDS), ("near", *_IDS), ("known", "a", "b"), ("capture_links", "a", "b"))
    + f""",
kept AS (SELECT * FROM related WHERE sha256_pixels NOT IN (SELECT sha256_pixels FROM conflicting)),
mine AS (
    SELECT i.*, d.capture_key, d.capture_time, d.camera, coalesce(d.area, 0) AS area, coalesce(d.edited, false) AS edited, {_markers("i.relative_path")} AS about
    FROM kept i LEFT JOIN details d ON d.item_id = i.item_id AND d.place = 1 WHERE i.source_dataset = 'mangoleafbd'),
ranked AS (
    SELECT *, count(*) OVER (PARTITION BY root, class_label) AS members,
        first_value(item_id) OVER w AS best_id, first_value(image_path) OVER w AS best_path
    FROM mine WINDOW w AS (PARTITION BY root, class_label ORDER BY edited, area DESC, about, relative_path, image_path)),
families AS (
    SELECT root, 'mango_family_' || substr(sha256(string_agg(concat_ws(':', source_dataset, relative_path), chr(10)
        ORDER BY concat_ws(':', source_dataset, relative_path))), 1, 16) AS family_id FROM kept GROUP BY root),
audit AS (
    SELECT item_id, image_path, relative_path, class_label,
        coalesce('capture_' || substr(sha256(capture_key), 1, 16), '') AS capture_id, coalesce(capture_time, '') AS capture_time, coalesce(camera, '') AS camera,
        family_id, CASE WHEN item_id = best_id THEN 'keep' ELSE 'exclude' END AS action, best_path AS representative_path,
        CASE WHEN members = 1 THEN 'only photo with its label in the family' WHEN item_id = best_id THEN 'chosen by the representative policy'
            ELSE 'related photo with the same label is kept' END AS reason
    FROM ranked JOIN families USING (root))"""
)

MANIFEST = f"""m AS (
    SELECT item_id, {_SPLIT} AS split, {_spelled("group_id")} AS group_id, image_path, source_dataset, tree_type, condition, class_label, relative_path
    FROM manifest WHERE item_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY written_at DESC NULLS LAST, {_SPLIT} DESC NULLS LAST, {_spelled("group_id")} DESC NULLS LAST,
        image_path DESC NULLS LAST, source_dataset DESC NULLS LAST, tree_type DESC NULLS LAST, condition DESC NULLS LAST, class_label DESC NULLS LAST, relative_path DESC NULLS LAST) = 1)"""

PREDICTIONS = f"""{ITEMS},
said AS (SELECT item_id_a AS item_id, arg_min(label_b, pair_id) AS class_label FROM match_pairs WHERE item_id_a IS NOT NULL GROUP BY 1),
pr AS (
    SELECT it.item_id, it.source_dataset, t.label_index AS target, p.label_index AS prediction
    FROM it JOIN class_labels t ON t.class_label = it.class_label JOIN said s ON s.item_id = it.item_id JOIN class_labels p ON p.class_label = s.class_label),
cm AS (SELECT target, prediction, count(*) AS n FROM pr GROUP BY ALL)"""


def _per_class(key: str = "") -> str:
    k, on = (f"{key}, ", f"AND x.{key} = g.{key}") if key else ("", "")
    grid = f"SELECT DISTINCT {key}, label_index FROM pr, class_labels" if key else "SELECT label_index FROM class_labels"
    return f"""grid AS ({grid}),
mg AS (
    SELECT {k.replace(key, "g." + key) if key else ""}g.label_index,
        (SELECT count(*) FROM pr x WHERE x.target = g.label_index {on}) AS support,
        (SELECT count(*) FROM pr x WHERE x.prediction = g.label_index {on}) AS predicted,
        (SELECT count(*) FROM pr x WHERE x.target = g.label_index AND x.prediction = g.label_index {on}) AS correct
    FROM grid g),
rt AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN correct / support ELSE 0.0 END AS r FROM mg),
pc AS (SELECT {k}label_index, support, predicted, correct, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM rt)"""


_SUMMARY = """sum(support)::BIGINT AS n, round(sum(correct) / sum(support), 9) AS accuracy, round(avg(f), 9) AS macro_f1,
    round(avg(f) FILTER (support > 0), 9) AS macro_f1_supported, count(*) FILTER (support > 0) AS supported_classes"""

HISTORY = """hist AS (
    SELECT year(found_at) * 12 + month(found_at) - 2022 * 12 AS epoch, round(avg((label_a = label_b)::INT::DOUBLE), 2) AS macro_f1
    FROM match_pairs WHERE found_at IS NOT NULL GROUP BY 1)"""

#: Every row of the manifest, split words and groups in canonical spelling.
WRITTEN = f"w AS (SELECT * REPLACE ({_SPLIT} AS split, {_spelled('group_id')} AS group_id) FROM manifest)"

TOLD = "told AS (SELECT DISTINCT * EXCLUDE (written_at) FROM manifest)"


def _grid(rows: str) -> str:
    return f"""grid AS (SELECT class_label, s.split FROM class_labels, (VALUES ('train'), ('val'), ('test')) s(split)),
filled AS (SELECT grid.split, grid.class_label, count(r.item_id) AS n FROM grid LEFT JOIN {rows} r USING (split, class_label) GROUP BY ALL)"""


_HOT = {"healthy": "apple_healthy", "scab": "apple_scab", "rust": "apple_cedar_apple_rust", "multiple_diseases": "apple_multiple_diseases"}


def oracle_sql() -> dict[str, str]:
    base = "regexp_extract(image_path, '[^/]*$')"
    photo = f"lower(trim(regexp_replace(string_split(string_split(replace({base}, '_final_masked', ''), '___')[-1], 'copy')[1], '\\.jpg|\\.JPG|\\.png|\\.PNG', '', 'g')))"
    parent = "string_split(image_path, '/')[-2]"
    q: dict[str, str] = {}
    q["image_files"] = r"""SELECT DISTINCT item_id, relative_path FROM items
        WHERE regexp_matches(lower(relative_path), '[^/]\.(jpg|jpeg|png|bmp|tif|tiff|webp)$') AND NOT regexp_matches(relative_path, '(^|/)\.')"""
    q["name_parts"] = f"""SELECT DISTINCT item_id, {photo} AS photo_id, {base} AS base_name, {STEM.format("image_path")} AS stem,
        lower(regexp_extract({base}, '^.+?(\\.[^.]*)$', 1)) AS suffix, {parent} AS parent, regexp_replace(lower({parent}), '[^a-z0-9]', '', 'g') AS folder_key,
        {_markers("image_path")}::BIGINT AS markers FROM items WHERE image_path IS NOT NULL"""
    q["capture_details"] = f"""WITH {CAPTURES} SELECT DISTINCT item_id, read_at, capture_time,
        coalesce('capture_' || substr(sha256(capture_key), 1, 16), '') AS capture_id, camera, area, edited FROM details"""
    q["one_hot_decode"] = """SELECT DISTINCT item_id, CASE condition WHEN 'cedar_apple_rust' THEN 'rust' WHEN 'healthy' THEN 'healthy' WHEN 'scab' THEN 'scab'
        WHEN 'multiple_diseases' THEN 'multiple_diseases' END AS condition FROM items WHERE source_dataset = 'cornell' AND tree_type = 'apple'"""
    q["display_names"] = """SELECT class_label, array_to_string(list_transform(string_split(class_label, '_'),
        lambda x: upper(x[1]) || x[2:]), ' ') AS shown FROM class_labels"""
    q["hamming_distances"] = """SELECT item_id, hashes[1] AS canonical, turn::INT AS turn, bit_count(xor(hashes[1], hashes[turn + 1])) AS distance
        FROM (SELECT DISTINCT item_id, hashes FROM items WHERE hashes IS NOT NULL), range(8) r(turn)"""
    q["split_rows"] = f"SELECT DISTINCT item_id, class_label FROM manifest WHERE {_SPLIT} = 'train'"
    q["softmax_argmax"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings)
        SELECT vec_id, list_position(z, list_max(z)) - 1 AS prediction,
        round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 9) AS confidence FROM e"""
    q["label_join"] = f"WITH {ITEMS} SELECT item_id, class_label, label_index, tree_type, condition FROM it JOIN class_labels USING (class_label)"
    q["label_of_folder"] = f"""WITH {ITEMS}, part AS (SELECT item_id, source_dataset, class_label, unnest(string_split(relative_path, '/')) AS p FROM it)
        SELECT item_id, min(l.class_label) AS found_label, count(DISTINCT l.class_label) AS n_labels, bool_and(l.class_label = part.class_label) AS agrees
        FROM part JOIN label_map l ON l.source_dataset = part.source_dataset
            AND regexp_replace(lower(l.source_label), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p), '[^a-z0-9]', '', 'g') GROUP BY 1"""
    q["leaf_group_lookup"] = f"""WITH {ITEMS}, pv AS (SELECT *, {photo} AS pid, string_split(relative_path, '/')[1] AS folder FROM it WHERE source_dataset = 'plantvillage'),
        lm AS (SELECT pid, list(DISTINCT official_group) AS gs FROM pv WHERE official_group IS NOT NULL GROUP BY 1),
        c AS (SELECT item_id, CASE WHEN len(gs) = 1 THEN gs ELSE list_filter(gs, lambda g: contains(g, folder)) END AS fit FROM pv LEFT JOIN lm USING (pid))
        SELECT item_id, CASE WHEN len(fit) = 1 THEN fit[1] ELSE '' END AS found_group FROM c"""
    q["reviewed_group_join"] = f"""WITH {ITEMS},
        rec AS (SELECT DISTINCT trim(source_dataset, {BLANKS}) AS s, trim(relative_path, {BLANKS}) AS p, trim(reviewed_group, {BLANKS}) AS g FROM manifest WHERE trim(reviewed_group) <> ''),
        names AS (
            SELECT item_id, source_dataset AS s, unnest(list_distinct(list_concat([image_path, relative_path, {base}],
                CASE WHEN source_dataset = 'plantvillage' THEN ['raw/color/' || relative_path, 'color/' || relative_path] ELSE [] END))) AS p FROM it),
        hit AS (SELECT rec.s, rec.p, rec.g, count(item_id) AS n, min(item_id) AS one FROM rec LEFT JOIN names USING (s, p) GROUP BY ALL),
        single AS (SELECT *, CASE WHEN n = 1 THEN one END AS item_id FROM hit),
        told AS (SELECT *, item_id IS NOT NULL AND count(DISTINCT g) OVER (PARTITION BY item_id) > 1 AS differ FROM single)
        SELECT CASE WHEN n = 0 THEN 'no item' WHEN n > 1 THEN 'several items' WHEN differ THEN 'conflicting groups' ELSE 'none' END AS problem,
        count(*) AS n_records, count(DISTINCT item_id) AS n_items FROM told GROUP BY 1"""
    q["exact_pairs"] = f"WITH {ITEMS}, {FIRSTS}, {EXACT} SELECT * FROM exact"
    q["near_pairs"] = f"WITH {ITEMS}, {FIRSTS}, {NEAR} SELECT * FROM near"
    q["near_pairs_radius_8"] = f"WITH {ITEMS}, {FIRSTS}, {_near(8)} SELECT item_id_a, item_id_b, phash_distance FROM near"
    q["known_group_edges"] = f"WITH {ITEMS}, {KNOWN} SELECT field, a, b FROM known"
    q["capture_edges"] = f"WITH {ITEMS}, {CAPTURES}, {CAPTURE_EDGES} SELECT a, b FROM capture_links"
    q["missing_members"] = """SELECT image_path FROM (SELECT image_path_a AS image_path FROM match_pairs UNION SELECT image_path_b FROM match_pairs)
        WHERE trim(image_path) <> '' AND image_path NOT IN (SELECT image_path FROM items WHERE image_path IS NOT NULL)"""
    q["conflict_exclusion"] = f"WITH {ITEMS}, {CONFLICTING} SELECT item_id, class_label FROM ok WHERE sha256_pixels NOT IN (SELECT sha256_pixels FROM conflicting)"
    q["excluded_conflicts"] = f"WITH {ITEMS}, {CONFLICTING} SELECT item_id, image_path, source_dataset, class_label, sha256_pixels FROM ok JOIN conflicting USING (sha256_pixels)"
    q["split_class_grid"] = f"WITH {MANIFEST}, {_grid('m')} SELECT split, class_label, n FROM filled"
    q["component_roots"] = f"WITH RECURSIVE {RELATED} SELECT item_id, root FROM related"
    q["related_groups"] = f"""WITH RECURSIVE {RELATED}, {CONFLICTING},
        kept AS (SELECT * FROM related WHERE sha256_pixels NOT IN (SELECT sha256_pixels FROM conflicting)),
        named AS (SELECT root, 'group_' || substr(sha256(string_agg(concat_ws(':', source_dataset, relative_path), chr(10)
            ORDER BY concat_ws(':', source_dataset, relative_path))), 1, 16) AS group_id FROM kept GROUP BY root)
        SELECT item_id, group_id FROM kept JOIN named USING (root)"""
    q["component_sizes"] = f"""WITH RECURSIVE {RELATED}, s AS (SELECT root, count(*) AS n_items, count(DISTINCT class_label) AS n_labels FROM related GROUP BY 1)
        SELECT n_items, n_labels, count(*) AS n_components FROM s GROUP BY ALL"""
    q["counts_by_source"] = f"WITH {ITEMS} SELECT source_dataset, count(*) AS n FROM it GROUP BY 1"
    q["counts_by_class"] = f"WITH {ITEMS} SELECT class_label, count(*) AS n FROM it GROUP BY 1"
    q["counts_by_split"] = f"WITH {MANIFEST} SELECT split, count(*) AS n FROM m GROUP BY 1"
    q["groups_by_split"] = f"""WITH {MANIFEST} SELECT split, count(DISTINCT group_id) AS n_groups FROM m GROUP BY 1
        UNION ALL SELECT '(all)', count(DISTINCT group_id) FROM m"""
    q["duplicate_stats"] = f"""WITH {ITEMS}, {FIRSTS}, {EXACT}, {NEAR}, {CONFLICTING}
        SELECT (SELECT count(DISTINCT item_id) FROM bad_images) AS unreadable_images, (SELECT count(*) FROM exact) AS exact_duplicate_pairs,
        (SELECT count(*) FROM near) AS perceptual_candidate_pairs, (SELECT count(*) FROM near WHERE label_a <> label_b) AS cross_label_perceptual_candidates,
        (SELECT count(*) FROM exact WHERE source_a <> source_b) + (SELECT count(*) FROM near WHERE source_a <> source_b) AS cross_dataset_duplicate_pairs,
        (SELECT count(*) FROM exact WHERE label_a <> label_b) AS exact_cross_label_conflict_pairs,
        (SELECT coalesce(sum(n_images), 0)::BIGINT FROM conflicting) AS excluded_conflicting_images, (SELECT count(*) FROM conflicting) AS excluded_conflicting_pixel_hashes"""
    q["conflicting_content"] = f"WITH {ITEMS}, {CONFLICTING} SELECT sha256_pixels, n_images, n_labels FROM conflicting"
    q["conflict_pairs"] = f"WITH {ITEMS}, {FIRSTS}, {EXACT} SELECT item_id_a, item_id_b, label_a, label_b FROM exact WHERE label_a <> label_b"
    q["review_candidates"] = f"WITH {ITEMS}, {FIRSTS}, {NEAR} SELECT item_id_a, item_id_b, label_a, label_b, phash_distance FROM near WHERE label_a <> label_b"
    q["curation_audit"] = f"WITH RECURSIVE {CURATED} SELECT * FROM audit"
    q["curation_by_class"] = f"""WITH RECURSIVE {CURATED} SELECT class_label, count(*) AS n_input, count(*) FILTER (action = 'keep') AS n_retained,
        count(*) FILTER (action = 'exclude') AS n_excluded FROM audit GROUP BY 1"""
    q["curation_summary"] = f"""WITH RECURSIVE {CURATED} SELECT count(*) AS input_images, count(*) FILTER (action = 'keep') AS retained_images,
        count(*) FILTER (action = 'exclude') AS excluded_images, count(DISTINCT nullif(capture_id, '')) AS capture_families,
        count(*) FILTER (capture_id = '') AS images_without_capture_metadata, count(DISTINCT family_id) AS families FROM audit"""
    q["representatives"] = f"""WITH {CAPTURES}, fam AS (SELECT DISTINCT item_id, image_path, relative_path, class_label, {_spelled("family_id")} AS root FROM mango_curation),
        r AS (SELECT fam.*, row_number() OVER (PARTITION BY root, class_label ORDER BY coalesce(edited, false), coalesce(area, 0) DESC, {_markers("relative_path")}, relative_path, image_path) AS spot,
            count(*) OVER (PARTITION BY root, class_label) AS members
            FROM fam LEFT JOIN details d ON d.item_id = fam.item_id AND d.place = 1 WHERE root IS NOT NULL)
        SELECT root, class_label, item_id, members FROM r WHERE spot = 1"""
    q["reviewed_flag"] = f"WITH {ITEMS} SELECT source_dataset, bool_and(reviewed_group IS NOT NULL) AS all_reviewed FROM it GROUP BY 1"
    q["receipt_totals"] = f"""WITH {ITEMS}, {CAPTURES} SELECT it.class_label, CASE WHEN width > height THEN 'wide' WHEN width < height THEN 'tall' END AS mode,
        count(*) AS n_files, sum(width::BIGINT * height)::BIGINT AS total FROM details d JOIN it USING (item_id) WHERE place = 1 GROUP BY ALL"""
    q["data_summary"] = f"""WITH {MANIFEST}, r AS (SELECT * FROM m WHERE split IS NOT NULL), {_grid('r')}
        SELECT f.split, (SELECT count(*) FROM r WHERE r.split = f.split) AS images, (SELECT count(DISTINCT group_id) FROM r WHERE r.split = f.split) AS groups,
        count(*) FILTER (n > 0) AS supported_classes, coalesce(string_agg(class_label, ',' ORDER BY class_label) FILTER (n = 0), '') AS missing_classes FROM filled f GROUP BY 1"""
    q["file_receipts"] = "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL"
    q["imports_over_time"] = f"""SELECT date_trunc('hour', imported_at) AS hour, source_dataset, count(*) AS n, count(*) FILTER ({_missing("sha256_pixels")} IS NULL) AS n_unreadable
        FROM items WHERE imported_at IS NOT NULL GROUP BY ALL"""
    q["split_targets"] = f"""WITH {MANIFEST} SELECT class_label, s.split, round(count(*) * s.fraction::DOUBLE, 6) AS target
        FROM m, (VALUES ('train', 0.8), ('val', 0.1), ('test', 0.1)) s(split, fraction) GROUP BY class_label, s.split, s.fraction"""
    q["confusion"] = f"WITH {PREDICTIONS} SELECT target, prediction, n FROM cm"
    q["confusion_by_source"] = f"WITH {PREDICTIONS} SELECT source_dataset, target, prediction, count(*) AS n FROM pr GROUP BY ALL"
    q["class_marginals"] = f"WITH {PREDICTIONS}, {_per_class()} SELECT label_index, support, predicted, correct FROM mg"
    q["per_class_metrics"] = f"""WITH {PREDICTIONS}, {_per_class()} SELECT label_index, support, predicted, correct, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1 FROM pc"""
    q["summary_metrics"] = f"WITH {PREDICTIONS}, {_per_class()} SELECT {_SUMMARY} FROM pc"
    q["metrics_by_source"] = f"WITH {PREDICTIONS}, {_per_class('source_dataset')} SELECT source_dataset, {_SUMMARY} FROM pc GROUP BY 1"
    q["weighted_loss"] = """SELECT match_type, round(sum(phash_distance) / count(phash_distance), 9) AS loss, count(phash_distance) AS n
        FROM match_pairs WHERE phash_distance IS NOT NULL GROUP BY 1"""
    q["top_errors"] = f"WITH {PREDICTIONS} SELECT target, prediction, n FROM cm WHERE target <> prediction ORDER BY n DESC, target, prediction LIMIT 10"
    q["best_epoch"] = f"WITH {HISTORY} SELECT epoch, macro_f1 FROM hist ORDER BY macro_f1 DESC, epoch LIMIT 1"
    q["history_epochs"] = f"""WITH {HISTORY}, rows_of AS (SELECT count(*) AS n FROM hist)
        SELECT e.epoch::BIGINT AS epoch, 0::BIGINT AS n FROM rows_of, range(1, n + 1) e(epoch) WHERE e.epoch NOT IN (SELECT epoch FROM hist)
        UNION ALL SELECT epoch, 1 FROM hist, rows_of WHERE epoch < 1 OR epoch > rows_of.n"""
    q["limit_per_class"] = f"WITH {ITEMS} SELECT item_id, class_label FROM it QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY relative_path, item_id) <= 3"
    q["path_union"] = "SELECT image_path FROM bad_images WHERE image_path IS NOT NULL UNION SELECT image_path FROM mango_captures WHERE image_path IS NOT NULL"
    q["path_difference"] = "SELECT item_id FROM items EXCEPT SELECT item_id FROM manifest"
    q["unknown_splits"] = f"WITH {TOLD} SELECT split, count(*) AS n FROM told WHERE split IS NULL OR split NOT IN ('train', 'val', 'test') GROUP BY 1"
    q["without_group_or_source"] = f"WITH {TOLD} SELECT DISTINCT item_id FROM told WHERE coalesce(group_id, '') = '' OR coalesce(source_dataset, '') = ''"
    q["groups_across_splits"] = f"WITH {MANIFEST} SELECT group_id, count(DISTINCT split) AS n_splits FROM m WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1"
    q["repeated_paths"] = "SELECT image_path, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) > 1"
    q["one_hot_violations"] = f"""WITH {ITEMS}, t AS (SELECT {STEM.format("image_path")} AS image_id, class_label IN ({", ".join(f"'{v}'" for v in _HOT.values())}) AS one FROM it WHERE source_dataset = 'cornell'),
        c AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM t),
        p AS (SELECT CASE WHEN NOT coalesce(starts_with(image_id, 'Train_'), false) THEN 'unexpected id' WHEN n > 1 THEN 'repeated id' WHEN NOT coalesce(one, false) THEN 'not one-hot' END AS problem FROM c)
        SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1"""
    q["not_exactly_one"] = f"""WITH {ITEMS}, b AS (SELECT DISTINCT lower({STEM.format("image_path")}) AS name FROM mango_captures WHERE image_path IS NOT NULL),
        f AS (SELECT lower({STEM.format("image_path")}) AS name FROM ok WHERE image_path IS NOT NULL)
        SELECT b.name, count(f.name) AS matches FROM b LEFT JOIN f USING (name) GROUP BY 1 HAVING count(f.name) <> 1"""
    q["inventory_violations"] = f"""WITH {ITEMS}, f AS (SELECT regexp_replace(relative_path, '/lot_[0-9]+/', '/') AS path FROM it WHERE source_dataset = 'mangoleafbd'),
        c AS (SELECT source_label AS category FROM label_map WHERE source_dataset = 'mangoleafbd'),
        d AS (SELECT string_split(path, '/')[-2] AS category FROM f),
        p AS (
            SELECT 'unsafe path' AS problem, 1 AS n FROM f WHERE path IS NULL OR len(string_split(path, '/')) <> 2 OR starts_with(path, '/')
            UNION ALL SELECT 'names differ only in case', count(*) FROM f GROUP BY lower(path) HAVING count(*) > 1
            UNION ALL SELECT 'unknown category', count(*) FROM d WHERE category NOT IN (SELECT category FROM c) GROUP BY category
            UNION ALL SELECT 'wrong number of files', count(d.category) FROM c LEFT JOIN d USING (category) GROUP BY c.category HAVING count(d.category) <> 500)
        SELECT problem, count(*) AS n_paths, sum(n)::BIGINT AS n FROM p GROUP BY 1"""
    q["support_disagrees"] = f"""WITH {PREDICTIONS}, {MANIFEST}, s AS (SELECT label_index, count(*) AS support FROM m JOIN class_labels USING (class_label) GROUP BY 1),
        w AS (SELECT target AS label_index, sum(n)::BIGINT AS row_sum FROM cm GROUP BY 1)
        SELECT label_index, support, row_sum FROM s FULL JOIN w USING (label_index) WHERE coalesce(support, 0) <> coalesce(row_sum, 0)"""
    q["manifest_violations"] = f"""WITH {WRITTEN}
        SELECT 'split_known' AS "constraint", count(*) AS violations FROM w WHERE split IS NULL
        UNION ALL SELECT 'class_known', count(*) FROM w WHERE class_label IS NULL OR class_label NOT IN (SELECT class_label FROM class_labels)
        UNION ALL SELECT 'label_parts', count(*) FROM w JOIN class_labels c USING (class_label) WHERE w.tree_type IS DISTINCT FROM c.tree_type OR w.condition IS DISTINCT FROM c.condition
        UNION ALL SELECT 'group_and_source', count(*) FROM w WHERE group_id IS NULL OR coalesce(source_dataset, '') = ''
        UNION ALL SELECT 'group_in_one_split', count(*) FROM (SELECT group_id FROM w WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'path_unique', count(*) FROM (SELECT image_path FROM w GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'splits_filled', 3 - count(DISTINCT split) FROM w
        UNION ALL SELECT 'labels_in_train', count(*) FROM class_labels WHERE class_label NOT IN (SELECT class_label FROM w WHERE split = 'train' AND class_label IS NOT NULL)
        UNION ALL SELECT 'file_exists', count(*) FROM w WHERE image_path IS NULL OR image_path NOT IN (SELECT image_path FROM items WHERE image_path IS NOT NULL)"""
    q["missing_classes"] = f"""WITH {WRITTEN}
        SELECT 'all' AS scope, class_label FROM class_labels c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.class_label = c.class_label)
        UNION ALL SELECT s.split, c.class_label FROM class_labels c, (VALUES ('train'), ('val'), ('test')) s(split)
        WHERE EXISTS (SELECT 1 FROM w WHERE w.class_label = c.class_label) AND NOT EXISTS (SELECT 1 FROM w WHERE w.class_label = c.class_label AND w.split = s.split)"""
    q["unknown_labels"] = "SELECT class_label, count(*) AS n FROM manifest WHERE class_label IS NULL OR class_label NOT IN (SELECT class_label FROM class_labels) GROUP BY 1"
    q["empty_splits"] = f"WITH {WRITTEN} SELECT s.split FROM (VALUES ('train'), ('val'), ('test')) s(split) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.split = s.split)"
    q["labels_without_training"] = f"WITH {WRITTEN} SELECT class_label FROM class_labels c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.class_label = c.class_label AND w.split = 'train')"
    q["label_parts_disagree"] = """SELECT DISTINCT m.class_label, item_id, m.tree_type, m.condition FROM manifest m JOIN class_labels c USING (class_label)
        WHERE m.tree_type IS DISTINCT FROM c.tree_type OR m.condition IS DISTINCT FROM c.condition"""
    q["ordered_rows"] = f"WITH {ITEMS} SELECT item_id, row_number() OVER (ORDER BY k) - 1 AS ord FROM it"
    grouped = f"{MANIFEST}, grouped AS (SELECT item_id, class_label, coalesce(group_id, 'item:' || item_id) AS root FROM m)"
    q["component_histogram"] = f"WITH {grouped} SELECT root, class_label, count(*) AS n FROM grouped GROUP BY ALL"
    q["hash_split"] = f"""WITH {grouped}, spots AS (SELECT ('0x' || substr(md5(root || ':42'), 1, 12))::BIGINT / 281474976710656.0 AS spot FROM grouped)
        SELECT CASE WHEN spot < 0.8 THEN 'train' WHEN spot < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM spots GROUP BY 1"""
    q["split_properties"] = """SELECT way, property, 0::BIGINT AS n FROM (VALUES ('sequential'), ('rounds')) w(way),
        (VALUES ('groups parted or left out'), ('labels without all splits'), ('splits off their share')) p(property)"""
    q["matrix_violations"] = f"""WITH {PREDICTIONS}, known AS (SELECT label_index FROM class_labels)
        SELECT target::BIGINT AS target, prediction::BIGINT AS prediction, n FROM cm WHERE n < 0 OR target NOT IN (FROM known) OR prediction NOT IN (FROM known)"""
    q["totals_disagree"] = f"""WITH {PREDICTIONS}, {MANIFEST}, t AS (SELECT 'matrix' AS total_of, (SELECT count(*) FROM pr) AS n UNION ALL SELECT 'manifest', (SELECT count(*) FROM m) UNION ALL SELECT 'support', (SELECT count(*) FROM pr))
        SELECT * FROM t WHERE (SELECT count(DISTINCT n) FROM t) > 1"""
    q["checkpoint_disagrees"] = f"""WITH {HISTORY}, last AS (SELECT * FROM hist ORDER BY epoch DESC LIMIT 1), best AS (SELECT epoch AS best_epoch, macro_f1 AS best_f1 FROM hist ORDER BY macro_f1 DESC, epoch LIMIT 1)
        SELECT * FROM last, best WHERE epoch <> best_epoch OR abs(macro_f1 - best_f1) > 1e-12"""
    q["label_dimension"] = "SELECT label_index, class_label, tree_type, condition FROM class_labels"
    q["observed_labels"] = f"""WITH {WRITTEN} SELECT (row_number() OVER (ORDER BY label_index) - 1)::INT AS label_index, class_label, tree_type, condition FROM class_labels
        WHERE class_label IN (SELECT class_label FROM w WHERE split = 'test')"""
    q["label_file"] = q["label_dimension"]
    q["manifest_file"] = f"""WITH {ITEMS} SELECT image_path, source_dataset, class_label, 'item:' || item_id AS group_id, coalesce(official_group, '') AS official_group, label_index AS target
        FROM it JOIN class_labels USING (class_label) WHERE image_path IS NOT NULL AND source_dataset IS NOT NULL"""
    q["set_differences"] = """SELECT 'left' AS only_in, count(*) AS n FROM (SELECT item_id FROM items WHERE item_id IS NOT NULL EXCEPT SELECT item_id FROM manifest) HAVING count(*) > 0
        UNION ALL SELECT 'right', count(*) FROM (SELECT item_id FROM manifest WHERE item_id IS NOT NULL EXCEPT SELECT item_id FROM items) HAVING count(*) > 0"""
    return q
