import datetime as dt

from phyllo.operators import curate, relate

from .conftest import rows_of

READ = "item_id long, make string, model string, capture_time string, software string, width int, height int, read_at timestamp"
M = curate.CURATED_SOURCE


def readings(spark, *rows):
    out = [(r[0], *(r[1:] + (None,) * (7 - len(r))), dt.datetime(2020, 1, 1)) for r in rows]
    return spark.createDataFrame(out, READ)


def curated(spark, items, captures, *edges):
    details = curate.capture_details(curate.latest_captures(captures))
    mine = items.where(f"source_dataset = '{M}'")
    links = relate.links(curate.capture_edges(mine, details), *edges)
    return curate.curate(spark, relate.with_components(spark, items, links), details)


def test_same_capture_keeps_the_name_without_marks(spark, make_items):
    items = make_items({"name": "first (Custom) Copy (1).jpg"}, {"name": "first.jpg"}, source=M, label="mango_healthy")
    kept, audit = curated(spark, items, readings(spark, *((i, "Cam", "X", "2020:01:02 03:04:05", "", 10, 10) for i in (0, 1))))
    assert rows_of(kept, "item_id") == [(1,)]
    assert rows_of(audit, "item_id", "action", "representative_path") == [(0, "exclude", "/d/first.jpg"), (1, "keep", "/d/first.jpg")]
    assert audit.select("capture_id").distinct().count() == 1


def test_missing_and_invalid_times_never_link(spark, make_items):
    items = make_items(*({} for _ in range(6)), source=M)
    r = [(0,), (1,), (2, "c", "m", "0000:00:00 00:00:00"), (3, "c", "m", "0000:00:00 00:00:00"), (4, "c", "m", "2020:01:01 00:00:00"), (5, "d", "m", "2020:01:01 00:00:00")]
    kept, audit = curated(spark, items, readings(spark, *r))
    assert kept.count() == 6
    s = curate.curation_summary(audit).first()
    assert (s.images_without_capture_metadata, s.capture_families, s.families) == (4, 2, 6)


def test_capture_details(spark):
    r = [(0, " Cam\x00 ", "X  1", "2020:02:30 00:00:00"), (1, "CAM", "x 1", "2020:02:29 23:59:59", "Adobe PHOTOSHOP 3", 3, 4), (2, "cam", "X 1", "2020:02:29 23:59:59"), (3, None, "X", "2020:2:29 23:59:59", None, None, 9), (4, "a", "b", "2020:01:01 23:59:60")]
    d = {x.item_id: x for x in curate.capture_details(readings(spark, *r)).collect()}
    assert [d[i].capture_time for i in range(5)] == ["", "2020-02-29T23:59:59", "2020-02-29T23:59:59", "", ""]
    assert d[1].capture_id == d[2].capture_id != "" and d[0].capture_id == ""
    assert (d[0].camera, d[3].camera) == ("Cam | X 1", "X")
    assert d[1].edited and d[1].area == 12 and not d[2].edited and d[3].area == 0


def test_one_representative_per_label_of_a_family(spark, make_items):
    items = make_items({"label": "l1"}, {"label": "l1"}, {"label": "l2"}, {"label": "l2"}, source=M)
    kept, audit = curated(spark, items, readings(spark, *((i, "c", "m", "2020:01:01 00:00:00") for i in range(4))))
    assert rows_of(kept, "item_id", "root") == [(0, 0), (2, 0)]
    assert audit.select("family_id").distinct().count() == 1
    assert rows_of(curate.curation_by_class(audit)) == [("l1", 2, 1, 1), ("l2", 2, 1, 1)]


def test_removed_bridge_keeps_the_others_together(spark, make_items):
    """apple-a, mango-z and apple-b are linked; mango-a and mango-z are one capture."""
    items = make_items({"source": "x"}, {"source": M, "name": "z.jpg"}, {"source": "x"}, {"source": M, "name": "a.jpg"})
    links = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    kept, _ = curated(spark, items, readings(spark, *((i, "c", "m", "2020:01:01 00:00:00") for i in (1, 3))), links)
    assert rows_of(kept, "item_id", "root") == [(0, 0), (2, 0), (3, 0)]


def test_rank(spark, make_items):
    items = make_items({"name": "edited.jpg"}, {"name": "small.jpg"}, {"name": "best.jpg"}, {"name": "best Copy (2).jpg"}, source=M)
    r = readings(spark, (0, None, None, None, "GIMP 2", 400, 600), (1, None, None, None, "", 10, 10), (2, None, None, None, "", 100, 100), (3, None, None, None, None, 100, 100))
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    a = rows_of(curated(spark, items, r, links)[1])
    b = rows_of(curated(spark, items.orderBy("image_path").repartition(3), r.repartition(5), links)[1])
    assert a == b
    assert [x for x in a if "keep" in x][0][0] == 2


def test_nothing_to_curate(spark, make_items):
    items = make_items({}, {})
    kept, audit = curated(spark, items, readings(spark), spark.createDataFrame([(0, 1)], "a long, b long"))
    assert kept.count() == 2 and audit.count() == 0
    assert curate.curation_summary(audit).first().input_images == 0
