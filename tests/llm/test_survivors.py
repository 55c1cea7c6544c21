import datetime as dt
import random

import pytest

from phyllo.llm import survivors as S

CUR = "family_id string, class_label string, item_id long, relative_path string, sha256_pixels string, capture_id string, camera string"
CAP = "item_id long, read_at timestamp, make string, model string, capture_time string, software string, width int, height int"

#: File names and their copy marks.
COPIES = {"a.jpg": 0, "b copy.jpg": 1, "c (Custom) copy (2).jpg": 3, "d-7.jpg": 1, "e.jpg": 0}


def t(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def brute(curation, captures):
    """Survivor, layers and filled fields by peeling the undominated records."""
    read, latest = {}, {}
    for i, at, *values in sorted(captures, key=lambda r: (r[1] or dt.datetime.min, [str(x) for x in r[2:]])):
        latest[i] = max(latest.get(i, 0), at.year * 12 + at.month if at else 0)
        for f, v in zip(("make", "model", "capture_time", "software", "width", "height"), values):
            if v not in (None, ""):
                read.setdefault(i, {})[f] = v
    families = {}
    for fam, label, item, path, sha, capture, camera in curation:
        if fam and fam.strip() and item is not None:
            r = dict(read.get(item, {}), sha256_pixels=sha or None, capture_id=capture or None, camera=camera or None)
            edited = int(any(x in (r.get("software") or "").lower() for x in ("photo editor", "photoshop", "gimp")))
            area = (r.get("width") or 0) * (r.get("height") or 0)
            key = (fam.strip().lower(), label or "")
            families.setdefault(key, {})[item, path] = ((edited, area, COPIES[path.rsplit("/", 1)[-1]] if path else 0, latest.get(item, 0)), path or "\U0010ffff", item, r)
    out = {}
    for key, members in families.items():
        rest = list(members.values())
        layers = []
        while rest:
            def beats(p, q):
                return p[:3] != q[:3] and p[0] <= q[0] and p[1] >= q[1] and p[2] <= q[2] and p[3] >= q[3]
            top = [m for m in rest if not any(beats(o[0], m[0]) for o in rest)]
            layers.append(top)
            rest = [m for m in rest if m not in top]
        def policy(m):
            return (m[0][0], -m[0][1], m[0][2], m[1], m[2])
        row = {"item_id": min(layers[0], key=policy)[2], "n_layers": len(layers)}
        for f in S.FILLED:
            row[f] = next((min(ms, key=policy)[3][f] for layer in layers if (ms := [m for m in layer if m[3].get(f) is not None])), None)
        out[key] = row
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_peeling(spark, seed, clash):
    rng = random.Random(seed)
    names = list(COPIES)
    curation = []
    for i in range(120):
        fam = rng.choice(["F1", " f1", "f2", "hot", "hot", "hot", None, "", "f3"])
        curation.append((fam, rng.choice(["l1", "l2"]), i, f"{rng.randrange(3)}/{i % 40}/{rng.choice(names)}", rng.choice([None, "", "s%d" % i]), rng.choice([None, "", "c%d" % i]), rng.choice([None, "cam"])))
    captures = []
    for k in range(260):
        captures.append((rng.randrange(130), t(k), rng.choice(["m1", None, ""]), rng.choice(["x", None]), rng.choice(["2020:01:02 03:04:05", None]), rng.choice([None, "", "GIMP 2", "cam 1"]), rng.choice([None, 10, 20, 30]), rng.choice([None, 10, 20])))
    want = brute(curation, captures)
    got = S.survivors(clash(spark.createDataFrame(curation * 2, CUR)), clash(spark.createDataFrame(captures * 2, CAP))).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.family_id, r.class_label]
        assert r.item_id == w["item_id"] and r.n_layers == w["n_layers"]
        for f in S.FILLED:
            assert r[f] == w[f], (f, r, w)


def test_latest_non_missing_reading_counts_and_invalid_times_do_not(spark):
    rows = [(1, t(2), None, "b", "2020:13:01 00:00:00", " ", 5, None), (1, t(1), "M", "a", "2020:01:01 00:00:00", "gimp", None, 7), (1, None, "old", None, None, None, 1, 1)]
    r = S.latest_readings(spark.createDataFrame(rows, CAP)).first()
    assert (r.make, r.model, r.software, r.capture_time, r.width, r.height) == ("M", "b", "gimp", "2020:01:01 00:00:00", 5, 7)


def test_empty_and_unread(spark):
    none = spark.createDataFrame([], CAP)
    assert S.survivors(spark.createDataFrame([], CUR), none).count() == 0
    one = S.survivors(spark.createDataFrame([("f", None, 1, None, None, None, None)], CUR), none).first()
    assert (one.item_id, one.class_label, one.n_records) == (1, "", 1)
