import csv
import hashlib
import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllo import labels as L
from phyllo.functions import images as I
from phyllo.operators.checks import ConstraintError
from phyllo.sources import images, importers, tables

from .conftest import rows_of


def picture(seed, side=24):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 255, (6, 6, 3))
    return np.kron(coarse, np.ones((side // 6, side // 6, 1))).astype(np.uint8)


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_listing(spark, tmp_path):
    for name in ("a/x.JPG", "a/.hid/y.jpg", "b.tiff", ".z.png", "c.txt", "d.webp", "e/f/g.jpeg"):
        put(f"{tmp_path}/{name}")
    assert rows_of(images.find_images(spark, str(tmp_path)), "relative_path") == [("a/x.JPG",), ("b.tiff",), ("d.webp",), ("e/f/g.jpeg",)]


def test_png_round_trip_and_filters():
    rgb = picture(1)
    assert (I.decode(I.encode_png(rgb)) == rgb).all()
    import zlib

    for kind in range(5):
        h, w, _ = rgb.shape
        flat = rgb.reshape(h, -1).astype(int)
        lines = []
        for y in range(h):
            out = []
            for x in range(w * 3):
                a = flat[y, x - 3] if x >= 3 else 0
                b = flat[y - 1, x] if y else 0
                c = flat[y - 1, x - 3] if y and x >= 3 else 0
                p = a + b - c
                guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][kind]
                out.append((flat[y, x] - guess) % 256)
            lines.append(bytes([kind, *out]))
        good = I.encode_png(rgb)
        head = good[: 8 + 25]
        body = zlib.compress(b"".join(lines))
        data = head + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + good[-12:]
        assert (I.decode(data) == rgb).all(), kind


def test_hashes_of_turned_pictures_agree():
    rgb = picture(3)
    first = I.orientation_hashes(rgb)
    # Rounding between the two passes of the resampling differs if rows and columns change places.
    for form, most in ((rgb[:, ::-1], 0), (rgb[::-1], 0), (np.rot90(rgb, 2), 0), (np.rot90(rgb), 8), (rgb.transpose(1, 0, 2), 8)):
        other = I.orientation_hashes(np.ascontiguousarray(form))
        assert min(bin((h ^ first[0]) & (1 << 64) - 1).count("1") for h in other) <= most
    assert I.pixel_hash(rgb) == hashlib.sha256(b"(24, 24)" + rgb.tobytes()).hexdigest()
    assert (I.upright(I.upright(rgb, 6), 8) == rgb).all() and (I.upright(I.upright(rgb, 5), 5) == rgb).all()


def jpeg_with_exif(make=b"Cam\0", time=b"2020:01:02 03:04:05\0", software=b"GIMP 2.10\0", order="<"):
    tags = [(271, make), (305, software), (36867, time)]
    main, sub = tags[:2], tags[2:]
    at = 8 + 2 + 12 * (len(main) + 1) + 4
    blob, entries = b"", []
    for tag, text in main:
        entries.append(struct.pack(order + "HHII", tag, 2, len(text), at + len(blob)) if len(text) > 4 else struct.pack(order + "HHI4s", tag, 2, len(text), text))
        blob += text if len(text) > 4 else b""
    block = at + len(blob)
    entries.append(struct.pack(order + "HHII", 34665, 4, 1, block))
    sub_text = block + 2 + 12 + 4
    tail = struct.pack(order + "H", 1) + struct.pack(order + "HHII", sub[0][0], 2, len(sub[0][1]), sub_text) + b"\0\0\0\0" + sub[0][1]
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + blob + tail
    exif = b"Exif\0\0" + body
    sof = struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\x01\x11\x00"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + sof + b"\xff\xd9"


def test_exif(spark):
    for order in "<>":
        got = I.read_exif(jpeg_with_exif(order=order))
        assert got == {"make": "Cam", "software": "GIMP 2.10", "capture_time": "2020:01:02 03:04:05", "width": 40, "height": 30}
    for broken in (b"", b"\xff\xd8", jpeg_with_exif()[:30], b"\xff\xd8\xff\xe1\x00\x10Exif\0\0XX"):
        assert isinstance(I.read_exif(broken), dict)
    df = spark.createDataFrame([("a", bytearray(jpeg_with_exif())), ("b", None)], "image_path string, content binary")
    assert rows_of(images.capture_metadata(df), "image_path", "make", "width") == [("a", "Cam", 40), ("b", None, None)]


def test_fingerprints_report_unreadable_files(spark):
    rgb = picture(5)
    df = spark.createDataFrame([("a", bytearray(I.encode_png(rgb))), ("b", bytearray(b"no picture")), ("c", bytearray(I.encode_png(rgb)[:60])), ("d", None)], "image_path string, content binary")
    good, bad = images.fingerprints(df)
    r = good.collect()
    assert [x.image_path for x in r] == ["a"] and len(r[0].hashes) == 8 and r[0].sha256_pixels == I.pixel_hash(rgb)
    assert rows_of(bad.where("error <> ''"), "image_path") == [("b",), ("c",), ("d",)]


def test_leaf_groups(spark):
    files = spark.createDataFrame([("/Apple___scab/a.jpg", "Apple___scab"), ("/Apple___scab/b.jpg", "Apple___scab"), ("/Apple___scab/c.jpg", "Apple___scab"), ("/Apple___scab/d.jpg", "Apple___scab"), ("/x/none.jpg", "x")], "image_path string, folder string")
    path_map = spark.createDataFrame([("a", ["Peach:1"]), ("b", ["Apple___scab:1", "Peach:2"]), ("c", ["Apple___scab:1", "Apple___scab:2"]), ("d", ["Apple___scab:1", "Apple___scab:1"])], "photo_id string, groups array<string>")
    got = dict(rows_of(importers.leaf_groups(files, path_map), "image_path", "found_group"))
    assert [got[f"/Apple___scab/{x}.jpg"] for x in "abcd"] == ["Peach:1", "Apple___scab:1", "", "Apple___scab:1"] and got["/x/none.jpg"] == ""


def test_reviewed_groups(spark, make_items):
    items = make_items({"name": "x/1.jpg"}, {"name": "y/1.jpg"}, {"name": "z/2.jpg", "source": "plantvillage"})
    def review(*rows):
        return spark.createDataFrame(rows, "source_dataset string, image_path string, group_id string")
    cases = [(("a", "1.jpg", "g"), "several items"), (("a", "x/1.jpg ", "g"), "none"), (("plantvillage", "raw/color/z/2.jpg", "g"), "none"), (("a", "/d/y/1.jpg", " "), "empty group"), (("b", "x/1.jpg", "g"), "no item")]
    for row, problem in cases:
        assert importers.match_reviewed(items, review(row)).first().problem == problem, row
    differ = review(("a", "x/1.jpg", "g"), ("a", "/d/x/1.jpg", "h"))
    assert {r.problem for r in importers.match_reviewed(items, differ).collect()} == {"conflicting groups"}
    done = importers.apply_reviewed(items, review(("a", "x/1.jpg", "g"), ("a", "/d/x/1.jpg", "g")))
    assert rows_of(done, "item_id", "reviewed_group") == [(0, "g"), (1, None), (2, None)]
    with pytest.raises(ConstraintError):
        importers.apply_reviewed(items, review(("b", "x", "g")))


def test_one_hot_source(spark, tmp_path):
    put(f"{tmp_path}/w/images/Train_0.jpg")
    for name in ("Train_1.jpg", "Test_0.jpg"):
        put(f"{tmp_path}/w/images/{name}")
    def table(*rows):
        with open(f"{tmp_path}/w/train.csv", "w", encoding="utf-8-sig") as f:
            csv.writer(f).writerows([("image_id", "healthy", "multiple_diseases", "rust", "scab"), *rows])
    mapping = L.label_map(spark)
    table(("Train_0", 0, 0, 1, 0), ("Train_1", 1, 0, 0, 0))
    got = importers.import_one_hot(spark, str(tmp_path), mapping, "cornell")
    assert rows_of(got, "relative_path", "class_label") == [("images/Train_0.jpg", "apple_cedar_apple_rust"), ("images/Train_1.jpg", "apple_healthy")]
    table(("Train_0", 0, 0, 1, 0), ("Train_7", 1, 0, 0, 0))
    with pytest.raises(ConstraintError):
        importers.import_one_hot(spark, str(tmp_path), mapping, "cornell")


def test_folder_sources(spark, tmp_path):
    put(f"{tmp_path}/m/wrap/Die Back/1.jpg")
    put(f"{tmp_path}/m/wrap/gall-midge/2.jpg")
    mapping = L.label_map(spark)
    got = importers.import_ancestors(spark, f"{tmp_path}/m", mapping, "mangoleafbd")
    assert rows_of(got, "relative_path", "class_label") == [("wrap/Die Back/1.jpg", "mango_dieback"), ("wrap/gall-midge/2.jpg", "mango_gall_midge")]
    put(f"{tmp_path}/m/other/3.jpg")
    with pytest.raises(ConstraintError):
        importers.import_ancestors(spark, f"{tmp_path}/m", mapping, "mangoleafbd")
    put(f"{tmp_path}/p/Apple___healthy/k___a copy.JPG")
    put(f"{tmp_path}/p/unknown/b.jpg")
    with open(f"{tmp_path}/map.json", "w") as f:
        json.dump({"a": "leaf 1", "b": ["x", "y"]}, f)
    got = importers.import_folders(spark, f"{tmp_path}/p", mapping, "plantvillage", importers.read_leaf_map(spark, f"{tmp_path}/map.json"))
    assert rows_of(got, "class_label", "official_group") == [("apple_healthy", "leaf 1")]


def test_picture_root_and_csv_inventory(spark, tmp_path):
    put(f"{tmp_path}/r/raw/color/Apple___healthy/a.jpg")
    put(f"{tmp_path}/r/raw/segmented/Apple___healthy/a.jpg")
    assert importers.picture_root(f"{tmp_path}/r", ["Apple___healthy"]) == f"{tmp_path}/r/raw/color"
    assert importers.picture_root(f"{tmp_path}/r/raw/color", ["Apple___healthy"]) == f"{tmp_path}/r/raw/color"
    for bad in (f"{tmp_path}/r/raw/segmented", str(tmp_path)):
        with pytest.raises(ValueError):
            importers.picture_root(bad, ["Apple___healthy"])
    put(f"{tmp_path}/c/x/t.csv", "\ufeffid,v\r\n1,2\r\n,\r\n\r\n3,4".encode())
    put(f"{tmp_path}/c/e.csv", b"\n")
    assert rows_of(importers.csv_inventory(spark, f"{tmp_path}/c"), "header", "n_rows") == [("", 0), ("id,v", 2)]


def test_limits_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"c{i % 3}", f"{i * 7 % 50:02}") for i in range(50)], "id long, c string, p string")
    got = importers.limit_per_category(rows, "c", "p", 2, "id").collect()
    for c in ("c0", "c1", "c2"):
        assert sorted(r.p for r in got if r.c == c) == sorted(r.p for r in rows.collect() if r.c == c)[:2]
    with open(f"{tmp_path}/l.txt", "w") as f:
        f.write("raw/color/A/2.jpg\nraw/color/A/1.jpg\nraw/color/A/1.jpg\nraw/color/Z/1.jpg\nraw/grey/A/1.jpg\n\n")
    cats = spark.createDataFrame([("A",)], "category string")
    assert rows_of(importers.split_list_inventory(spark, [f"{tmp_path}/l.txt"], cats, 1), "path") == [("raw/color/A/1.jpg",)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "", "x"), ("a", 'q"1,', "y")], "k string, v string, extra string")
    tables.write_csv(df, f"{tmp_path}/o", ("k", "v"), ("k",))
    part = [p for p in os.listdir(f"{tmp_path}/o") if p.startswith("part")]
    with open(f"{tmp_path}/o/{part[0]}") as f:
        assert list(csv.reader(f, escapechar="\\")) == [["k", "v"], ["a", 'q"1,'], ["b", ""]]
    tables.write_csv(df.limit(0), f"{tmp_path}/e", ("k", "v"))
    assert open(f"{tmp_path}/e/{[p for p in os.listdir(f'{tmp_path}/e') if p.startswith('part')][0]}").read() == "k,v\n"
    tables.write_json(spark, f"{tmp_path}/x.json", {"a": "é"})
    tables.write_json(spark, f"{tmp_path}/x.json", {"a": "é"})
    with pytest.raises(FileExistsError):
        tables.write_json(spark, f"{tmp_path}/x.json", {"a": 2})
    with pytest.raises(FileExistsError):
        tables.guard_output(spark, str(tmp_path))
    tables.guard_output(spark, f"{tmp_path}/new")
    with pytest.raises(ValueError):
        tables.write_csv(df, f"{tmp_path}/z", ("k", "nope"))


def test_archives(tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        z.writestr("r/A/1.jpg", b"1")
        z.writestr("r/skip.txt", b"2")
    got = tables.unpack(f"{tmp_path}/a.zip", f"{tmp_path}/out", lambda n: n.endswith(".jpg"))
    assert got == [{"path": "r/A/1.jpg", "bytes": 1, "sha256": hashlib.sha256(b"1").hexdigest()}]
    put(f"{tmp_path}/out/r/A/1.jpg", b"other")
    with pytest.raises(FileExistsError):
        tables.unpack(f"{tmp_path}/a.zip", f"{tmp_path}/out")
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w") as z:
        z.writestr("../evil.jpg", b"1")
    with pytest.raises(ValueError):
        tables.unpack(f"{tmp_path}/b.zip", f"{tmp_path}/out2")
    assert F is not None
