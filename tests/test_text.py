import re

import pytest
from pyspark.sql import functions as F

from phyllo.functions import text as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("value", ["  a b\t\n", " x　", "\x1c y \x1f", "", " \t", "é ", None])
def test_strip_is_that_of_python(spark, value):
    assert one(spark, X.strip("x"), value) == (value.strip() if value is not None else None)
    assert one(spark, X.missing_to_null("x"), value) == (value if value and value.strip() else None)


@pytest.mark.parametrize("value", ["a.jpg", "x/y.tar.GZ", ".hidden", "no", "a/.b/c.d.png", "d/", "x. y"])
def test_path_parts(spark, value):
    name = value.rsplit("/", 1)[-1]
    assert one(spark, X.base_name("x"), value) == name
    m = re.match(r"(?s)^(.+?)(\.[^.]*)$", name)
    if m:
        assert one(spark, X.stem("x"), value) == name[: -len(name.rsplit(".", 1)[1]) - 1]
    else:
        assert one(spark, X.stem("x"), value) == name


#: File names and how many marks of a copy they carry.
COPIES = {"best.jpg": 0, "best Copy (2).jpg": 2, "first (Custom) Copy (1).jpg": 3, "a_12(3) (4).png": 3, "20190715_181249.jpg": 0, "IMG_12345.jpg": 0, "x copy of copy-7.jpg": 3, "(1)(2).jpg": 2, "copyright 12.jpg": 1}


@pytest.mark.parametrize("path, marks", COPIES.items())
def test_copy_markers(spark, path, marks):
    assert one(spark, X.copy_markers("x"), path) == marks


def test_photo_id(spark):
    assert one(spark, X.photo_id("x"), "/r/Apple___scab/abc___FREC_Scab 3417 copy 2_final_masked.JPG") == "frec_scab 3417"
    assert one(spark, X.photo_id("x"), "Plain.png") == "plain"


def test_split_words_and_names(spark):
    for said, want in (("Train ", "train"), ("VALID", "val"), ("testing\t", "test"), ("dev", None), ("", None), (None, None)):
        assert one(spark, X.split_word("x"), said) == want
    assert one(spark, X.normalize_name("x"), "Powdery-Mildew 2!") == "powderymildew2"
    assert one(spark, X.display_name("x"), "mango_sooty_mould") == "Mango Sooty Mould"
    assert one(spark, X.collapse_blanks("x"), " a\x00 \t b ") == "a b"
    assert one(spark, X.collapse_blanks("x"), None) == ""


def test_safe_divide_and_hamming(spark):
    r = spark.sql("select 1 a, 0 b, cast(null as int) c, -1L m, 0L z").select(X.safe_divide("a", "b").alias("x"), X.safe_divide("c", "a").alias("y"), X.hamming("m", "z").alias("h")).first()
    assert (r.x, r.y, r.h) == (0.0, 0.0, 64)
    assert F is not None
