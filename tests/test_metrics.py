import pytest

from phyllo.operators import checks, metrics
from phyllo.plans import evaluate

from .conftest import rows_of


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([(i, c, "t", c) for i, c in enumerate("xyz")], "label_index int, class_label string, tree_type string, condition string")


@pytest.fixture(scope="module")
def said(spark):
    cells = {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rows = [(t, p, "s" if i % 2 else "r") for (t, p), n in cells.items() for i in range(n)] + [(None, 1, "s"), (1, None, "s")]
    return spark.createDataFrame(rows, "target int, prediction int, source_dataset string")


def test_numbers(said, three):
    done = evaluate.evaluate(said, three)
    s = done["summary"].first()
    assert s.n == 6 and s.accuracy == pytest.approx(4 / 6) and s.macro_f1 == pytest.approx(1.25 / 3) and s.macro_f1_supported == pytest.approx(1.25 / 2) and s.supported_classes == 2
    assert [r.support for r in done["per_class"].orderBy("label_index").collect()] == [4, 2, 0]
    assert done["by_source"].count() == 2
    assert rows_of(metrics.top_errors(done["confusion"]), "target", "prediction", "n") == [(0, 1, 1), (1, 0, 1)]
    wide = metrics.confusion_wide(done["confusion"], three)
    assert [tuple(r) for r in wide.collect()] == [("x", 3, 1, 0), ("y", 1, 1, 0), ("z", 0, 0, 0)]


def test_no_predictions(said, three):
    s = evaluate.evaluate(said.limit(0), three)["summary"].first()
    assert (s.n, s.accuracy, s.macro_f1, s.macro_f1_supported, s.supported_classes) == (0, 0.0, 0.0, 0.0, 0)


def test_best_epoch_is_the_first_of_equals(spark):
    h = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1)], "epoch int, macro_f1 double")
    assert tuple(metrics.best_epoch(h).first()) == (2, 0.9)
    assert checks.bad_epochs(h).count() == 0
    gap = spark.createDataFrame([(1, 0.5), (3, 0.9), (3, 0.9)], "epoch int, macro_f1 double")
    assert rows_of(checks.bad_epochs(gap), "epoch", "n") == [(2, 0), (3, 2)]


def test_weighted_loss(spark):
    b = spark.createDataFrame([(1.0, 3), (2.0, 1), (None, 5), (9.0, 0)], "loss double, n long")
    assert metrics.weighted_loss(b).first().loss == pytest.approx(1.25)


def test_run_agreements(spark, said, three):
    done = evaluate.evaluate(said, three)
    h = spark.createDataFrame([(1, 0.4), (2, 0.6)], "epoch int, macro_f1 double")
    good, bad = (spark.createDataFrame([(e, f)], "epoch int, macro_f1 double") for e, f in ((2, 0.6), (1, 0.4)))
    evaluate.check_run(h, done["confusion"], done["per_class"], three, good, 6)
    for checkpoint, n in ((bad, 6), (good, 7)):
        with pytest.raises(checks.ConstraintError):
            evaluate.check_run(h, done["confusion"], done["per_class"], three, checkpoint, n)
    text = evaluate.markdown(done["summary"].first().asDict(), [{"epoch": 1, "macro_f1": 0.4}], [{"target": 0, "prediction": 1, "n": 1}], {0: "x", 1: "y"})
    assert "66.67%" in text and "| x | y | 1 |" in text


def test_head_on_fixed_features(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(k == j) + 0.01 * i for j in range(3)]), float(k)) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, ["features", "target"])
    model, history = evaluate.fit_head(df, df, rates=(0.0, 0.1))
    assert history.count() == 2 and metrics.best_epoch(history).first().macro_f1 == 1.0
    dim = spark.createDataFrame([(i, f"l_{i}") for i in range(3)], "label_index int, class_label string")
    top = evaluate.predict(model, df.limit(2), dim, 2)
    assert top.count() == 4 and {r.rank for r in top.collect()} == {0, 1}


def test_a_run_is_written_and_read_back(spark, said, three, tmp_path):
    out, manifest = f"{tmp_path}/run", f"{tmp_path}/manifest"
    spark.createDataFrame([("x",)], "a string").coalesce(1).write.csv(manifest)
    summary = evaluate.save_reports(spark, out, said, three)
    history = spark.createDataFrame([(1, 0.4), (2, 0.6)], "epoch int, macro_f1 double")
    evaluate.write_run(spark, out, {"seed": 42}, manifest, history)
    run = evaluate.read_run(spark, out)
    assert run["metrics"]["n"] == summary["n"] == 6 and run["metrics"]["missing_classes"] == ["z"] and run["config"]["manifest_files"] == [run["config"]["manifest_sha256"]]
    best = spark.createDataFrame([(2, 0.6)], "epoch int, macro_f1 double")
    evaluate.check_run(run["history"], run["confusion"], run["per_class"], three, best, run["metrics"]["n"])
    with pytest.raises(FileExistsError):
        evaluate.save_reports(spark, out, said, three)
