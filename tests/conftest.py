import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from phyllo.session import get_session

    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


ITEM = "item_id long, image_path string, relative_path string, source_dataset string, class_label string, official_group string, reviewed_group string, sha256_pixels string, hashes array<long>, imported_at timestamp"


@pytest.fixture(scope="session")
def make_items(spark):
    """Items from dicts; what is not given has a harmless value. Ids follow the order of rows."""

    def make(*rows, **common):
        out = []
        for i, r in enumerate(rows):
            r = {**common, **r}
            name = r.get("name", f"p{i:03}.jpg")
            path = r.get("relative_path", name)
            far = [((i + 1) * 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 63) for k in range(8)]
            sha = r.get("sha", f"{i:064x}")
            out.append((r.get("item_id", i), r.get("image_path", f"/d/{path}"), path, r.get("source", "a"), r.get("label", "apple_scab"), r.get("official"), r.get("reviewed"), sha, r.get("hashes", far), r.get("imported_at")))
        return spark.createDataFrame(out, ITEM)

    return make


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
