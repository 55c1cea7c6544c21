import datetime as dt

from phyllo.streaming import ingest

from .conftest import ITEM, rows_of


def test_links_follow_the_stream(spark, make_items, tmp_path):
    src, when = f"{tmp_path}/in", dt.datetime(2024, 1, 1)
    make_items({"sha": "x", "imported_at": when}, {"sha": "y", "imported_at": when}, {"sha": "x", "imported_at": when}, {"sha": None, "imported_at": when}).write.parquet(src)
    def go():
        q = ingest.maintain_links(ingest.read_items(spark, src, ITEM), f"{tmp_path}/index", f"{tmp_path}/links", f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    go()
    make_items({"item_id": 9, "sha": "y", "imported_at": when}, {"item_id": 8, "sha": "z", "imported_at": when}).write.mode("append").parquet(src)
    go()
    assert rows_of(spark.read.parquet(f"{tmp_path}/links"), "a", "b") == [(0, 2), (1, 9)]
    assert rows_of(spark.read.parquet(f"{tmp_path}/index"), "sha256_pixels", "item_id") == [("x", 0), ("y", 1), ("z", 8)]


def test_first_deliveries_and_counts(spark, make_items, tmp_path):
    src, when = f"{tmp_path}/in", dt.datetime(2024, 1, 1)
    make_items({"item_id": 1, "imported_at": when}, {"item_id": 1, "imported_at": when + dt.timedelta(minutes=5)}, {"item_id": 2, "sha": None, "imported_at": when}, {"item_id": None}).write.parquet(src)
    stream = ingest.read_items(spark, src, ITEM)
    for name, df in (("firsts", ingest.first_deliveries(stream)), ("counts", ingest.imports_over_time(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "firsts" else "update").start()
        q.processAllAvailable()
        q.stop()
    assert rows_of(spark.table("firsts"), "item_id") == [(1,), (2,)]
    assert rows_of(spark.table("counts"), "n", "n_unreadable") == [(3, 1)]
