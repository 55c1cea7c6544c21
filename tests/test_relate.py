import random

import pytest

from phyllo.functions.near import flips, parts_within
from phyllo.operators import relate

from .conftest import rows_of


def brute_near(rows, radius):
    """rows: (order, id, hashes) of first occurrences."""
    rows = sorted(rows)
    out = {}
    for i, (_, b, turns) in enumerate(rows):
        for _, a, first in rows[:i]:
            d = min(bin((t ^ first[0]) & (1 << 64) - 1).count("1") for t in turns)
            if d <= radius:
                out[a, b] = d
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("radius", [0, 1, 4, 8, 16])
def test_near_pairs_equal_brute_force(spark, make_items, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(80):
        h = base[i % 25]
        for _ in range(rng.randrange(0, radius + 3)):
            h ^= 1 << rng.randrange(64)
        turns = [h] + [rng.getrandbits(64) for _ in range(7)]
        rng.shuffle(turns)
        rows.append({"hashes": [signed(t) for t in turns], "source": rng.choice("ab"), "relative_path": f"{rng.randrange(10**6):06}.jpg"})
    items = make_items(*rows)
    keys = [((r["source"], r["relative_path"]), i, r["hashes"]) for i, r in enumerate(rows)]
    got = {(r.item_id_a, r.item_id_b): r.phash_distance for r in relate.near_pairs(items, radius).collect()}
    assert got == brute_near(keys, radius)


def test_a_wide_radius_does_not_compare_everything_with_everything(make_items):
    """equal parts of 7 bits let more than half of all pairs meet at a radius of 8."""
    rng = random.Random(8)
    rows = [{"hashes": [signed(rng.getrandbits(64)) for _ in range(8)]} for _ in range(300)]
    for k in range(0, 40, 2):
        rows[k + 1] = {"hashes": [rows[k + 1]["hashes"][0], rows[k]["hashes"][0] ^ 0b1011 << k]}
    pairs = relate.near_pairs(make_items(*rows), 8)
    assert {(r.item_id_a, r.item_id_b): r.phash_distance for r in pairs.collect()} == {(k, k + 1): 3 for k in range(0, 40, 2)}
    assert "bit_count" not in pairs._jdf.queryExecution().toString()  # no join whose candidates are compared row by row
    share = sum(len(list(flips(width, most))) / 2**width for _, width, most in parts_within(8))
    assert share < 0.0003  # of the pairs of random hashes are compared


@pytest.mark.parametrize("radius", [5, 8, 12])
def test_chunks_and_equal_lists_do_not_change_near_pairs(spark, make_items, monkeypatch, radius):
    rng = random.Random(radius)
    base = [0, -1, *(signed(rng.getrandbits(64)) for _ in range(6))]
    rows = []
    for _ in range(120):
        turns = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, radius))) for _ in range(3)]
        rows.append({"hashes": rng.choice(rows)["hashes"] if rows and rng.random() < 0.3 else turns, "relative_path": f"{rng.randrange(10**6):06}.jpg"})
    rows += [{"hashes": [None, 0]}, {"hashes": [None, 0]}, {"hashes": [0, None, -1]}, {"hashes": []}, {"hashes": None}]
    want = {}
    keyed = sorted((r.get("relative_path", f"p{i:03}.jpg"), i, r["hashes"]) for i, r in enumerate(rows) if r["hashes"])
    for n, (_, b, turns) in enumerate(keyed):
        for _, a, first in keyed[:n]:
            d = min((bin((t ^ first[0]) & (1 << 64) - 1).count("1") for t in turns if t is not None), default=65) if first[0] is not None else 65
            if d <= radius:
                want[a, b] = d
    lookup = relate._near_by_lookup
    for size in ((50, 70), (1000, 1000)):
        monkeypatch.setattr(relate, "_near_by_lookup", lambda firsts, r, size=size: lookup(firsts, r, size))
        got = [(r.item_id_a, r.item_id_b, r.phash_distance) for r in relate.near_pairs(make_items(*rows), radius).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_near_links_have_the_components_of_the_pairs(spark, make_items, radius):
    rng = random.Random(radius)
    lists = []
    for _ in range(14):
        h = rng.getrandbits(64)
        for _ in range(3):  # close in one direction only: the canonical hash of one among the turns of the other
            g = h
            for bit in rng.sample(range(64), rng.randrange(0, radius + 2)):
                g ^= 1 << bit
            turns = [rng.getrandbits(64), g] if rng.random() < 0.5 else [g, rng.getrandbits(64)]
            lists.append([signed(x) for x in turns])
    rows = [{"hashes": rng.choice(lists), "source": rng.choice("ab"), "relative_path": f"{rng.randrange(10**6):06}.jpg"} for _ in range(120)]
    items = make_items(*rows)
    pairs, links = relate.near_pairs(items, radius), relate.near_links(items, radius)
    a, b = (rows_of(relate.with_components(spark, items, relate.links(e)), "item_id", "root") for e in (pairs, links))
    assert a == b and links.count() <= pairs.count()


def test_exact_pairs_are_a_star_across_sources(make_items):
    items = make_items({"sha": "x", "source": "b"}, {"sha": "x", "source": "a"}, {"sha": "x", "source": "c"}, {"sha": None}, {"sha": None})
    pairs = relate.exact_pairs(items)
    assert rows_of(pairs, "item_id_a", "item_id_b") == [(1, 0), (1, 2)]
    assert {r.match_type for r in pairs.collect()} == {"exact_pixels"}


def test_conflicts_count_against_the_first(make_items):
    items = make_items({"sha": "x", "label": "l1"}, {"sha": "x", "label": "l2"}, {"sha": "x", "label": "l1"}, {"sha": "y"})
    assert rows_of(relate.conflict_pairs(relate.exact_pairs(items)), "item_id_a", "item_id_b") == [(0, 1)]
    assert rows_of(relate.excluded_conflicts(items), "item_id") == [(0,), (1,), (2,)]
    assert rows_of(relate.without_conflicts(items), "item_id") == [(3,)]


def test_removed_items_still_link_the_others(spark, make_items):
    """a and b share leaf-a, c and d leaf-b; a, c and e have equal pixels and two labels."""
    items = make_items(
        {"official": "leaf-a", "sha": "x", "label": "healthy"}, {"official": "leaf-a"}, {"official": "leaf-b", "sha": "x", "label": "scab"}, {"official": "leaf-b"}, {"sha": "x", "label": "healthy"}
    )
    exact, near = relate.exact_pairs(items), relate.near_pairs(items)
    related = relate.with_components(spark, items, relate.links(exact, near, relate.known_group_edges(items)))
    kept = relate.without_conflicts(related)
    assert rows_of(kept, "item_id", "root") == [(1, 0), (3, 0)]
    stats = relate.duplicate_stats(items.limit(0), exact, near, items).first().asDict()
    assert (stats["exact_cross_label_conflict_pairs"], stats["excluded_conflicting_images"], stats["excluded_conflicting_pixel_hashes"]) == (1, 3, 1)


def test_known_groups_hold_within_a_source_unless_global(make_items):
    items = make_items(
        {"official": "g", "source": "a"}, {"official": "g", "source": "b"}, {"official": "g", "source": "a"}, {"reviewed": "global:1", "source": "a"}, {"reviewed": "global:1", "source": "b"},
        {"official": "global:1", "source": "b"}, {"reviewed": "r", "source": "a"}, {"reviewed": "r", "source": "b"}, {"official": None}, {"official": None},
    )
    assert rows_of(relate.known_group_edges(items), "a", "b") == [(0, 2), (3, 4)]


def test_latest_import_counts_and_ordinals_are_dense(spark, make_items):
    import datetime as dt

    a, b = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    items = make_items({"item_id": 7, "label": "old", "imported_at": a}, {"item_id": 7, "label": "new", "imported_at": b}, {"item_id": 3, "official": " "}, {"item_id": None})
    latest = relate.latest_items(items)
    assert rows_of(latest, "item_id", "class_label", "official_group") == [(3, "apple_scab", None), (7, "new", None)]
    many = make_items(*({"relative_path": f"{(i * 37) % 101:03}.jpg"} for i in range(101))).repartition(7)
    got = relate.ordinals(many, spark).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(101))
    assert [r.relative_path for r in got] == sorted(r.relative_path for r in got)


def test_empty_and_hashless_items(spark, make_items):
    none = make_items({}).limit(0)
    assert relate.near_pairs(none).count() == relate.exact_pairs(none).count() == relate.known_group_edges(none).count() == 0
    assert relate.near_pairs(make_items({"hashes": None}, {"hashes": []}, {})).count() == 0
    with pytest.raises(ValueError):
        relate.near_pairs(none, 17)


def test_order_and_partitions_do_not_matter(spark, make_items):
    items = make_items(*({"sha": str(i % 5), "official": str(i % 7)} for i in range(30)))
    def named(df):
        edges = relate.links(relate.exact_pairs(df), relate.known_group_edges(df))
        return rows_of(relate.with_group_ids(relate.with_components(spark, df, edges)), "item_id", "group_id")
    assert named(items) == named(items.orderBy("sha256_pixels").repartition(9))
