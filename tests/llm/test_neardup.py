import random

import numpy as np
import pyarrow as pa
import pytest

from phyllo.llm import neardup as N

from ..conftest import rows_of
from ..test_relate import signed


def test_cores_and_grams():
    paths = pa.array(["/a/b/copy of IMG_1 (Custom)(3).jpg", "x/Copy.jpg", None, "", "/q/a%20b - Copy (2).tif", ".hidden", "/q/---.jpg", "Ж_12.png"])
    assert N.name_cores(paths).to_pylist() == [" copy of img 1 custom 3 ", " copy ", None, None, " a b copy 2 ", " hidden ", None, " ж 12 "]
    rows, codes = N.gram_codes(pa.array([" ab ab ", None, " b a "]))
    assert rows.tolist() == [0, 0, 2, 2] and len(set(codes.tolist())) == 4
    a, b = (set(N.gram_codes(pa.array([x]))[1].tolist()) for x in (" one two ", " two one "))
    assert a == b and len(a) == 6


@pytest.mark.parametrize("seed", range(4))
def test_close_pairs_equal_brute_force(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    group, ids, flat, lengths = [], [], [], []
    for i in range(150):
        h = base[i % 12]
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        k = rng.choice([1, 8])
        turns = [h] + [rng.choice(base) for _ in range(k - 1)]
        group.append(i // 50)
        ids.append(i % 140)
        flat += turns
        lengths.append(k)
    starts = np.cumsum([0, *lengths])
    want = {
        (i, j) for i in range(150) for j in range(150)
        if group[i] == group[j] and ids[i] != ids[j] and any(bin(flat[t] ^ flat[starts[j]]).count("1") <= 4 for t in range(starts[i], starts[i + 1]))
    }
    for small in (1, 49, 50):
        got = set()
        for left, right in N.close_pairs(np.array(group), np.array(ids), np.array(flat, np.uint64), np.array(lengths), 4, most=37, small=small, places=300, step=40):
            got |= set(zip(left.tolist(), right.tolist()))
        assert got == want


def share(cores):
    """Weight that two cores share, as a part of the lighter one's, by plain sets."""
    grams = [set() for _ in cores]
    for row, code in zip(*(x.tolist() for x in N.gram_codes(pa.array(cores)))):
        grams[row].add(code)
    frequency = np.bincount([c for g in grams for c in g], minlength=N.CODES)
    weight = np.log1p(frequency.max() / np.maximum(frequency, 1))
    total = [sum(weight[c] for c in g) for g in grams]
    return lambda i, j: sum(weight[c] for c in grams[i] & grams[j]) / max(min(total[i], total[j]), 1e-9)


def test_shared_weight_equals_sets():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(60), rng.randrange(0, 20))) for _ in range(40)]
    weight = np.arange(1.0, N.CODES + 1)
    left, right = np.array([rng.randrange(40) for _ in range(100)]), np.array([rng.randrange(40) for _ in range(100)])
    got = N.shared_weight(np.array([c for s in sets for c in s], np.int64), np.array([len(s) for s in sets]), left, right, weight)
    assert got.tolist() == [sum(weight[c] for c in set(sets[x]) & set(sets[y])) for x, y in zip(left, right)]


def test_fragments_cut_the_order():
    frequency = np.zeros(N.CODES, np.int64)
    frequency[:200] = 10
    frequency[200] = 5000
    grams = N.Grams(frequency, 0.3)
    grams.cut(np.zeros(N.CODES), 100)
    assert grams.fragment[200] not in grams.fragment[:200] and grams.bits[grams.fragment[200]] == 6
    sizes = np.bincount(grams.fragment[:200], frequency[:200])
    assert sizes.max() <= 110 and (np.diff(grams.fragment[np.argsort(grams.order)]) >= 0).all()


def planted(rng, families=60, noise=300):
    """Families of one picture under edited names, beside unrelated pictures, look-alikes and series."""
    rows, truth = [], {}

    def turns(h):
        return [signed(x) for x in (h, *(rng.getrandbits(64) for _ in range(7)))]

    for f in range(families):
        h, number = rng.getrandbits(64), rng.randrange(10**6)
        names = [f"img_{number:06}_{f * 7919 % 100000:05}", f"IMG_{number:06}_{f * 7919 % 100000:05} copy", f"{f * 7919 % 100000:05}-img-{number:06}(2)", f"img_{number:06}_{f * 7919 % 100000:05}"[:-1]]
        for k, name in enumerate(names[: rng.randrange(2, 5)]):
            g = h
            for bit in rng.sample(range(64), rng.randrange(0, 3) if k else 0):
                g ^= 1 << bit
            order = turns(g)
            if k == 1:  # turned: the canonical hash of the first is another orientation of this one
                order = [order[1], order[0], *order[2:]]
            truth.setdefault(f, []).append(len(rows))
            rows.append({"hashes": order, "relative_path": f"{len(rows)}/{name}.jpg"})
    blank = turns(0)
    for i in range(noise):
        rows.append({"hashes": blank if i % 3 == 0 else turns(rng.getrandbits(64)), "relative_path": f"{len(rows)}/{rng.getrandbits(60):015x}.png"})
    return rows, truth


@pytest.mark.parametrize("rows", [100_000, 3])
def test_planted_families_come_out_as_groups(spark, make_items, clash, rows):
    size, rng = rows, random.Random(5)
    rows, truth = planted(rng)
    rows[-1]["sha"] = rows[-2]["sha"] = "same"
    rows += [{"sha": None, "hashes": None}, {"sha": None, "hashes": []}, {"image_path": None}, {"image_path": "", "sha": ""}]
    items = make_items(*rows)
    got = rows_of(N.group_pairs(N.photographs(spark, clash(items.unionByName(items.limit(40))), rows=size)))
    want = {(a, b) for members in truth.values() for a in members for b in members if a < b} | {(len(rows) - 6, len(rows) - 5)}
    assert set(got) == want and len(got) == len(want)


def test_equal_pixels_and_empty_tables(spark, make_items):
    items = make_items({"sha": "AB" * 32}, {"sha": " " + "ab" * 32}, {"sha": "zz"}, {"sha": "ZZ "}, {"sha": None}, {"sha": None})
    assert rows_of(N.equal_pixels(items), "a", "b") == [(0, 1), (2, 3)]
    assert N.photographs(spark, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.near_pairs(spark, items, radius=5)


@pytest.mark.parametrize("size", [100_000, 3])
def test_links_equal_all_close_pairs(spark, make_items, size):
    """Whatever the fragments, exactly the close pairs that share the weight are linked."""
    rng = random.Random(7)
    rows = []
    for f in range(25):
        hashes = [signed(rng.getrandbits(64)) for _ in range(8)]
        number, word, other = f"{rng.randrange(10**5):05}", *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2))
        names = [f"dsc_{number}", f"{word}_dsc_{number}", f"dsc_{number[:2]}{number[3:]}", f"{other}-{word} dsc {number[::-1]}", f"dsc_{number[1]}{number[0]}{number[2:]}_{other}", word, f"{word} DSC-{number}"]
        rows += [{"hashes": [hashes[k % 2], *hashes[1:]], "name": f"{len(rows) + k}/{name}.jpg"} for k, name in enumerate(names)]
        far = [f"{word} {rng.getrandbits(30)}", f"{other} {rng.getrandbits(30)}", *(f"{number} {rng.choice('abcdef')}{k}" for k in range(3))]
        rows += [{"hashes": [signed(rng.getrandbits(64)) for _ in range(8)], "name": f"{len(rows) + k}/{name}.png"} for k, name in enumerate(far)]
    items = make_items(*rows)
    cores = N.name_cores(pa.array([r["name"] for r in rows])).to_pylist()
    part = share(cores)

    def close(i, j):
        return any(bin((h ^ rows[y]["hashes"][0]) & (1 << 64) - 1).count("1") <= 4 for x, y in ((i, j), (j, i)) for h in rows[x]["hashes"])

    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if close(i, j) and part(i, j) >= 0.3}
    assert len(want) > 100 and rows_of(N.near_pairs(spark, items.union(items), rows=size), "a", "b") == sorted(want, key=str)


def test_one_name_and_one_picture_make_a_star(spark, make_items):
    same = [signed(x * 0x9E3779B97F4A7C15 % 2**64) for x in range(1, 9)]
    items = make_items(*({"hashes": same, "name": f"{k}/IMG 20{k % 2}.jpg"} for k in range(60)), {"hashes": [h ^ 1 for h in same], "name": "x/img-200.png"})
    got = rows_of(N.near_pairs(spark, items), "a", "b")
    assert {(a, b) for a, b in got if b < 60 and a % 2 == b % 2} == {(k % 2, k) for k in range(2, 60)} and len(got) < 70
    assert N.photographs(spark, items).where("group_item_id = 0").count() == 61


@pytest.mark.parametrize("seed", range(3))
def test_rows_that_do_not_seek_meet_only_those_that_do(seed):
    rng = np.random.default_rng(seed)
    n, k = 200, 3
    flat = rng.choice(rng.integers(0, 2**63, 9), n * k).astype(np.uint64)
    group, seeks = np.sort(rng.integers(0, 4, n)), rng.random(n) < 0.3
    seeks[group == 2] = False
    lengths = np.full(n, k)

    def found(small, seeks=None):
        return {(min(x), max(x)) for left, right in N.close_pairs(group, np.arange(n), flat, lengths, 4, most=37, small=small, places=300, step=40, seeks=seeks) for x in zip(left.tolist(), right.tolist())}

    want = {(i, j) for i, j in found(n) if seeks[i] or seeks[j]}
    assert want and found(1, seeks) == found(n, seeks) == want
