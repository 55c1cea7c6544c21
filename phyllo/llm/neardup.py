"""Near-duplicate records with small edits.

Vertical partitioning over the n-grams of file names: the n-grams get one
global order from rare to frequent and the order is cut into fragments. A
record sends each fragment the part of its n-grams that falls into it; inside a
fragment records with close hashes meet at the n-grams that they share, and the
weight of what they share there is counted. The partial weights are summed per
pair, and the sum alone decides: one name is an edited form of the other if
they share at least a given part of the lighter one's weight.

The rarest n-gram that such a pair shares is among those with which the lighter
name still reaches that part: it looks for others there, and the heavier one
can be found there. So every pair meets in some fragment. Where the fragments
in which a pair met do not reach the threshold, those in which neither looks
for the other (the frequent n-grams) are counted from the two names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, missing_to_null, spelled
from ..session import Scratch
from .linking import components

BASE = 37
CODES = BASE**3  # n-grams of three characters; the n-gram tables have this size whatever the data
LEAST_FRAGMENTS = 12
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # five parts of 64 bits: within 4 bits one is equal
_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = np.arange(128) % 36 + 1
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CLASS[_c] = _i + 1


def name_cores(paths: pa.Array) -> pa.Array:
    """Words of file names between single blanks: lower case, without extension and percent
    escapes. Null for a path without a letter or digit in its name."""
    s = pc.replace_substring_regex(pc.utf8_lower(paths.cast(pa.string())), r"(?s)^.*/", "")
    s = pc.replace_substring_regex(s, r"(?s)^(.+)\.[^.]*$", r"\1")
    words = pc.utf8_trim(pc.replace_substring_regex(s, r"%[0-9a-f]{2}|[^\p{L}\p{N}]+", " "), " ")
    words = pc.replace_substring_regex(pc.binary_join_element_wise("", words, "", " "), " +", " ")  # a blank at both ends
    return pc.if_else(pc.match_substring_regex(words, "[^ ]"), words, pa.scalar(None, pa.string()))


def gram_codes(cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each core: (row, code), sorted. Words are padded by one blank
    and no n-gram spans two words, so neither order nor separators of the words count."""
    cores = pc.fill_null(cores, "")
    if not len(cores):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(cores.buffers()[1], np.int32)[cores.offset : cores.offset + len(cores) + 1].astype(np.int64)
    data = np.frombuffer(cores.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if cores.buffers()[2] else np.empty(0, np.uint8)
    c = _CLASS[data]
    rows = np.repeat(np.arange(len(cores)), np.diff(offsets))
    at = np.flatnonzero(c[1:-1]) + 1
    codes = (c[at - 1] * BASE + c[at]) * BASE + c[at + 1]
    keys = np.unique(rows[at] << 16 | codes)
    return keys >> 16, keys & 0xFFFF


def item_cores(named: DataFrame) -> DataFrame:
    """One ``core`` for each item that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), name_cores(batch.column("image_path"))], names=["item_id", "core"])

    paths = named.groupBy("item_id").agg(F.min("image_path").alias("image_path"))
    return paths.mapInArrow(run, "item_id long, core string").where("core IS NOT NULL")


def gram_frequencies(cores: DataFrame) -> np.ndarray:
    """In how many items each n-gram stands. The table has CODES entries, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CODES, np.int64)
        for batch in batches:
            counts += np.bincount(gram_codes(batch.column(0))[1], minlength=CODES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["code", "n"])

    summed = cores.select("core").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(CODES, np.int64)
    for code, n in summed.collect():  # at most CODES rows
        out[code] = n
    return out


class Grams:
    """Tables over all n-grams: frequency, weight, place in the global order, fragment and parts."""

    def __init__(self, frequency: np.ndarray, similarity: float):
        self.frequency, self.similarity = frequency, similarity
        self.order = np.empty(CODES, np.int64)
        self.order[np.lexsort((np.arange(CODES), frequency))] = np.arange(CODES)
        self.weight = np.log1p(max(1, int(frequency.max())) / np.maximum(frequency, 1))
        self.least = np.full(CODES, np.inf)

    def cut(self, least: np.ndarray, rows: int) -> None:
        """Cut the order into fragments of about ``rows`` names each, by the names that can meet at each n-gram.

        An n-gram of more names is a fragment of its own, divided by the bits
        of the hashes into about as many parts as it holds times ``rows``.
        """
        self.least = least
        load = np.where(np.isfinite(least), self.frequency, 0)
        place = np.argsort(self.order)
        sums = np.cumsum(load[place])
        rows = max(1, min(rows, int(sums[-1]) // LEAST_FRAGMENTS))
        alone = load[place] > rows
        step = sums // rows + np.cumsum(alone) + np.concatenate([[0], np.cumsum(alone)[:-1]])
        self.fragment = np.empty(CODES, np.int64)
        self.fragment[place] = np.cumsum(np.diff(step, prepend=step[:1]) > 0)
        bits = np.minimum(np.ceil(np.log2(np.maximum(load / rows, 1))), 12).astype(np.int64)
        self.bits = np.zeros(int(self.fragment.max()) + 1, np.int64)
        np.maximum.at(self.bits, self.fragment, bits)

    def ranked(self, cores: pa.Array) -> tuple[np.ndarray, ...]:
        """N-grams of each core from rare to frequent: row, code, whether the core seeks others there,
        whether lighter ones can find it there; and the weight of each core."""
        rows, codes = gram_codes(cores)
        total = np.bincount(rows, self.weight[codes], minlength=len(cores))
        place = np.lexsort((self.order[codes], rows))
        rows, codes = rows[place], codes[place]
        shared = self.frequency[codes] > 1
        ends = np.concatenate([[0.0], np.cumsum(np.where(shared, self.weight[codes], 0.0))])
        rest = ends[np.searchsorted(rows, rows, "right")] - ends[:-1] + 1e-3  # more than all rounding
        seeks = shared & (rest >= self.similarity * total[rows])
        return rows, codes, seeks, seeks | shared & (rest >= self.similarity * self.least[codes]), total


def lightest_seekers(cores: DataFrame, grams: Grams) -> np.ndarray:
    """Weight of the lightest core that looks for others at each n-gram, infinite if none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(CODES, np.inf)
        for whole in batches:
            for begin in range(0, whole.num_rows, 20_000):
                rows, codes, seeks, _, total = grams.ranked(whole.column(0).slice(begin, 20_000))
                np.minimum.at(least, codes[seeks], total[rows[seeks]])
        at = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at])], names=["code", "least"])

    out = np.full(CODES, np.inf)
    for code, least in cores.select("core").mapInArrow(run, "code long, least double").groupBy("code").agg(F.min("least")).collect():  # at most CODES rows
        out[code] = least
    return out


MARKS = np.random.default_rng(11).integers(-(2**62), 2**62, CODES)
SEGMENTS = "cell long, item_id long, name long, total double, segment binary, hashes binary"


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose elements are the values up to each end."""
    width = values.itemsize
    offsets = np.concatenate([[0], ends]).astype(np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _values(blobs: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary array, and how many each element has."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    if not len(blobs) or offsets[-1] == offsets[0]:
        return np.empty(0, kind), np.zeros(len(blobs), np.int64)
    return np.frombuffer(blobs.buffers()[2][offsets[0] : offsets[-1]], kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


def _segments(grams: Grams):
    """One row for each record and fragment where it seeks others or can be found: its n-grams there,
    each with two marks (seeks, can be found), and its hashes, which so travel once a fragment.

    In a fragment that is divided, a record enters the part of each band of its
    hashes, so two close ones share a part; with more bits come more parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 20_000):
                batch = whole.slice(begin, 20_000)
                rows, codes, seeks, found, total = grams.ranked(name_cores(batch.column("image_path")))
                if not len(rows):
                    continue
                fragment = grams.fragment[codes]
                name = np.zeros(batch.num_rows, np.int64)
                np.add.at(name, rows, MARKS[codes])
                new = np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(fragment) != 0)])
                first = np.flatnonzero(new)
                used = np.logical_or.reduceat(found, first)
                kept = used[np.cumsum(new) - 1]
                marked = (codes << 2 | found.astype(np.int64) << 1 | seeks).astype(np.uint32)[kept]
                ends = np.cumsum(np.diff(np.concatenate([first, [len(rows)]]))[used])
                r, f = rows[first[used]], fragment[first[used]]
                lists = batch.column("hashes")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.asarray(lists.value_lengths()).astype(np.int64)
                stops = np.cumsum(counts)
                cell, at = f << 17, np.arange(len(r))
                bits = grams.bits[f]
                if bits.any():
                    wide = np.flatnonzero(bits)
                    n = counts[r[wide]]
                    turn = np.repeat(stops[r[wide]] - np.cumsum(n), n) + np.arange(n.sum())
                    h, owner = flat[turn].view(np.uint64), np.repeat(wide, n)
                    parts = [(b + 1) << 13 | (h >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) >> np.maximum(w - bits[owner], 0) for b, (s, w) in enumerate(BANDS)]
                    both = np.unique(np.stack([np.tile(owner, len(BANDS)), np.concatenate(parts)]), axis=1)
                    cell, at = np.concatenate([cell[bits == 0], f[both[0]] << 17 | both[1]]), np.concatenate([at[bits == 0], both[0]])
                picked = pa.array(r[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), batch.column("item_id").take(picked), pa.array(name[r[at]]), pa.array(total[r[at]]), _blobs(marked, ends).take(pa.array(at)), _blobs(flat, stops).take(picked)],
                    names=["cell", "item_id", "name", "total", "segment", "hashes"],
                )

    return run


def close_pairs(group: np.ndarray, ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray, radius: int, most: int = 500_000, small: int = 32, places: int = 1 << 22, step: int = 100_000, seeks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group where some hash of one lies within ``radius`` of the first hash of the other.

    Where ``seeks`` is given, it is true for one row of each pair at least.
    The rows are sorted by ``group``. Groups of up to ``small`` rows are compared
    as they are; in larger ones equal parts of the hashes lead to the candidates,
    through tables of about ``places`` entries for the groups of one size. Rows are taken in steps of
    ``step`` and candidates in steps of about ``most``, so memory beyond the rows
    themselves does not depend on the size of a group.
    """
    n = len(group)
    if not n:
        return
    seeks = np.ones(n, bool) if seeks is None else seeks
    starts = np.cumsum(lengths) - lengths
    first = flat[starts]
    new = np.concatenate([[True], np.diff(group) != 0])
    number = (np.cumsum(new) - 1).astype(np.int32)
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [n]]))
    sought = np.logical_or.reduceat(seeks, begin)

    def turns(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all hashes of the rows, and whose they are."""
        k = lengths[rows]
        return np.repeat(starts[rows] - np.cumsum(k) + k, k) + np.arange(k.sum()), np.repeat(rows, k)

    def expand(at: np.ndarray, owner: np.ndarray, low: np.ndarray, counts: np.ndarray, rows: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums = np.cumsum(counts)
        i = 0
        while i < len(at):
            stop = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + most, "right")))
            c = counts[i:stop]
            right = np.repeat(low[i:stop] - np.cumsum(c) + c, c) + np.arange(c.sum())
            right = right if rows is None else rows[right]
            near = np.flatnonzero(np.bitwise_count(np.repeat(flat[at[i:stop]], c) ^ first[right]) <= radius)
            left, right = np.repeat(owner[i:stop], c)[near], right[near]
            other = (ids[left] != ids[right]) & (seeks[left] | seeks[right])
            if other.any():
                yield left[other], right[other]
            i = stop

    few = np.flatnonzero(((size <= small) & (size > 1) & sought)[number])
    for k in range(0, len(few), step):
        at, owner = turns(few[k : k + step])
        yield from expand(at, owner, begin[number[owner]], size[number[owner]], None)

    # Tables of about four places a row, so groups of one size go together.
    class_of = np.where((size > small) & sought, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 2, 0)
    for c in np.unique(class_of[class_of > 0]).tolist():
        many = np.flatnonzero(class_of == c)
        at_once = max(1, places >> c)
        for k in range(0, len(many), at_once):
            part = many[k : k + at_once]
            rows, place_in = turns_of(part, begin, size)
            for shift, width in BANDS:
                w = min(width, c)
                mask = np.uint64((1 << w) - 1)
                canon = place_in << w | (first[rows] >> np.uint64(shift) & mask).astype(np.int64)
                canon = canon << 1 | ~seeks[rows]  # those that seek come first: the others look up only these
                order = np.argsort(canon, kind="stable")
                place = rows[order]
                ends = np.zeros((len(part) << w + 1) + 1, np.int32)
                np.cumsum(np.bincount(canon, minlength=len(part) << w + 1), out=ends[1:])
                for r in range(0, len(rows), step):
                    some = rows[r : r + step]
                    at, owner = turns(some)
                    wanted = (np.repeat(place_in[r : r + step], lengths[some]) << w | (flat[at] >> np.uint64(shift) & mask).astype(np.int64)) << 1
                    low = ends[wanted].astype(np.int64)
                    counts = ends[wanted + 1 + seeks[owner]] - low
                    hit = np.flatnonzero(counts)
                    # A row that only meets itself, through its first hash, is no candidate.
                    hit = hit[(counts[hit] > 1) | (place[low[hit]] != owner[hit])]
                    yield from expand(at[hit], owner[hit], low[hit], counts[hit], place)


def turns_of(part: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the groups in ``part``, and the place of each one's group there."""
    n = size[part]
    return np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(part)), n)


def _spread(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values of the given rows, and the place of each one's row in ``rows``."""
    n = counts[rows]
    return np.repeat((np.cumsum(counts) - counts)[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(rows)), n)


def shared_weight(codes: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of the n-grams that the rows of each pair share."""
    (x, p), (y, q) = _spread(counts, left), _spread(counts, right)
    mine = p << 16 | codes[x]
    held = mine[np.isin(mine, q << 16 | codes[y])]
    return np.bincount(held >> 16, weight[held & 0xFFFF], minlength=len(left))


OVERLAPS = "a long, b long, fragment int, shared double, lighter double"


def _fragment_overlaps(grams: Grams, radius: int, rows: int = 40_000, step: int = 150_000):
    """Partial overlap of each pair that meets in a fragment, from rows sorted by cell.

    Records of one name and the same hashes behave alike: the one with the
    smallest id stands for them, and the others are only paired with it.
    """
    weight = grams.weight

    def match(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, ids, total = (t[c].to_numpy() for c in ("cell", "item_id", "total"))
        blob, segment = (t[c].combine_chunks() for c in ("hashes", "segment"))
        blob, segment = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (blob, segment))
        picture = pc.dictionary_encode(blob).indices.to_numpy()
        order = np.lexsort((ids, t["name"].to_numpy(), picture, cell))
        k = np.stack([cell, picture, t["name"].to_numpy()])[:, order]
        new = np.concatenate([[True], (np.diff(k) != 0).any(0)])
        stands = np.empty(len(ids), np.int64)
        stands[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        marked, counts = _values(segment, np.uint32)
        codes = (marked >> 2).astype(np.int64)
        other = np.flatnonzero(ids != ids[stands])
        found = [stands[other] * len(ids) + other]

        alone = np.flatnonzero(stands == np.arange(len(ids)))
        at, owner = _spread(counts, alone)
        open_ = marked[at] & 2 > 0
        at, owner = at[open_], alone[owner[open_]]
        group = cell[owner] << 16 | codes[at]
        place = np.argsort(group, kind="stable")
        at, owner = at[place], owner[place]
        group = group[place]
        flat, lengths = _values(blob, np.uint64)
        held = 0
        # Whole n-grams, about ``step`` rows at a time: only theirs of the hashes are copied.
        begin = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.empty(0, np.int64)
        cuts = [*begin[np.concatenate([[True], np.diff(begin // step) != 0])].tolist(), len(group)] if len(group) else [0]
        for low, high in zip(cuts, cuts[1:]):
            mine = owner[low:high]
            turns, _ = _spread(lengths, mine)
            for left, right in close_pairs(group[low:high], ids[mine], flat[turns], lengths[mine], radius, seeks=marked[at[low:high]] & 1 > 0):
                left, right = mine[left], mine[right]
                found.append(np.minimum(left, right) * len(ids) + np.maximum(left, right))
                held += len(left)
                if held > 1_000_000:
                    found, held = [np.unique(np.concatenate(found))], 0
        pairs = np.unique(np.concatenate(found))
        for begin in range(0, len(pairs), 200_000):
            left, right = np.divmod(pairs[begin : begin + 200_000], len(ids))
            shared = shared_weight(codes, counts, left, right, weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ids[left], ids[right])), pa.array(np.maximum(ids[left], ids[right])), pa.array((cell[left] >> 17).astype(np.int32)), pa.array(shared), pa.array(np.minimum(total[left], total[right]))],
                names=["a", "b", "fragment", "shared", "lighter"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            last = batch.column("cell")[-1]
            if size >= rows and held[0]["cell"][0] != last:
                t = pa.concat_tables(held).combine_chunks()
                cut_at = int(np.searchsorted(t["cell"].to_numpy(), last.as_py()))  # the last cell may go on
                yield from match(t.slice(0, cut_at).combine_chunks())
                held, size = [t.slice(cut_at)], t.num_rows - cut_at
        if size:
            yield from match(pa.concat_tables(held).combine_chunks())

    return run


def _remaining(grams: Grams):
    """Pairs that reach the threshold with the fragments in which they did not meet, counted from the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 20_000):
                batch = whole.slice(begin, 20_000)
                n = batch.num_rows
                rows, codes = gram_codes(pa.concat_arrays([batch.column("core_a").cast(pa.string()), batch.column("core_b").cast(pa.string())]))
                counted = batch.column("fragments")
                done = np.repeat(np.arange(n), np.asarray(counted.value_lengths())) << 32 | counted.flatten().to_numpy().astype(np.int64)
                left = np.isin((rows % max(n, 1)) << 32 | grams.fragment[codes], done, invert=True)
                counts = np.bincount(rows[left], minlength=2 * n)
                rest = shared_weight(codes[left], counts, np.arange(n), np.arange(n, 2 * n), grams.weight)
                keep = batch.column("shared").to_numpy() + rest >= grams.similarity * batch.column("lighter").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_pairs(spark: SparkSession, items: DataFrame, radius: int = 4, similarity: float = 0.3, rows: int = 800_000) -> DataFrame:
    """Links (``a`` < ``b``) between items with close hashes and file names of which one is an edited form of the other.

    Items without hashes or without a name take no part. Items of one name and
    the same hashes are all linked to the one with the smallest id and to
    nothing else; all other pairs come out. ``rows`` is the size of a fragment;
    it changes nothing in the result.
    """
    if radius > 4:
        raise ValueError("five parts of the hashes find pairs within 4 bits")
    scratch = Scratch(spark, "near")
    named = items.select(
        "item_id", base_name(missing_to_null("image_path")).alias("image_path"), F.filter("hashes", lambda h: h.isNotNull()).alias("hashes")
    ).where("item_id IS NOT NULL AND image_path IS NOT NULL AND size(hashes) > 0")
    cores = scratch.save(item_cores(named))
    grams = Grams(gram_frequencies(cores), similarity)
    grams.cut(lightest_seekers(cores, grams), rows)
    met = named.mapInArrow(_segments(grams), SEGMENTS).repartition("cell").sortWithinPartitions("cell").mapInArrow(_fragment_overlaps(grams, radius), OVERLAPS)
    # A pair may meet in several parts of one fragment; its overlap there counts once.
    partial = met.repartition("a", "b").groupBy("a", "b", "fragment").agg(F.max("shared").alias("shared"), F.max("lighter").alias("lighter"))
    summed = scratch.save(partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("lighter").alias("lighter"), F.array_sort(F.collect_set("fragment")).alias("fragments")))
    reached = F.col("shared") >= similarity * F.col("lighter")
    short = summed.where(~reached)
    for end in "ab":
        short = short.join(cores.select(F.col("item_id").alias(end), F.col("core").alias(f"core_{end}")), end)
    return summed.where(reached).select("a", "b").unionByName(short.mapInArrow(_remaining(grams), "a long, b long"))


def equal_pixels(items: DataFrame) -> DataFrame:
    """Links of each item to the first one with the same pixels: a star, however many copies there are."""
    read = items.select("item_id", spelled("sha256_pixels").alias("pixels")).where("item_id IS NOT NULL AND pixels IS NOT NULL")
    read = read.select("item_id", F.coalesce(F.when(F.col("pixels").rlike("^[0-9a-f]{64}$"), F.unhex("pixels")), F.encode("pixels", "UTF-8")).alias("pixels"))
    first = read.groupBy("pixels").agg(F.min("item_id").alias("a"), F.max("item_id").alias("last")).where("a <> last").select("pixels", "a")
    return read.join(first, "pixels").where("item_id <> a").select("a", F.col("item_id").alias("b"))


def photographs(spark: SparkSession, items: DataFrame, **options) -> DataFrame:
    """Items that share a photograph with another one: ``item_id`` and ``group_item_id``, the smallest of the group.

    Unreadable items (no pixels, no hashes) and items alone in their group have
    no row. Repeated rows of an item count once; other columns are not read.
    """
    scratch = Scratch(spark, "photographs")
    edges = scratch.save(equal_pixels(items).unionByName(near_pairs(spark, items, **options)))
    out = components(spark, edges, scratch)
    return out.select(F.col("node").alias("item_id"), F.col("root").alias("group_item_id"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs inside the groups, smaller id first."""
    a = groups.select("group_item_id", F.col("item_id").alias("item_id_a"))
    b = groups.select("group_item_id", F.col("item_id").alias("item_id_b"))
    return a.join(b, "group_item_id").where("item_id_a < item_id_b").select("item_id_a", "item_id_b")
