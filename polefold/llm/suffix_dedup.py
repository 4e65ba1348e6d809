"""Operator 2, exact substring dedup by threshold-bounded backward extension on a BWT.

Removed is each byte covered by a string of ``MIN_BYTES`` bytes that also starts anywhere else.

1. Anchors. Of each window of W consecutive K-grams (K + W - 1 = MIN_BYTES) the K-grams with the
   smallest hash are anchors. The choice depends on the window's bytes alone, so equal strings of
   MIN_BYTES bytes hold equal anchors at equal places. Equal surroundings of an anchor (all bytes
   that a window with it can hold) are pre-aggregated in each task, with their number.
2. Anchors that occur once in the whole table are dropped.
3. The surroundings of the others, each distinct one once with its number, meet by anchor. All
   share the anchor, so it is one symbol of the transform: rows sorted by what follows it, their
   preceding bytes are the BWT's column. Common prefixes of neighbours come by increasing value
   from the step at which their interval is split, and stay the least along what lies between when
   intervals of rows are extended backwards one byte at a time, breadth first, by a stable sort
   within the interval (the LF mapping); they are only known up to the threshold. After t
   steps, neighbours whose remainder of MIN_BYTES - K - t following bytes is common share a
   string of MIN_BYTES bytes that begins t bytes before the anchor. Intervals of one row end.
   Extension stops at MIN_BYTES - K.
   An anchor with more than ``PART`` distinct surroundings is split: strings that begin up to half
   way before it share the second half of what follows, the others the first half of what precedes,
   so each row goes to two groups by those bytes, and on in halves while a group is too large. The
   work for a hot anchor grows with its rows, not their square; what is left at a single place shares
   the whole string.
4. The covered ranges, at most one per anchor, return to their documents and are merged.

Defined cases: null text is empty (nothing removed, the digest of no bytes); texts shorter than
the threshold lose nothing; repeated rows are copies of each other; documents are told apart by
doc_id (a 64-bit hash of the text where it is null) and a checksum of the text, so rows that share
both have the same result; an empty table gives no rows; other columns pass through ``dedup``
whatever their names (``clean`` and ``removed`` are replaced).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

MIN_BYTES, K, PART = 200, 100, 20_000
_CHUNK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * _CHUNK)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best(x[i:i + width]) for all i, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(values: list[bytes], min_bytes: int = MIN_BYTES, k: int = K) -> tuple[np.ndarray, ...]:
    """Of all values: number of the value, place, hash of the anchor, hash of its surroundings."""
    width, side = min_bytes - k + 1, min_bytes - k
    sizes = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < min_bytes:
        return none
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_symbols()[data] * power[:n], out=prefix[1:])
    hashes = _mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])
    short = (hashes >> _U(32)).astype(np.uint32)
    ends = np.cumsum(sizes)
    # windows that cross a value's end choose nothing: 0 is below every minimum that is looked for
    least = _sliding(short, width, np.minimum)
    whole = np.ones(len(least), bool)
    cross = np.concatenate([np.arange(max(0, e - min_bytes + 1), min(e, len(least))) for e in ends[:-1].tolist()] or [np.zeros(0, np.int64)])
    whole[cross] = False
    lifted = np.where(whole, least.astype(np.int64), -1)
    padded = np.concatenate([np.full(width - 1, -1, np.int64), lifted, np.full(width - 1, -1, np.int64)])
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(short)] >= short)
    if not len(chosen):
        return none
    owner = np.searchsorted(ends, chosen, "right")
    start = ends[owner] - sizes[owner]
    low, high = np.maximum(start, chosen - side), np.minimum(ends[owner], chosen + k + side)
    shape = (chosen - low).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (high - low).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    around = _mix((prefix[high] - prefix[low]) * inverse[low] + shape)
    return owner, chosen - start, hashes[chosen], around


def _packed(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray) -> bytes:
    return np.rec.fromarrays([ids, crcs, places], dtype="<i8,<u4,<u4").tobytes()


SEEN = "a long, c long, n long, uid long, crc long, at long, more binary"


def _anchor_rows(documents: DataFrame, min_bytes: int, k: int) -> DataFrame:
    """Anchors with equal surroundings once a task: the first occurrence, and the rest packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def made() -> pa.RecordBatch:
            uid, crc, at, a, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, uid, c, a))
            uid, crc, at, a, c = (x[order] for x in (uid, crc, at, a, c))
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            number = np.diff(np.append(first, len(a)))
            more: list[bytes | None] = [None] * len(first)
            for i in np.flatnonzero(number > 1).tolist():
                lo, hi = first[i] + 1, first[i] + number[i]
                more[i] = _packed(uid[lo:hi], crc[lo:hi], at[lo:hi])
            columns = [a[first].view(np.int64), c[first].view(np.int64), number, uid[first], crc[first].astype(np.int64), at[first]]
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], pa.array(more, pa.binary())], [x.split()[0] for x in SEEN.split(", ")])

        for batch in batches:
            ids = batch.column("uid").to_numpy(zero_copy_only=False)
            raws = common.text_bytes(batch.column("raw"))
            for lo, hi in common.slices(raws, _CHUNK):
                owner, at, a, c = anchors(raws[lo:hi], min_bytes, k)
                if len(owner):
                    crc = np.array([zlib.crc32(r) for r in raws[lo:hi]], np.uint32)
                    held.append((ids[lo:hi][owner], crc[owner], at, a, c))
                    count += len(at)
                if count >= 500_000:
                    yield made()
                    held, count = [], 0
        if held:
            yield made()

    source = documents.select(_uid().alias("uid"), F.col("text").cast("binary").alias("raw"))
    return common.map_batches(source, work, SEEN)


def _common_after(group: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by group and what follows the anchor; for each, the bytes it shares with the one before (-1: another group).

    Intervals of rows are refined byte by byte: neighbours that part at step v share v bytes, and
    intervals of one row are left alone.
    """
    side = right.shape[1]
    rows = np.argsort(group, kind="stable")
    joined = np.concatenate([[False], group[rows][1:] == group[rows][:-1]])  # still in one interval with the row before
    shared = np.where(joined, side, -1).astype(np.int32)
    for v in range(side):
        at = np.flatnonzero(joined | np.append(joined[1:], False))
        if not len(at):
            break
        own = rows[at]
        symbol = np.where(n_right[own] > v, right[own, v].astype(np.int64) + 1, 0)  # 0: nothing follows any more
        order = np.argsort(np.cumsum(~joined[at]) * 257 + symbol, kind="stable")
        rows[at], symbol = own[order], symbol[order]
        parts = joined[at] & (np.concatenate([[-1], symbol[:-1]]) != symbol) | joined[at] & (symbol == 0)
        shared[at[parts]] = v
        joined[at[parts]] = False
    return rows, shared


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first:last + 1]) for each pair of places."""
    out = values[last].copy()
    width = last - first + 1
    level, table = 0, values
    while len(width) and (1 << level) <= width.max():
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        here = np.flatnonzero((width >> level) == 1)  # the largest power of two within the range
        out[here] = np.minimum(table[first[here]], table[last[here] - (1 << level) + 1])
        level += 1
    return out


def expand(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, number: np.ndarray, least: np.ndarray | int = 0, most: np.ndarray | int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest number of bytes before the anchor at which a repeated string begins.

    Rows: anchor, bytes before it (nearest first) and after it, both padded, their true numbers,
    how often the surroundings occur, and between which numbers of bytes hits count.
    (side + 1, -1) where nothing repeats.
    """
    side = left.shape[1]
    n = len(group)
    low, high = np.full(n, side + 1, np.int32), np.full(n, -1, np.int32)
    if not n:
        return low, high
    least, most = np.broadcast_to(least, n), np.broadcast_to(side if most is None else most, n)
    rows, shared = _common_after(group, right, n_right)
    interval = np.cumsum(shared < 0)
    for t in range(side + 1):
        # strings that begin t bytes before the anchor
        new = (shared < side - t) | np.concatenate([[True], interval[1:] != interval[:-1]])
        run = np.cumsum(new) - 1
        fits = n_right[rows] >= side - t
        again = fits & (np.bincount(run, weights=number[rows] * fits)[run] >= 2)
        hit = rows[again & (least[rows] <= t) & (t <= most[rows])]
        low[hit] = np.minimum(low[hit], t)
        high[hit] = t
        if t == side:
            break
        # rows that still have a byte before them and company in their interval, or copies
        size = np.bincount(interval)[interval]
        live = np.flatnonzero((n_left[rows] > t) & ((size > 1) | (number[rows] > 1)))
        if not len(live):
            break
        key = interval[live].astype(np.int64) * 256 + left[rows[live], t]
        order = np.argsort(key, kind="stable")
        key, old = key[order], live[order]
        rows, apart = rows[old], np.concatenate([[True], key[1:] != key[:-1]])
        interval = np.cumsum(apart)
        near = np.flatnonzero(~apart)
        between = _least_between(shared, old[near - 1] + 1, old[near])
        shared = np.full(len(rows), -1, np.int32)
        shared[near] = between
    return low, high


def _uid() -> Column:
    """A document's number; without one, a hash of its text stands for it."""
    return F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))


def _press(documents: DataFrame, columns: list[str], uid: str, crc: str, packed: str) -> DataFrame:
    """The columns, number and checksum, and texts compressed before they travel (null stays null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raws = batch.column(packed).to_pylist()
            crcs = pa.array([zlib.crc32(r or b"") for r in raws], pa.int64())
            small = pa.array([None if r is None else press.compress(r) for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], batch.column(uid), crcs, small], [*columns, uid, crc, packed])

    source = documents.select(*columns, _uid().alias(uid), F.col("text").cast("binary").alias(packed))
    added = T._parse_datatype_string(f"`{crc}` long, `{packed}` binary")
    return common.map_batches(source, work, T.StructType([*source.drop(packed).schema.fields, *added.fields]))


def _surroundings(documents: DataFrame, chosen: DataFrame, side: int, k: int) -> DataFrame:
    """a, c, n, d and the bytes around (not of) the anchor of the chosen occurrences."""
    listed = chosen.groupBy("uid", "crc").agg(F.collect_list(F.struct("at", "a", "c", "n", "d")).alias("marks"))
    joined = _press(documents, [], "uid", "crc", "packed").join(listed.hint("shuffle_hash"), ["uid", "crc"]).select("packed", "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpress = zstandard.ZstdDecompressor()
            raws = [unpress.decompress(r) if r else b"" for r in batch.column("packed").to_pylist()]
            marks = batch.column("marks")
            offsets, flat = marks.offsets.to_numpy(), marks.flatten()
            shift = offsets[0]
            fields = {name: flat.field(i).to_numpy(zero_copy_only=False) for i, name in enumerate(("at", "a", "c", "n", "d"))}
            for i, raw in enumerate(raws):
                lo, hi = offsets[i] - shift, offsets[i + 1] - shift
                cut = [raw[max(0, at - side) : at] + raw[at + k : at + k + side] for at in fields["at"][lo:hi].tolist()]
                begin = np.minimum(fields["at"][lo:hi], side)
                yield pa.RecordBatch.from_arrays([*[pa.array(fields[f][lo:hi], pa.int64()) for f in "acnd"], pa.array(begin, pa.int64()), pa.array(cut, pa.binary())], ["a", "c", "n", "d", "begin", "cut"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in work(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return common.map_batches(joined, gathered, "a long, c long, n long, d long, begin long, cut binary")


TEAMS = "a long, c long, n long, begin long, cut binary, least int, most int, team long"


def _teams(around: DataFrame, side: int, part: int, hot: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``TEAMS``, no team above ``part`` rows; and a, c, low, high of what is found on the way."""
    columns = [c.split()[0] for c in TEAMS.split(", ")]
    whole = around.withColumns({"least": F.lit(0), "most": F.lit(side), "team": F.col("a")})
    if not hot:
        return whole.select(columns), None
    small, found = whole.where(F.col("d") <= part).select(columns), None
    rest = whole.where(F.col("d") > part).select(columns)
    while not rest.isEmpty():  # at most the logarithm of `side` turns
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        halves = F.array(F.struct(F.col("least").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("most").alias("hi")))
        split = rest.select("a", "c", "n", "begin", "cut", F.explode(halves).alias("half")).select("a", "c", "n", "begin", "cut", F.col("half.lo").alias("least"), F.col("half.hi").alias("most"))
        # a row without a whole string in the range goes
        split = split.where((F.col("begin") >= F.col("least")) & (F.length("cut") - F.col("begin") >= side - F.col("most")))
        before, after = F.expr("substring(cut, int(begin) - least + 1, least)"), F.expr(f"substring(cut, int(begin) + 1, {side} - most)")
        split = common.materialise(split.withColumn("team", F.xxhash64("a", "least", "most", before, after)).select(columns))
        sizes = split.groupBy("team").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
        sized = split.join(sizes.hint("merge"), "team")
        single = F.col("least") == F.col("most")  # all rows of such a team share the whole string
        same = sized.where(single & (F.col("total") > 1)).select("a", "c", F.col("least").cast("long").alias("low"), F.col("most").cast("long").alias("high"))
        found = same if found is None else found.union(same)
        small = small.union(sized.where(~single & (F.col("size") <= part) & (F.col("total") > 1)).select(columns))
        rest = common.materialise(sized.where(~single & (F.col("size") > part)).select(columns))
    return small, found


def _meet(around: DataFrame, side: int, part: int, hot: bool) -> DataFrame:
    """a, c, low, high of all surroundings, by groups of one anchor (or of bytes around it)."""
    split, found = _teams(around, side, part, hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            get = lambda name: whole.column(name).to_numpy()
            cuts = whole.column("cut").to_pylist()
            begin, n = get("begin"), len(cuts)
            left, right = np.zeros((n, side), np.uint8), np.zeros((n, side), np.uint8)
            after = np.array([len(x) for x in cuts]) - begin
            for i, (x, b, f) in enumerate(zip(cuts, begin.tolist(), after.tolist())):
                row = np.frombuffer(x, np.uint8)
                left[i, :b] = row[:b][::-1]
                right[i, :f] = row[b:]
            low, high = expand(get("team"), left, right, begin, after, get("n"), get("least"), get("most"))
            good = high >= 0
            return pa.RecordBatch.from_arrays([pa.array(x[good], pa.int64()) for x in (get("a"), get("c"), low, high)], ["a", "c", "low", "high"])

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:  # sorted by team: solve whole teams, about PART rows at a time
            teams = batch.column("team").to_numpy()
            if size + batch.num_rows >= part and len(teams):
                ends = np.flatnonzero(teams[1:] != teams[:-1]) + 1
                if last is not None and teams[0] != last and size:
                    yield solved(held)
                    held, size = [], 0
                if len(ends):
                    held.append(batch.slice(0, int(ends[-1])))
                    yield solved(held)
                    held, size = [], 0
                    batch = batch.slice(int(ends[-1]))
            held.append(batch)
            size += batch.num_rows
            last = teams[-1] if len(teams) else last
        if size:
            yield solved(held)

    met = common.map_batches(split.repartition(F.col("team")).sortWithinPartitions("team"), work, "a long, c long, low long, high long")
    return met if found is None else met.union(found)


def repeated_ranges(documents: DataFrame, min_bytes: int = MIN_BYTES, k: int = K, part: int = PART) -> DataFrame:
    """uid, crc, ranges: array of (begin, end) byte ranges to remove, one per anchor, unmerged."""
    spark = documents.sparkSession
    side = min_bytes - k
    seen = _anchor_rows(documents, min_bytes, k).selectExpr("*", "sum(n) over (partition by a) as total", "count(*) over (partition by a) as d")
    seen = common.materialise(seen.where("total > 1").drop("total"))
    common.free_shuffles(spark)
    firsts = seen.groupBy("a", "c").agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.min(F.struct("uid", "crc", "at")).alias("f"))
    chosen = firsts.select("a", "c", "n", "d", "f.uid", "f.crc", "f.at")
    hot = not seen.where(F.col("d") > part).isEmpty()
    around = _surroundings(documents, chosen, side, k)
    if hot:  # read several times then; without, it goes straight into its groups
        around = common.materialise(around)
        common.free_shuffles(spark)
    found = _meet(around, side, part, hot)
    found = common.materialise(found.groupBy("a", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    common.free_shuffles(spark)
    back = seen.drop("n", "d").join(found.hint("shuffle_hash"), ["a", "c"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, crc, at, low, high = (batch.column(x).to_numpy() for x in ("uid", "crc", "at", "low", "high"))
            packed = batch.column("more").to_pylist()
            rest = [np.frombuffer(m, "<i8,<u4,<u4") if m else None for m in packed]
            times = np.array([0 if r is None else len(r) for r in rest])
            if times.any():
                tail = np.concatenate([r for r in rest if r is not None])
                uid, crc, at = (np.concatenate([x, tail[f].astype(np.int64)]) for x, f in ((uid, "f0"), (crc, "f1"), (at, "f2")))
                low, high = (np.concatenate([x, np.repeat(x, times)]) for x in (low, high))
            # neighbours in a document mostly overlap: merge what this batch holds
            begin, end = at - high, at - low + min_bytes
            order = np.lexsort((begin, crc, uid))
            uid, crc, begin, end = (x[order] for x in (uid, crc, begin, end))
            if len(uid):
                owner = np.concatenate([[0], np.cumsum((uid[1:] != uid[:-1]) | (crc[1:] != crc[:-1]))])
                reach = np.maximum.accumulate(end + owner * (1 << 40))
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (begin[1:] + owner[1:] * (1 << 40) > reach[:-1])])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(uid)) - 1
                uid, crc, begin, end = uid[first], crc[first], begin[first], reach[last] - owner[last] * (1 << 40)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, crc, begin, end)], ["uid", "crc", "begin", "end"])

    spread = common.map_batches(back, unpack, "uid long, crc long, begin long, end long")
    return spread.groupBy("uid", "crc").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _apply(documents: DataFrame, columns: list[str], schema: T.StructType, produce: Callable, min_bytes: int, k: int, part: int) -> DataFrame:
    """``produce(batch, texts as bytes or None, bytes left, merged ranges)`` over the documents with their ranges."""
    uid, crc, packed, found = (common.unused(n, columns, schema.names) for n in ("uid", "crc", "packed", "ranges"))
    ranges = repeated_ranges(documents, min_bytes, k, part).toDF(uid, crc, found)
    joined = _press(documents, columns, uid, crc, packed).join(ranges.hint("shuffle_hash"), [uid, crc], "left").select(*columns, packed, found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            raws = [None if r is None else unpress.decompress(r) for r in batch.column(packed).to_pylist()]
            spans_of, cleaned = [], []
            for raw, ranges in zip(raws, batch.column(found).to_pylist()):
                raw = raw or b""
                spans = _merged([(r["begin"], r["end"]) for r in ranges or ()])
                kept, at = [], 0
                for begin, end in spans:
                    kept.append(raw[at:begin])
                    at = end
                cleaned.append(b"".join([*kept, raw[at:]]) if spans else raw)
                spans_of.append(spans)
            yield produce(batch, raws, cleaned, spans_of)

    return common.map_batches(joined, work, schema)


def dedup(documents: DataFrame, min_bytes: int = MIN_BYTES, k: int = K, part: int = PART) -> DataFrame:
    """The documents with ``clean`` (the bytes left) and ``removed`` (array of byte ranges begin, end)."""
    columns = [c for c in documents.columns if c not in ("clean", "removed")]
    others = [c for c in columns if c != "text"]
    added = T._parse_datatype_string("clean binary, removed array<struct<begin:long,end:long>>")
    schema = T.StructType([*documents.select(*columns).schema.fields, *added.fields])
    target = to_arrow_schema(schema)

    def produce(batch: pa.RecordBatch, raws: list, cleaned: list[bytes], spans: list) -> pa.RecordBatch:
        texts = pa.array([None if r is None else r.decode("utf-8", "replace") for r in raws], pa.string())
        made = [pa.array(cleaned, pa.binary()), pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], target.field("removed").type)]
        kept = [texts if c == "text" else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*[x.cast(target.field(c).type) for x, c in zip(kept, columns)], *made], schema=target)

    return _apply(documents, others, schema, produce, min_bytes, k, part)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = T._parse_datatype_string(kinds)

    def produce(batch: pa.RecordBatch, raws: list, cleaned: list[bytes], spans: list) -> pa.RecordBatch:
        gone = [sum(e - b for b, e in s) for s in spans]
        columns = [[len(c) + g for c, g in zip(cleaned, gone)], gone, [len(s) for s in spans]]
        digests = pa.array([hashlib.sha256(c).hexdigest() for c in cleaned], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], digests], schema.names)

    return _apply(documents, ["doc_id"], schema, produce, MIN_BYTES, K, PART)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated strings go from the texts; every document stays, with n_chars of what is left."""
    target, columns = docs.schema, [c for c in docs.columns if c not in ("text", "n_chars")]
    arrow = to_arrow_schema(target)

    def produce(batch: pa.RecordBatch, raws: list, cleaned: list[bytes], spans: list) -> pa.RecordBatch:
        texts = [None if r is None else c.decode("utf-8", "ignore") for r, c in zip(raws, cleaned)]
        made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
        return pa.RecordBatch.from_arrays([(made[n] if n in made else batch.column(n)).cast(arrow.field(n).type) for n in arrow.names], schema=arrow)

    return _apply(docs, columns, target, produce, MIN_BYTES, K, PART)


#: every string of MIN_BYTES bytes by its digest; texts are taken as hex digits, in blocks, so that no position is sought from a text's start
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), cut AS (SELECT doc_id, b::BIGINT AS base, substr(h, 2 * b + 1, 2 * {4096 + MIN_BYTES - 1}) AS part FROM d, unnest(range(0, greatest(length(h) // 2, 1), 4096)) r(b)
), w AS (SELECT doc_id, base + o AS i, md5_number(substr(part, 2 * o + 1, {2 * MIN_BYTES})) AS k FROM cut, unnest(range(0, least(4096, length(part) // 2 - {MIN_BYTES - 1}))) r(o)
), twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1
), hit AS (SELECT doc_id, i FROM w SEMI JOIN twice USING (k)
), mark AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {MIN_BYTES} THEN 0 ELSE 1 END AS new FROM hit
), run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM mark
), span AS (SELECT doc_id, n, min(i) AS lo, max(i) + {MIN_BYTES} AS hi FROM run GROUP BY 1, 2
), gap AS (SELECT doc_id, n, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY n), 0) AS before FROM span
), kept AS (
  SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, list(lo ORDER BY n) AS los, list(before ORDER BY n) AS befores FROM gap GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(list_aggregate(list_transform(range(1, len(los) + 1), lambda x: substr(h, (2 * befores[x] + 1)::BIGINT, (2 * (los[x] - befores[x]))::BIGINT)), 'string_agg', ''), '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
