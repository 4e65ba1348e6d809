"""Operator 10, document fingerprints by a randomised edit embedding.

A text is embedded by a random walk: at step j the walk writes the character under its cursor,
and a shared random bit of (j, character) says if the cursor moves. Texts at a small edit
distance soon walk in step again, so edit distance becomes Hamming distance of what was written.
The fingerprint samples the written string: a dyadic tree over the steps has one random step for
each of its nodes, a node's step being that of one of its children, so fingerprints of texts of
different lengths are compared on the samples of the coarser level. A sample is ``SYMBOL_BITS``
bits of a hash of the last written characters. Equal texts have equal fingerprints.

Walks run in step over many texts (one vector operation per character position), and the edited
text continues from the walk that its own text had at the point of the edit.

Defined cases: null text is empty (fingerprint of no samples; two empty texts have likeness 1, an
empty and another 0); documents are taken in order of doc_id, null first, then text, so rows
with equal doc_id follow each other; one row alone is its own next; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLES = 128
CLASSES, PERIOD, MARGIN, FEW = 256, 1 << 14, 64, 24
BANDS, BAND_SAMPLES, LIKE = 32, 4, 0.8
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _stay() -> np.ndarray:
    """[class, step mod PERIOD] -> steps the walk takes on that character, 1 at least."""
    cells = np.arange(CLASSES, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(PERIOD, dtype=np.uint64)[None]
    moves = (_mix(cells + np.uint64(0x51ED270B)) & np.uint64(1)).astype(bool)
    out = np.zeros((CLASSES, PERIOD), np.int32)
    run = np.full(CLASSES, MARGIN, np.int32)  # the bits repeat, so two turns settle every cell
    for _ in range(2):
        for j in range(PERIOD - 1, -1, -1):
            run = np.where(moves[:, j], 1, np.minimum(run + 1, MARGIN))
            out[:, j] = run
    return out.astype(np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walk(codes: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text, the step at which each character is first written; ``starts``: the first's."""
    stay = _stay().ravel()
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(sizes[order])])
    flat = np.concatenate([codes[i] for i in order]) if len(codes) else np.zeros(0, "<u4")
    cells = ((_mix(flat) & np.uint64(CLASSES - 1)).astype(np.int32) * PERIOD) if len(flat) else np.zeros(0, np.int32)
    steps = np.empty(len(flat), np.int64)
    now = np.array(starts, np.int64)[order]
    live = len(order)
    at = offsets[:-1].copy()
    longest = int(sizes.max(initial=0))
    lives = np.searchsorted(-sizes[order], -np.arange(longest), "left") if longest else []
    mask = PERIOD - 1
    for i in range(longest):
        if lives[i] != live:
            live = int(lives[i])
            at, now = at[:live], now[:live]
            if live <= FEW:
                break
        steps[at] = now
        now = now + stay[cells[at] + (now & mask)]
        at = at + 1
    if live <= FEW:  # the few longest go on one by one
        table = stay.tobytes()
        for place in range(live):
            step, written = int(now[place]), []
            for cell in cells[at[place] : offsets[place + 1]].tolist():
                written.append(step)
                step += table[cell + (step & mask)]
            steps[at[place] : offsets[place + 1]] = written
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    for place, i in enumerate(order):
        out[i] = steps[offsets[place] : offsets[place + 1]]
    return out


def _level(length: int) -> int:
    level = 0
    while (length >> level) >= 2 * SAMPLES:
        level += 1
    return level


def _step_of(level: int, count: int) -> np.ndarray:
    at = np.arange(count, dtype=np.uint64)
    for low in range(level, 0, -1):
        at = at * np.uint64(2) + (_mix(at + np.uint64(low << 40)) & np.uint64(1))
    return at.astype(np.int64)


@lru_cache(maxsize=64)
def _sampled(level: int) -> np.ndarray:
    return _step_of(level, 2 * SAMPLES + 1)


def sample(codes: np.ndarray, steps: np.ndarray) -> str:
    """Fingerprint of one text from its walk: level (2 hex digits), then 2 hex digits a sample."""
    if not len(codes):
        return ""
    length = int(steps[-1]) + 1
    level = _level(length)
    at = _sampled(level)
    at = at[at < length]
    char = np.searchsorted(steps, at, "right") - 1
    value = np.zeros(len(char), np.uint64)
    for back in range(4):  # the last four characters that the walk wrote up to the sampled step
        value = _mix(value + np.where(char >= back, codes[np.maximum(char - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)))
    return f"{level:02x}" + (value & np.uint64(255)).astype(np.uint8).tobytes().hex()


def _coarser(values: np.ndarray, level: int, to: int) -> np.ndarray:
    while level < to:
        level += 1
        child = np.arange((len(values) + 1) // 2, dtype=np.uint64)
        at = (child * np.uint64(2) + (_mix(child + np.uint64(level << 40)) & np.uint64(1))).astype(np.int64)
        values = values[at[at < len(values)]]
    return values


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the coarser level, less what chance gives; 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    level = max(x[0], y[0])
    x, y = _coarser(x[1:], int(x[0]), int(level)), _coarser(y[1:], int(y[0]), int(level))
    both = min(len(x), len(y))
    return float((x[:both] == y[:both]).sum() / max(len(x), len(y), 1))


def fingerprints(texts: list[str]) -> list[str]:
    codes = [_codes(t) for t in texts]
    return [sample(c, s) for c, s in zip(codes, walk(codes, [0] * len(codes)))]


def _compare(rows: list[tuple], last: bool) -> list[tuple]:
    """Result rows for all of ``rows`` (doc_id, text) but the last, which is only a next document."""
    codes = [_codes(t) for _, t in rows]
    steps = walk(codes, [0] * len(codes))
    prints = [sample(c, s) for c, s in zip(codes, steps)]
    stay = _stay()
    tails, starts, heads = [], [], []
    for k in range(len(rows) - 1):
        n = len(codes[k])
        cut = n // 4
        head = n - cut
        heads.append(head)
        tails.append(codes[k + 1][:cut])
        if not head:
            starts.append(0)
        else:
            at = int(steps[k][head - 1])
            kind = int(_mix(codes[k][head - 1 : head])[0] & np.uint64(CLASSES - 1))
            starts.append(at + int(stay[kind, at & (PERIOD - 1)]))
    out = []
    for k, more in enumerate(walk(tails, starts)):
        doc_id, text = rows[k]
        head = heads[k]
        edited = text[:head] + rows[k + 1][1][: len(text) // 4]
        mark = sample(np.concatenate([codes[k][:head], tails[k]]), np.concatenate([steps[k][:head], more])) if edited else ""
        out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), prints[k], mark, likeness(prints[k], mark), likeness(prints[k], prints[k + 1])))
    return out


def compare_with_next(documents: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and both likenesses.

    Texts travel once, compressed, dealt by ranges of doc_id whose bounds come from a quantile
    sketch; the first document of every range travels to the range before it as well.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"))
    bounds = sorted({int(x) for x in ids.approxQuantile("_key", [i / parts for i in range(1, parts)], 1 / (8 * parts))}) if parts > 1 else []
    cuts = np.array(bounds, np.int64)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            raws = common.text_bytes(batch.column("raw"))
            arrays = [pa.array(np.searchsorted(cuts, keys, "left").astype(np.int32)), batch.column("_key"), batch.column("doc_id"), pa.array([hashlib.md5(r).digest() for r in raws], pa.binary()), pa.array([press.compress(r) for r in raws], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "_key", "doc_id", "tie", "packed"])

    source = common.with_text_bytes(documents, "doc_id").withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    squeezed = common.map_batches(source, squeeze, "part int, _key long, doc_id long, tie binary, packed binary")

    # one row a range: its smallest document (by id, then text digest)
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts_of = np.searchsorted(cuts, batch.column("_key").to_numpy(), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(parts_of), batch.column("_key"), batch.column("tie")], ["part", "_key", "tie"])

    keyed = source.select("_key", F.unhex(F.md5(F.coalesce("raw", F.lit(b"")))).alias("tie"))
    placed = common.map_batches(keyed, place, "part int, _key long, tie binary")
    lowest = placed.groupBy("part").agg(F.min(F.struct("_key", "tie")).alias("low"))
    firsts = sorted((r["part"], r["low"]["_key"], bytes(r["low"]["tie"])) for r in lowest.collect())  # bounded by `parts`
    follower = {firsts[(i + 1) % len(firsts)][1:]: firsts[i][0] for i in range(len(firsts))}

    def with_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {k[0] for k in follower}
        sent: set = set()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(n, np.int32))], [*batch.schema.names, "copy"])
            for i in np.flatnonzero(np.isin(batch.column("_key").to_numpy(), list(wanted))).tolist():
                key = (batch.column("_key")[i].as_py(), batch.column("tie")[i].as_py())
                if key in follower and key not in sent:
                    sent.add(key)
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([follower[key]], pa.int32()), *row.columns[1:], pa.array([1], pa.int32())], [*batch.schema.names, "copy"])

    flagged = common.map_batches(squeezed, with_copies, "part int, _key long, doc_id long, tie binary, packed binary, copy int")
    dealt = flagged.repartitionByRange(parts, "part").sortWithinPartitions("part", "copy", "_key", "tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        size, now, closed = 0, None, False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "packed")]
            for part, copy, doc_id, packed in zip(*columns):
                if part != now:
                    held, size, now, closed = [], 0, part, False
                if closed:
                    continue
                text = unpress.decompress(packed).decode("utf-8", "replace") if packed else ""
                held.append((doc_id, text))
                size += len(text)
                closed = bool(copy)
                if len(held) > 1 and (closed or size >= 4_000_000):
                    yield made(_compare(held, closed))
                    held, size = held[-1:], len(held[-1][1])

    return common.map_batches(dealt, work, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.table(spark, sf_dir, "documents"))


@lru_cache(maxsize=64)
def _band_places(band: int, size: int) -> np.ndarray:
    start = np.arange(BAND_SAMPLES, dtype=np.uint64) + np.uint64(band * 64 + size * 65_536)
    return (_mix(start) % np.uint64(size)).astype(np.int64)


def bands(mark: str) -> list[int]:
    """Hashes of sampled places, at sizes and levels where a text of at least 0.8 of the length also has them."""
    if not mark:
        return [0]
    raw = np.frombuffer(bytes.fromhex(mark), np.uint8)
    level, values = int(raw[0]), raw[1:]
    size = 1 << (len(values).bit_length() - 1)
    cuts = [(level, size, values)] + ([(level, size // 2, values)] if size > 1 else [])
    if size >= SAMPLES:
        cuts.append((level + 1, size // 2, _coarser(values, level, level + 1)))
    out = []
    for at, most, sampled in cuts:
        for band in range(BANDS):
            key = sampled[_band_places(band, most)].tobytes() + bytes([band, at]) + most.to_bytes(2, "little")
            out.append(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True))
    return out


def classes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.table(spark, sf_dir, "documents"))


def near_classes(documents: DataFrame, like: float = LIKE, tile: int = 512) -> DataFrame:
    """doc_id, fingerprint and class_id: the smallest doc_id reachable over likenesses of at least ``like``.

    Copies collapse to one row per fingerprint. Fingerprints that share a band are verified; a band
    with more than ``tile`` of them is cut into pairs of parts, and only a spanning forest's links
    leave a group, so no group is held whole and none gives all its pairs.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [r.decode("utf-8", "replace") for r in common.text_bytes(batch.column("raw"))]
            made: list[str] = []
            for lo, hi in common.slices([t.encode() for t in texts], 4_000_000):
                made += fingerprints(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, mark in zip(batch.column("item").to_pylist(), batch.column("fingerprint").to_pylist()):
                for key in set(bands(mark)):
                    ids.append(i)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["item", "key"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        now = None

        def solved() -> list[tuple[int, int]]:
            rest, found = list(dict.fromkeys(held)), []
            while len(rest) > 1:
                front = [rest.pop(0)]
                while front and rest:
                    i, mark = front.pop()
                    near = [likeness(mark, other) >= like for _, other in rest]
                    hits = [x for x, n in zip(rest, near) if n]
                    rest = [x for x, n in zip(rest, near) if not n]
                    found += [(i, j) for j, _ in hits]
                    front += hits
            return found

        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for i, mark, team in zip(*(batch.column(c).to_pylist() for c in ("item", "fingerprint", "team"))):
                if team != now:
                    if len(held) > 1:
                        yield made(solved())
                    held, now = [], team
                held.append((i, mark))
        yield made(solved() if len(held) > 1 else [])

    prints = common.materialise(common.map_batches(common.with_text_bytes(documents, "doc_id"), marked, "doc_id long, fingerprint string"))
    classes = common.materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("item", F.xxhash64("fingerprint")))
    # keys travel without fingerprints, which are fetched for shared bands alone; bands with the same members are verified once
    rows = common.map_batches(classes.select("item", "fingerprint"), keyed, "item long, key long")
    members = [F.count("*").alias("size"), F.expr("bit_xor(xxhash64(item))").alias("one"), F.expr("bit_xor(xxhash64(item, 1))").alias("two")]
    sizes = rows.groupBy("key").agg(*members).where("size > 1").groupBy("size", "one", "two").agg(F.min("key").alias("key")).select("key", "size")
    rows = rows.join(sizes.hint("merge"), "key").withColumn("parts", F.ceil(F.col("size") / tile).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.col("item"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    team = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    teams = rows.select("item", team.alias("team")).join(classes.select("item", "fingerprint").hint("merge"), "item")
    dealt = teams.select("item", "fingerprint", "team").repartition(F.col("team")).sortWithinPartitions("team")
    roots = common.connected_components(common.map_batches(dealt, linked, "a long, b long"))
    named = common.materialise(classes.join(roots, classes["item"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "item").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    return prints.join(named.join(lowest, "root").select("fingerprint", "class_id").hint("merge"), "fingerprint").select("doc_id", "fingerprint", "class_id")
