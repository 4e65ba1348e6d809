"""Operator 11, audit of how sources of a language diverge from each other in their terms.

Every (lang, source) group and every language gives each kept term a share p in billionths,
smoothed by one; the divergence of two shares is floor((p - q)^2 / q), in whole numbers all the way.

Documents are counted in tasks, many at a time, so a frequent term or a source with a third of
all rows reaches a shuffle as one row a task. Kept terms fall into blocks by hash, sources into
tiles, and a (language, pair of tiles, block) is a dense int64 matrix of shares, source by term, in
which all pairs are broadcast at once. A task adds up the pair matrices of its blocks and keeps one
heap of best terms for each group; partial matrices are summed and heaps merged afterwards. A
matrix has about ``TILE`` x ``BLOCK`` cells whatever the corpus.

Defined cases: null text, lang and source are empty; a document without a term still makes its
group occur; a language without a kept term gives pairs of value 0 and no terms; repeated rows
count each; ties go to the item that is first in UTF-8; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST, TOP, UNIT = 3, 200, 1_000_000_000
BLOCK, TILE, CELLS = 2048, 256, 1 << 21
_WAITING, _WAITING_BYTES = 400_000, 32 << 20
#: byte -> the same in lower case, or a blank outside terms
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split(b" ") if raw else []


def counts(documents: DataFrame) -> DataFrame:
    """Partial rows lang, source, term, n (occurrences), docs (documents), from every task; sums over them are exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        waiting = size = 0

        def made() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in groups.items():
                words, pairs = list(found), list(found.values())
                for at in range(0, len(words), 50_000):
                    part, both = words[at : at + 50_000], np.array(pairs[at : at + 50_000], np.int64)
                    same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(part), np.int32))) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part, pa.binary()).cast(pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, raw in zip(keys, common.text_bytes(batch.column("raw"))):
                own = groups.setdefault(key, {})
                found = Counter(terms(raw))
                found.pop(b"", None)
                for term, n in found.items():
                    have = own.get(term)
                    if have is None:
                        own[term] = [n, 1]
                        waiting += 1
                        size += len(term)
                    else:
                        have[0] += n
                        have[1] += 1
                if waiting > _WAITING or size > _WAITING_BYTES:
                    yield from made()
                    waiting = size = 0
        yield from made()

    return common.map_batches(documents, count, "lang string, source string, term string, n long, docs long")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), exact in int64 for totals below 2**63 / 1000."""
    n = n + 1
    if int(n.max(initial=0)) <= (1 << 63) // UNIT - 1:
        return 1 + n * UNIT // total
    out, rest = np.zeros_like(n), n
    whole, rest = rest // total, rest % total
    out += whole
    for _ in range(3):  # three digits at a time
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // q


def pair_sums(p: np.ndarray, q: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """[group, other group]: divergence of rows of ``p`` from rows of ``q``, summed over terms (columns)."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, cells // max(1, len(p) * len(q)))
    for at in range(0, p.shape[1], step):
        out += divergence(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return out


class _Tiles:
    """What a task gathers for one (language, pair of tiles) from its blocks."""

    def __init__(self, key: tuple, top: int):
        self.lang, self.low, self.high = key
        self.top = top
        self.sums: dict[bool, np.ndarray] = {}
        self.names: tuple[list[str], list[str]] = ([], [])
        self.heaps: dict[str, list[tuple[int, str]]] = {}

    def add(self, block: pa.Table) -> None:
        columns = {c: block.column(c) for c in ("tile", "source", "term", "n", "total", "terms", "lang_total", "block_terms")}
        head = np.flatnonzero(columns["term"].is_null().to_numpy())
        cells = np.flatnonzero(columns["term"].is_valid().to_numpy())
        tile, n, total = (columns[c].to_numpy() for c in ("tile", "n", "total"))
        named = columns["source"].combine_chunks().dictionary_encode()
        names, source = named.dictionary.to_pylist(), named.indices.to_numpy()
        if not len(head):
            raise ValueError("a block without its groups")
        of_block = int(columns["block_terms"][int(head[0])].as_py())
        kept, of_lang = int(columns["terms"][int(head[0])].as_py()), int(columns["lang_total"][int(head[0])].as_py())
        sides = [sorted((r for r in head if tile[r] == t), key=lambda r: names[source[r]]) for t in dict.fromkeys((self.low, self.high))]
        self.names = tuple([names[source[r]] for r in side] for side in (sides[0], sides[-1]))
        word = columns["term"].combine_chunks().take(pa.array(cells)).dictionary_encode()
        column, width = word.indices.to_numpy(), len(word.dictionary)
        share, absent, own_total = [], [], np.zeros(len(names), np.int64)
        own_total[source[head]] = total[head]
        for side in sides:
            row = np.full(len(names), -1)
            row[source[side]] = np.arange(len(side))
            dense = np.zeros((len(side), width), np.int64)
            at = row[source[cells]]
            mine = at >= 0
            dense[at[mine], column[mine]] = n[cells][mine]
            share.append(shares(dense, np.maximum(total[side] + kept, 1)[:, None]))
            # the block's terms that no source of these tiles has are alike
            absent.append(shares(np.zeros((len(side), 1), np.int64), np.maximum(total[side] + kept, 1)[:, None]))
        for turned in {False, len(sides) > 1}:
            own, other = (-1, 0) if turned else (0, -1)
            found = pair_sums(share[own], share[other]) + (of_block - width) * pair_sums(absent[own], absent[other])
            self.sums[turned] = self.sums.get(turned, 0) + found
        if len(cells) and self.low == self.high:
            p = shares(n[cells], own_total[source[cells]] + kept)
            q = shares(total[cells], np.int64(of_lang + kept))
            self._best(p, q, source[cells], names, column, word.dictionary)

    def _best(self, p: np.ndarray, q: np.ndarray, source: np.ndarray, names: list[str], column: np.ndarray, words: pa.Array) -> None:
        more = np.flatnonzero(p > q)
        value = divergence(p[more], q[more])
        order = np.argsort(source[more], kind="stable")
        more, value = more[order], value[order]
        cuts = np.flatnonzero(np.diff(source[more])) + 1
        for part, found in zip(np.split(more, cuts), np.split(value, cuts)):
            if not len(part):
                continue
            heap = self.heaps.setdefault(names[source[part[0]]], [])
            floor = -heap[-1][0] if len(heap) >= self.top else 0
            if len(found) > self.top:
                floor = max(floor, int(np.partition(found, len(found) - self.top)[len(found) - self.top]))
            good = found >= floor
            items = words.take(pa.array(column[part[good]])).to_pylist()
            heap[:] = heapq.nsmallest(self.top, heap + list(zip((-found[good]).tolist(), items)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for turned, sums in self.sums.items():
            own, other = self.names[turned], self.names[not turned]
            a, b = np.nonzero(np.array(own, object)[:, None] != np.array(other, object)[None, :]) if len(own) and len(other) else (np.zeros(0, int),) * 2
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                yield self._batch([own[i] for i in x], "pair", [other[i] for i in y], sums[x, y])
        for name, heap in self.heaps.items():
            yield self._batch([name] * len(heap), "term", [x[1] for x in heap], np.array([-x[0] for x in heap], np.int64))

    def _batch(self, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
        size = len(source)
        texts = [pa.array(x, pa.string()) for x in ([self.lang] * size, source, [part] * size, item)]
        return pa.RecordBatch.from_arrays([*texts, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of a sorted stream, group by group."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key)
            changed |= ~np.asarray(pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
        starts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(batch.column(k)[lo].as_py() for k in keys)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def divergences(documents: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank."""
    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("binary").alias("raw"))
    over = Window.partitionBy("lang", "term")
    # dealt by (lang, term): sums, document frequencies and the filter need no other shuffle
    counted = counts(named).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.select("lang", "source", "term", "n", F.sum("docs").over(over).alias("docs"), F.sum("n").over(over).alias("total"), F.row_number().over(over.orderBy("source")).alias("place"))
    kept = common.materialise(counted.where(F.col("docs") >= least).drop("docs"))

    groups = named.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    groups = groups.unionByName(kept.select("lang", "source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    languages = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("lang_total"))
    terms_of = kept.where("place = 1").groupBy("lang").agg(F.count("*").alias("terms"))
    languages = common.materialise(languages.join(terms_of, "lang", "left").na.fill(0, ["terms"]))

    tiles, blocks = F.ceil(F.col("sources") / tile).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")
    own = F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile")
    pair = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    other = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    nothing = F.lit(None).cast("long")
    cells = kept.join(languages, "lang").select("lang", "source", "term", "n", "total", own, other, F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"))
    cells = cells.select("lang", *pair, "block", "tile", "source", "term", "n", "total", *(nothing.alias(c) for c in ("terms", "lang_total", "block_terms")))
    sizes = kept.where("place = 1").join(languages, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")).agg(F.count("*").alias("block_terms"))
    heads = groups.join(languages, "lang").select("lang", "source", "n", "terms", "lang_total", own, other, blocks.alias("blocks"))
    heads = heads.select("lang", *pair, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tile", "source", "n", "terms", "lang_total")
    heads = heads.select("lang", "low", "high", "block", "tile", "source", F.lit(None).cast("string").alias("term"), nothing.alias("n"), F.col("n").alias("total"), "terms", "lang_total")
    heads = heads.join(sizes, ["lang", "block"], "left").na.fill(0, ["block_terms"])
    keys = ["lang", "low", "high", "block"]
    dealt = cells.unionByName(heads).withColumn("n", F.coalesce("n", F.lit(0))).repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Tiles | None = None
        for (lang, low, high, _), rows in _sorted_groups(batches, keys):
            if own is None or (own.lang, own.low, own.high) != (lang, low, high):
                if own is not None:
                    yield from own.rows()
                own = _Tiles((lang, low, high), top)
            own.add(rows)
        if own is not None:
            yield from own.rows()

    found = common.materialise(common.map_batches(dealt, work, "lang string, source string, part string, item string, value long"))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(found.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
