"""Operator 4, benchmark decontamination by winnowing (DataFrame functions only).

Words are runs of characters other than ASCII non-alphanumerics, after A-Z is lower-cased. An
item's windows are its runs of ``WINDOW`` consecutive words; a shorter item is one window.

1. Of every ``reach`` consecutive words the ``GRAM``-gram with the smallest hash is kept, with its
   place (the leftmost of equal ones; neighbouring windows mostly keep the same, which counts once).
   ``reach`` is the shortest window of at least ``GRAM`` words that the benchmark has, so every shared
   window holds a kept gram, the same one at the same place of it on both sides.
2. Kept grams of documents are joined with those of the benchmark; each hit is extended to the
   windows around it, whose words are then compared with the benchmark's.
3. Items of fewer than ``GRAM`` words are too short to be winnowed: each is one gram, and all grams
   of that size are looked up in the same pass.

Documents are scanned once. The benchmark's grams and windows are broadcast only if their counted
bytes are at most ``MAX_BROADCAST``; beyond it the same joins shuffle. Windows are joined by their
words, then to items, so a passage that many items share costs a document one row.

Defined cases: null text has no words; repeated rows are judged one by one (a row number tells
them apart, never doc_id); an item with null id is left out of the list of items but its words are
hit; an empty table gives no rows, an empty benchmark no hits; other columns are not read, except
by ``keep_clean``, which returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 10, 5
MAX_BROADCAST = 64 << 20  # bytes
_PLACE = (1 << 30) - 1  # low bits of a gram's value: its place; a text of 2 GB has no more words
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "array<bigint>"


def words_of(text: Column) -> Column:
    # where all characters are ASCII, the cheaper lower() does the same
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # cutting at what is between words; finding the words copies the whole text for each
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN, -1), ""), F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however the optimizer merges projections."""
    return F.transform(F.array(value), body)[0]


def _upto(last: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of 0 ... last; empty if there is none."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), body)).otherwise(F.array().cast(_NONE))


def _grams(hashes: Column, size: int) -> Column:
    """All grams of ``size`` words, given by hashes: a hash in the upper 34 bits, the place in the lower 30."""

    def value(at: Column) -> Column:
        parts = [F.get(hashes, at + i if i else at) for i in range(size)]
        return F.xxhash64(*parts, F.lit(size)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(at.cast("long"))

    return _upto(F.size(hashes) - size, value)


def _kept(hashes: Column, reach: int) -> Column:
    """Grams that are the least of some ``reach`` consecutive words, each once."""
    width = reach - GRAM + 1

    def least(grams: Column) -> Column:
        if width == 1:
            return grams
        return F.array_distinct(_upto(F.size(grams) - width, lambda at: F.least(*[F.get(grams, at + i if i else at) for i in range(width)])))

    return _let(_grams(hashes, GRAM), least)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, words and passage (words joined by a blank): distinct windows of all items."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    cut = items.select("item_id", "size", F.explode(F.expr("transform(sequence(1, size(words) - size + 1), i -> slice(words, i, size))")).alias("words"))
    return cut.withColumn("passage", F.array_join("words", " ")).distinct()


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, key: Column | None = None) -> DataFrame:
    """One row a document: row, key (doc_id), n_words, spans (array of start, size; word numbers from 0), passages (array)."""
    windows = common.materialise(common.compact(item_windows(benchmark, window), 100 * benchmark.count()))
    counted = windows.agg(F.collect_set("size").alias("sizes"), F.sum(F.octet_length("passage") + 64 * F.col("size")).alias("bytes")).first()
    sizes = sorted(counted["sizes"]) or [window]  # at most `window` values
    small = (counted["bytes"] or 0) <= max_broadcast
    tiny, whole = [s for s in sizes if s < GRAM], [s for s in sizes if s >= GRAM]
    reach = min(whole, default=window)

    def values(hashes: Column) -> Column:
        found = [_grams(hashes, size) for size in tiny] + ([_kept(hashes, reach)] if whole else [])
        return F.concat(F.array(F.lit(None).cast("bigint")), *found)

    def listed(df: DataFrame, *keep: str) -> DataFrame:
        made = _let(F.transform("words", lambda word: F.xxhash64(word)), values).alias("all")
        return df.select(*keep, made).select(*keep, F.explode_outer("all").alias("value"))

    # explode_outer, since the optimizer would compute the arrays once more to ask if they are empty;
    # element 0 stands for the document itself, so that one pass also counts its words
    marks = listed(windows).where("value is not null").select(F.shiftright("value", 30).alias("mark")).distinct()
    base = documents.select(F.monotonically_increasing_id().alias("row"), (F.col("doc_id") if key is None else key).alias("key"), "text")
    worded = lambda df, *more: df.select("row", "key", words_of(F.col("text")).alias("words"), *more)
    if small:
        met = listed(worded(base), "row", "key", "words").join(F.broadcast(marks), F.shiftright("value", 30) == F.col("mark"), "left").where("value is null or mark is not null")
    else:  # grams travel alone, each text once
        base = common.materialise(base)
        grams = listed(worded(base), "row").where("value is not null")
        hit = grams.join(marks.hint("merge"), F.shiftright("value", 30) == F.col("mark"), "left_semi").groupBy("row").agg(F.collect_list("value").alias("all"))
        found = worded(base.join(hit.hint("merge"), "row", "left"), F.coalesce("all", F.array().cast(_NONE)).alias("all"))
        met = found.select("row", "key", "words", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), "all")).alias("value"))
    place, number = F.col("value").bitwiseAND(F.lit(_PLACE)).cast("int"), F.size("words")

    def around(size: int) -> Column:
        """Starts of the windows of ``size`` words that hold the gram."""
        low, high = F.greatest(place - max(size - GRAM, 0), F.lit(0)), F.least(place, number - size)
        cut = lambda at: F.struct(at.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice("words", at + 1, size), " ").alias("found"))
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), cut)).otherwise(F.array().cast("array<struct<start:int,size:int,found:string>>"))

    itself = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("found")))
    met = met.select("row", "key", number.alias("n_words"), F.explode_outer(F.when(F.col("value").isNull(), itself).otherwise(F.concat(*[around(s) for s in sizes]))).alias("w"))
    known = windows.select("passage").distinct()
    known = F.broadcast(known) if small else known.hint("merge")
    held = met.select("row", "key", "n_words", "w.*").join(known, F.col("found") == known["passage"], "left").where("start < 0 or passage is not null")
    span = F.when(F.col("start") >= 0, F.struct("start", "size"))
    return held.groupBy("row").agg(
        F.max("key").alias("key"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("passage").alias("passages")
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) and spans of every document."""
    found = common.materialise(hits(documents, benchmark, window, max_broadcast))
    found = found.withColumnRenamed("key", "doc_id")
    owners = item_windows(benchmark, window).where("item_id is not null").select("passage", F.col("item_id").cast("string").alias("item")).distinct()
    pairs = found.where(F.size("passages") > 0).select("row", F.explode("passages").alias("passage")).join(owners, "passage").select("row", "item").distinct()
    listed = pairs.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # words covered by the spans in order: what each adds beyond the end of those before
    covered = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (s, x) -> struct(s.n + greatest(0, x.start + x.size - greatest(s.upto, x.start)) as n, greatest(s.upto, x.start + x.size) as upto), s -> s.n)")
    return found.join(listed, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a hit go."""
    found = hits(docs, common.table(spark, sf_dir, "benchmark"), key=F.struct("doc_id", F.xxhash64("text").alias("tie")))
    gone, tie = common.unused("gone", docs.columns), common.unused("tie", docs.columns)
    hit = found.where(F.size("spans") > 0).select(F.col("key.doc_id").alias(gone), F.col("key.tie").alias(tie)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[gone]) & (F.xxhash64(docs["text"]) == hit[tie]), "left_anti").select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS p
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT m FROM bw
), one AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), ten AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM one
), dw AS (
  SELECT doc_id, i, m, array_to_string(l[1:m], ' ') AS p FROM ten, sizes WHERE len(l) >= m
), h AS (SELECT DISTINCT doc_id, i, m, p FROM dw WHERE p IN (SELECT p FROM bw)
), covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h JOIN bw USING (p, m)) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
