"""Operator 1, substring dedup: line hashing with the earliest occurrence kept.

A text is cut into units: lines, and within a line sentences (after ``.``, ``!`` or ``?`` with a blank
behind it), so that a passage is found wherever lines are broken around it. A unit is normalised
(A-Z lower-cased, runs of ASCII white space to one blank, trimmed) and digested to 128 bits. Over
all documents the occurrence with the smallest (doc_id, digest of the text, unit number) of a digest
stays, every other one goes, with the separator behind it; offsets are those of the whole text.

``min_words`` is the least number of words that a unit must have to be compared at all (one more
than its blanks, and each Han or kana character adds one). The query sets it to ``MIN_WORDS``: in
running text shorter sentences recur by chance in documents that share nothing else, and taking
them out would spoil clean documents. With 1, all units but empty ones are compared.

``dedup_passages`` is another rule, for passages that no whole unit lies in. Of every ``width`` words in a row
(A-Z lower-cased, cut at ASCII white space, across lines and sentences) the stretch of (width + 1) // 2 words with
the smallest hash, the leftmost of equal ones, is a mark: equal passages of ``width`` words have an equal mark,
wherever they stand. Marks that a document with a smaller (doc_id, digest of the text) has too go, with the white
space behind them. So of a passage of ``width`` words or more that an earlier document has, all goes but width // 2
words at either end at most (and single words between marks where ``width`` is even), and no word goes outside a
stretch of (width + 1) // 2 words that an earlier document has. What repeats within one document alone stays.
No query uses this rule: ``op1_line_dedup`` and its SQL are units.

Defined cases: null text is empty (one empty unit, nothing removed); a null doc_id ranks first;
rows equal in doc_id and text keep the same units; an empty table gives no rows; other columns pass
through both whatever their names (``clean_text``, ``n_units`` or ``n_words``, and ``removed`` are replaced).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

MIN_WORDS = 12
_ENDS = re.compile(r"([.!?]) ")
_WORD = re.compile(r"[^\t\n\x0B\f\r ]+")
_AT_ONCE = 1 << 16
ADDED = "clean_text string, n_units int, removed array<struct<unit:int,start:int,length:int>>"
ADDED_WORDS = "clean_text string, n_words int, removed array<struct<word:int,words:int,start:int,length:int>>"


def _normal(unit: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(F.octet_length(unit) == F.length(unit), F.lower(unit)).otherwise(F.translate(unit, upper, lower))
    # single blanks, which are most, are left alone
    return F.trim(F.regexp_replace(lowered, r"[\t\x0B\f\r][ \t\x0B\f\r]*| [ \t\x0B\f\r]+", " "))


def _n_words(unit: Column) -> Column:
    """Words of a normalised unit that is not empty."""
    blanks = F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit("")))
    signs = F.length(unit) - F.length(F.regexp_replace(unit, r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]", ""))
    return blanks + 1 + F.when(F.octet_length(unit) == F.length(unit), 0).otherwise(signs)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_units(documents: DataFrame, min_words: int = 1) -> DataFrame:
    """Units to remove: uid (doc_id), whole (digest of the text), unit (number from 0)."""
    cut = F.coalesce("text", F.lit(""))
    for end in ".!?":  # a blank behind a sentence becomes a line end: all offsets stay
        cut = F.replace(cut, F.lit(f"{end} "), F.lit(f"{end}\n"))

    def digest(unit: Column) -> Column:
        once = F.transform(F.array(_normal(unit)), lambda u: F.when((F.length(u) > 0) & (_n_words(u) >= min_words), F.unhex(F.md5(u))))[0]
        return F.when(F.length(unit) >= max(1, min_words - 1), once)  # a unit has at most one word more than characters

    # digests are taken before the units become rows, where no filter can have them computed again
    units = documents.select(F.col("doc_id").alias("uid"), _digest(F.col("text")).alias("whole"), F.transform(F.split(cut, "\n", -1), digest).alias("digests"))
    units = units.select("uid", "whole", F.posexplode_outer("digests").alias("unit", "digest")).where("digest is not null")
    return _later(common.materialise(units), "uid", "whole", "unit").select("uid", "whole", "unit")


def _later(rows: DataFrame, *place: str) -> DataFrame:
    """Rows whose digest also stands at a smaller place."""
    first = rows.groupBy("digest").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1")
    # another form of the key: the join then deals both sides itself and can split a hot digest
    keyed = first.select(F.hex("digest").alias("key"), "first")
    return rows.withColumn("key", F.hex("digest")).join(keyed.hint("merge"), "key").where(~F.struct(*place).eqNullSafe(F.col("first")))


def cut_units(text: str) -> list[tuple[int, int, str]]:
    """(start, length, separator behind it) of every unit."""
    out, start = [], 0
    for unit in _ENDS.sub(r"\1\n", text).split("\n"):
        out.append((start, len(unit), text[start + len(unit) : start + len(unit) + 1]))
        start += len(unit) + 1
    return out


def dedup_lines(documents: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents with ``clean_text``, ``n_units`` and ``removed``: array of (unit, start, length).

    Starts and lengths are code points of the original text, the separator not included.
    """
    gone = repeated_units(documents, min_words).groupBy("uid", "whole").agg(F.collect_set("unit").alias("found"))

    def cut(text: str, numbers: list[int]) -> tuple[str, int, list[dict[str, int]]]:
        out, cuts = set(numbers), cut_units(text)
        kept = [c for i, c in enumerate(cuts) if i not in out]
        parts = [text[start : start + length] + behind for start, length, behind in kept[:-1]]
        clean = "".join([*parts, *[text[start : start + length] for start, length, _ in kept[-1:]]])
        return clean, len(cuts), [{"unit": i, "start": cuts[i][0], "length": cuts[i][1]} for i in sorted(out)]

    return _without(documents, gone, cut, ADDED)


def _without(documents: DataFrame, gone: DataFrame, cut: Callable, added: str) -> DataFrame:
    """The documents with the columns ``added``, which ``cut`` gives for a text and what ``gone`` (uid, whole, found) names in it."""
    names = [f.name for f in T._parse_datatype_string(added).fields]
    columns = [c for c in documents.columns if c.lower() not in names]
    uid, whole, digest, found = (common.unused(n, columns) for n in ("uid", "whole", "digest", "found"))
    gone = gone.select(F.col("uid").alias(uid), F.col("whole").alias(whole), F.col("found").alias(found))
    texts = documents.select(*columns, _digest(F.col("text")).alias(digest))
    joined = texts.join(gone, F.col("doc_id").eqNullSafe(F.col(uid)) & (F.col(digest) == F.col(whole)), "left").select(*columns, found)
    schema = T.StructType([*documents.select(*columns).schema.fields, *T._parse_datatype_string(added).fields])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(text or "", things or []) for text, things in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist())]
            kept = [batch.column(c).cast(target.field(c).type) for c in columns]
            made = [pa.array([r[i] for r in rows], target.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=target)

    return common.map_batches(joined, work, schema)


def marks(words: list[bytes], width: int) -> list[int]:
    """Where the marks of a text begin, ascending; none if it has fewer than ``width`` words."""
    size = (width + 1) // 2
    if len(words) < width:
        return []
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    hashes = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + codes[i : i + len(hashes)]
    hashes ^= hashes >> np.uint64(32)
    choices, n = width - size + 1, len(words) - width + 1
    found = []
    for start in range(0, n, _AT_ONCE):
        part = np.lib.stride_tricks.sliding_window_view(hashes[start : min(n, start + _AT_ONCE) + choices - 1], choices)
        found.append(np.unique(part.argmin(axis=1) + np.arange(start, start + len(part))))
    return np.unique(np.concatenate(found)).tolist()


def repeated_marks(documents: DataFrame, width: int) -> DataFrame:
    """Marks that an earlier document has too: uid (doc_id), whole (digest of the text), digest (of the mark's words)."""
    size = (width + 1) // 2
    docs = documents.select(F.col("doc_id").alias("uid"), _digest(F.col("text")).alias("whole"), F.col("text").cast("binary").alias("raw"))
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("digests", T.ArrayType(T.BinaryType()))])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for raw in common.text_bytes(batch.column("raw")):
                words = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
                digests.append(list({_mark_digest(words, at, size) for at in marks(words, width)}))
            uids = batch.column("uid").cast(target.field("uid").type)
            yield pa.RecordBatch.from_arrays([uids, batch.column("whole"), pa.array(digests, target.field("digests").type)], schema=target)

    rows = common.map_batches(docs, work, schema).select("uid", "whole", F.explode("digests").alias("digest"))
    return _later(common.materialise(rows), "uid", "whole").select("uid", "whole", "digest")


def _mark_digest(words: list[bytes], at: int, size: int) -> bytes:
    return hashlib.md5(b" ".join(words[at : at + size])).digest()


def dedup_passages(documents: DataFrame, width: int = 51) -> DataFrame:
    """The documents with ``clean_text``, ``n_words`` and ``removed``: array of (word, words, start, length).

    ``word`` is the number (from 0) of the first word of a run that goes, ``words`` how many it has; start and length
    are code points of the original text, the white space behind the run included.
    """
    if width < 1:
        raise ValueError("width must be 1 at least")
    size = (width + 1) // 2
    gone = repeated_marks(documents, width).groupBy("uid", "whole").agg(F.collect_set("digest").alias("found"))

    def cut(text: str, digests: list[bytes]) -> tuple[str, int, list[dict[str, int]]]:
        words, known = text.encode().lower().split(), set(digests)
        if not known:
            return text, len(words), []
        runs: list[list[int]] = []  # (first word, word behind the last)
        for at in marks(words, width):
            if _mark_digest(words, at, size) in known:
                if runs and at <= runs[-1][1]:
                    runs[-1][1] = at + size
                else:
                    runs.append([at, at + size])
        starts = [*(m.start() for m in _WORD.finditer(text)), len(text)]
        out, clean, behind = [], [], 0
        for first, last in runs:
            clean.append(text[behind : starts[first]])
            behind = starts[last]
            out.append({"word": first, "words": last - first, "start": starts[first], "length": behind - starts[first]})
        return "".join([*clean, text[behind:]]), len(words), out

    return _without(documents, gone, cut, ADDED_WORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)
    return out.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.size("removed").cast("long").alias("n_removed"),
        F.coalesce(F.expr("aggregate(removed, 0L, (s, r) -> s + r.length)"), F.lit(0)).cast("long").alias("chars_removed"),
        F.array_join(F.expr("transform(removed, r -> concat(r.start, '+', r.length))"), ",").alias("spans"),
        F.sha2("clean_text", 256).alias("kept_sha256"),
    )


SQL = f"""
WITH p AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
), e AS (
  SELECT doc_id, text, unnest(range(len(parts))) AS unit_no, unnest(parts) AS unit, len(parts) AS n_units FROM p
), u AS (
  SELECT *, sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY unit_no) - length(unit) - 1 AS start FROM e
), n AS (
  SELECT *, substr(text, (start + length(unit) + 1)::BIGINT, 1) AS behind,
         regexp_replace(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM u
), w AS (
  SELECT *, length(norm) > 0 AND length(norm) - length(replace(norm, ' ', '')) + 1
         + length(norm) - length(regexp_replace(norm, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]', '', 'g')) >= {MIN_WORDS} AS long_enough FROM n
), k AS (
  SELECT *, long_enough AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, md5(text), unit_no) > 1 AS gone FROM w
), g AS (
  SELECT doc_id, max(n_units)::BIGINT AS n_units, count(*) FILTER (gone)::BIGINT AS n_removed,
         coalesce(sum(length(unit)) FILTER (gone), 0)::BIGINT AS chars_removed,
         coalesce(string_agg(start::BIGINT || '+' || length(unit), ',' ORDER BY unit_no) FILTER (gone), '') AS spans,
         coalesce(string_agg(unit || behind, '' ORDER BY unit_no) FILTER (NOT gone), '') AS kept,
         coalesce(length(max_by(behind, unit_no) FILTER (NOT gone)), 0) AS cut
  FROM k GROUP BY doc_id
)
SELECT doc_id, n_units, n_removed, chars_removed, spans, sha256(left(kept, (length(kept) - cut)::BIGINT)) AS kept_sha256 FROM g
"""
