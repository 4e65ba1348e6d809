"""Operator 8, language identification by rank-order n-gram profiles.

A text is lower-cased; runs of other characters than letters become one gap, with gaps at both
ends. Its n-grams of 1 to 3 characters are ranked by count (then by code points). A language's
profile is the ranking of the n-grams of all its training texts, added up over the whole table.
A text gets the language with the smallest out-of-place distance: for each of its ranked n-grams
the difference of ranks, or the profile's length where the profile lacks it.

Defined cases: null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing can be learned; rows without a language teach nothing; ties go to the first language by
name; a null doc_id counts as the empty string for the fold; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PROFILE, FOLDS, HELD = 400, 3, 1
GAP = 1  # not a letter, and not 0: codes of n-grams of different lengths stay apart
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> np.ndarray:
    """Codes of the n-grams, 21 bits a character, sorted; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, GAP).astype(np.uint64)
    ends = np.full(1, GAP, np.uint64)
    codes = np.concatenate([ends, codes, ends])
    codes = codes[(codes != GAP) | np.concatenate([[True], codes[:-1] != GAP])]
    if len(codes) < 2:
        return np.zeros(0, np.uint64)
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = two[:-1] << np.uint64(21) | codes[2:]
    return np.sort(np.concatenate([codes[codes != GAP], two, three]))


def _counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    ordered = _grams(text)
    if not len(ordered):
        return ordered
    grams, counts = _counted(ordered)
    if len(grams) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:size]


def fold(key: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def learn(training: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows (text, lang): n-gram codes by rank. ``size`` rows a language reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}
        chars: dict[str, int] = {}

        def add(lang: str) -> None:
            # a line end is a gap, as the ends of a text are
            grams, counts = _counted(_grams("\n".join(waiting.pop(lang)))) if waiting.get(lang) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            chars[lang] = 0
            if lang in kept:
                grams, counts = np.concatenate([kept[lang][0], grams]), np.concatenate([kept[lang][1], counts])
                order = np.argsort(grams, kind="stable")
                grams, counts = grams[order], counts[order]
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
                grams, counts = grams[first], np.add.reduceat(counts, first) if len(first) else counts
            kept[lang] = (grams, counts)

        def made(lang: str) -> pa.RecordBatch:
            grams, counts = kept.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist()):
                waiting.setdefault(lang, []).append((raw or b"").decode("utf-8", "replace"))
                chars[lang] = chars.get(lang, 0) + len(raw or b"")
                if chars[lang] >= _CHUNK:
                    add(lang)
                    if len(kept[lang][0]) > 2_000_000:
                        yield made(lang)
        for lang in list(waiting):
            add(lang)
        for lang in list(kept):
            yield made(lang)

    counted = common.map_batches(common.with_text_bytes(training, "lang"), count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(profiles[lang], np.int64).view(np.uint64))
            self.ranks[at, i] = np.arange(len(at))

    def predict(self, text: str) -> tuple[str, float]:
        grams = ranked(text, self.size)
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == grams)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None])).mean(0) / self.size
        best = int(apart.argmin())
        return self.langs[best], float(np.clip(1 - apart[best], 0, 1))


def predict(documents: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for all rows; sees doc_id only to return it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, size)
        for batch in batches:
            found = [judge.predict((r or b"").decode("utf-8", "replace")) for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.map_batches(common.with_text_bytes(documents, "doc_id"), work, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), FOLDS) == HELD
    profiles = learn(documents.where(~held & F.col("lang").isNotNull()))
    return predict(documents, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
