"""Corpus pipeline (part of subpackage llm): five stages over ``documents``.

Every stage works on all that the one before has kept and its result is written to Parquet in the
shared folder and read again. All but the last return the columns of ``documents``; the last
returns the packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Null or empty texts, repeated rows and empty tables are treated as each operator's docstring
says; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polefold.llm import common, decontaminate, packing, quality, simhash, suffix_dedup

STAGES = [
    ("quality classifier", quality.keep_accepted),
    ("simhash near-dedup", simhash.keep_first),
    ("suffix-array dedup", suffix_dedup.strip_repeats),
    ("benchmark decontamination", decontaminate.keep_clean),
    ("best-fit packing", packing.stage),
]

#: A trained classifier is among the stages, which SQL cannot express; tests hold run() against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs
