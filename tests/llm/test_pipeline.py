"""The pipeline stage by stage against brute force."""

import re
import zlib

import numpy as np

import corpus_pipeline
from polefold.llm import common, packing, quality, simhash

from .test_text_operators import brute_contamination, brute_removed, brute_simhash


def brute_pieces(texts):
    from tokenizers import Tokenizer

    inner, out = Tokenizer.from_file(packing.vocabulary_path()), []
    for doc, text in texts.items():
        ids = [*inner.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            out.append((doc, at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in common.table(spark, data, "benchmark").collect()]
    now = docs
    before = {r.doc_id: r.text for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialise(stage(spark, now, data))
        assert now.columns == columns
        after = {r.doc_id: r.text for r in now.collect()}
        assert set(after) <= set(before)
        if name.startswith("quality"):
            network = quality.train(docs, common.table(spark, data, "labels"))
            want = {r.doc_id for r in quality.score(docs, network).collect() if r.score >= quality.ACCEPT}
            assert set(after) == want
        elif name.startswith("simhash"):
            prints = {i: brute_simhash(t) for i, t in before.items()}
            root = {i: i for i in prints}
            settled = False
            while not settled:
                settled = True
                for i, p in prints.items():
                    low = min(root[j] for j, q in prints.items() if bin(p ^ q).count("1") <= 3)
                    if low < root[i]:
                        root[i], settled = low, False
            assert set(after) == {i for i, r in root.items() if i == r}
        elif name.startswith("suffix"):
            ids = list(before)
            for i, (clean, _) in zip(ids, brute_removed([before[i] for i in ids], 200)):
                assert after[i] == clean.decode("utf-8", "ignore")
            assert all(r.n_chars == len(r.text) for r in now.collect())
        else:
            assert name.startswith("benchmark")
            hit = {r[0] for r in brute_contamination(before.items(), bench) if r[2]}
            assert set(after) == set(before) - hit
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, data).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute_pieces(before)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.CAPACITY
    assert len(places) <= 1.05 * sum(r.length for r in packed) / packing.CAPACITY + 1


def test_run_returns_pieces(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_null_and_empty_documents(spark, data, tmp_path):
    for name in ("benchmark", "labels"):
        common.table(spark, data, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a few words of text here", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    classifier = quality.train(spark.createDataFrame(rows, schema), common.table(spark, str(tmp_path), "labels"))
    empty, some = quality.Embedder(classifier.context), b"a few words of text here"
    good = {r: classifier.scores([r], empty)[0] >= quality.ACCEPT for r in (b"", some)}
    # null and empty texts are one component, of which the smallest number stays; the document without a number stays
    assert sorted((str(r.doc_id), r.piece, r.offset >= 0) for r in got) == sorted((i, 0, True) for i, r in (("1", b""), ("None", some)) if good[r])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_entry_module_guards_imports():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "polefold" / "llm").glob("*.py")]:
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", path.read_text())


def test_one_row_of_every_component_stays(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(3, same, 1), (3, same, 1), (2, same, 1), (2, same + " ", 1), (None, same, 1), (None, "alone without an id", 1), (None, "alone without an id", 1), (9, None, 1), (8, "", 1), (None, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(spark, docs, "").collect()), key=str)
    assert len(got) == 3
    assert {g[0] for g in got} == {2, 8, None} and (None, "alone without an id") in got
    assert simhash.keep_first(spark, docs, "").columns == docs.columns


def test_stages_pass_columns_whatever_their_names(spark, data):
    """Names that the stages use for themselves come through with their values."""
    names = ["key", "gone", "tie", "salt", "uid", "crc", "packed", "ranges", "words", "row", "value", "fp", "raw", "first", "score", "KEYS", "root", "clean", "removed"]
    texts = {1: "one two three four five six seven", 2: None, 3: "eight nine ten eleven twelve thirteen", 4: "one two three four five six seven"}
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
            assert r.text == texts[r.doc_id]
    assert {r.doc_id for r in simhash.keep_first(spark, docs, data).collect()} == {1, 2, 3}
