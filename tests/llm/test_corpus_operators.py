"""Operators 11 to 13 against brute force, on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from polefold.llm import clusters, common, divergence, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, RAW string, tie int, part int, block int, n int"


def documents(n=120, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeXYZé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "a"]), 1, "x", "y", 1, 1, 1, 1) for i in range(n)]
    rows += [rows[3]] * 3
    rows += [(None, None, "fr", "only", None, None, None, None, None, None, None), (9, "", "fr", "other", 0, "", "", 0, 0, 0, 0)]
    rows += [(10, "in one only 12 - 日本 日本", "it", "a", 1, "", "", 0, 0, 0, 0), (None, "word " * 3000 + "<|endoftext|> it's 3,5\n\n  x", "en", "s1", 1, "", "", 0, 0, 0, 0)]
    return rows


def brute_divergences(rows, least, top):
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    seen, count, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in docs:
        found = Counter(words(text))
        groups[lang].add(source)
        seen[lang].update(found.keys())
        count[lang, source].update(found)
        total[lang].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(count[lang, s]) for s in sources}
        q = share(total[lang])
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)}
    return out


@pytest.mark.parametrize(("block", "tile", "top"), [(2048, 256, 200), (7, 2, 5)])
def test_divergences(spark, block, tile, top):
    rows = documents()
    found = divergence.divergences(spark.createDataFrame(rows, DOCS).repartition(4), top=top, block=block, tile=tile)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergences(rows, 3, top)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([0, 5, 9_300_000_000, 3 * 10**12]), np.array([10**13, 7, 9_300_000_001, 4 * 10**12 + 3])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]


def test_pair_sums_in_steps():
    rng = np.random.default_rng(0)
    p, q = rng.integers(1, 10**9, (3, 50)), rng.integers(1, 10**9, (4, 50))
    brute = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y)) for y in q] for x in p]
    assert divergence.pair_sums(p, q, cells=36).tolist() == divergence.pair_sums(p, q).tolist() == brute


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary_path())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(4)
    signs = [*"ab1 !\n\t' s’—é\xa0١ñ_\x1c\x85日本。́\x00\U0001f600﻿ß²　​", "<|endoftext|>", "'s", "'ll", " '", "  ", "'S"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["x " * 200_000 + "’" + "\n \n" * 90_000, "a" * 3000, "", "\x00\x00 \x00 Ā"]
    own = token_files.ByteTokenizer(token_files.vocabulary_path())
    wanted = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.ids([t.encode() for t in texts]) == wanted
    assert own.ids([t.encode() for t in texts]) == wanted  # from the memo


def test_ids_of_every_letter_and_sign(tokenizer):
    texts = ["".join(f" {c}a1{c}'{c}{c} " for c in map(chr, range(at, at + 16)) if not 0xD800 <= ord(c) < 0xE000) for at in range(0, 0x3000, 16)]
    own = token_files.ByteTokenizer(token_files.vocabulary_path())
    assert own.ids([t.encode() for t in texts]) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_blocks_round_trip(share):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50_257, (9, token_files.BLOCK)).astype(np.uint32)
    values[0], values[1], values[2, 5] = 7, np.arange(token_files.BLOCK), 2**32 - 1
    values[3] = rng.integers(0, 2**32, token_files.BLOCK)
    values[4] = 0
    values[4, 1000] = 2**32 - 1
    payload, least, width, count, size = token_files.pack(values, share)
    starts = np.cumsum(size) - size
    assert len(payload) == size.sum() and (token_files.unpack(payload, starts, least, width, count) == values).all()
    if share == 0.9:
        assert width[0] == width[4] == 0 and count[4] == 1 and width[1] == 10 and count[1] == 0
        assert (count <= 0.1 * token_files.BLOCK).all()
    if share == 1.0:
        assert not count.any()


@pytest.mark.parametrize("file_ids", [1 << 25, 500])
def test_token_files(spark, tokenizer, tmp_path, file_ids):
    rows = documents()
    folder = f"file://{tmp_path}/ids"
    files = token_files.write(spark.createDataFrame(rows, DOCS).repartition(5), folder, file_ids=file_ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_files.read(spark, folder).collect()]
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((r[0], len(x), crc(x)) for r, x in zip(rows, ids))
    got.sort(key=lambda x: x[1])
    assert [x[0] for x in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [x[1] for x in got] == np.cumsum([0, *(x[2] for x in got)])[:-1].tolist()
    assert (len(files) > 3) == (file_ids == 500)
    told = json.loads((tmp_path / "ids" / "files.json").read_text())["files"]
    assert told == files and sum(f["ids"] for f in files) == sum(map(len, ids)) and all((tmp_path / "ids" / f["file"]).stat().st_size == f["bytes"] for f in files)
    reader = token_files.Reader(folder, files[0]["file"])
    every = np.concatenate([reader.document(i) for i in range(len(reader.ends))])
    for lo, hi in ((0, 1), (1020, 1030), (5, 5), (0, len(every)), (len(every) - 1, len(every))):
        assert (reader.ids(lo, hi) == every[lo:hi]).all()
    assert [crc(reader.document(i)) for i in range(len(reader.ends))] == [d[3] for d in reader.documents()]


def test_token_files_of_nothing(spark, tmp_path):
    assert token_files.write(spark.createDataFrame([], DOCS), f"{tmp_path}/none") == []
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_files_of_tasks_that_failed_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write(spark.createDataFrame(documents(20), DOCS), folder)
    (tmp_path / "ids" / "part-000000-0000-99999.pfor").write_bytes(b"half")
    assert token_files.read(spark, folder).count() == len(documents(20))


VECTORS = "vec_id long, embedding array<float>, owner int, Distance long, label int"


def vectors(n, dimensions, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (5, dimensions))
    return [(i, (middle[rng.integers(5)] + rng.normal(0, 0.3, dimensions)).astype(np.float32).tolist(), 1, 1, 0) for i in range(n)]


def brute_clusters(rows, k, rounds, dimensions, scale):
    from fractions import Fraction
    from math import floor

    kept = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept]
    middle = [v for _, v in sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        owned = defaultdict(list)
        for _, v in kept:
            owned[near(v)[1]].append(v)
        middle = [[sum(x) // len(owned[j]) for x in zip(*owned[j])] if j in owned else c for j, c in enumerate(middle)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), middle


@pytest.mark.parametrize("case", ["plain", "odd", "large", "huge", "few"])
def test_clusters(spark, case):
    rows = vectors(150, 6, spread={"large": 3e5, "huge": 1.0}.get(case, 1.0))
    k, rounds = 7, 4
    if case == "odd":
        rows += [rows[0]] * 4 + [(None, rows[1][1], None, None, None), (1, None, 1, 1, 1), (2, [1.0] * 5, 1, 1, 1), (3, [1.0] * 5 + [None], 1, 1, 1), (4, [float("nan")] * 6, 1, 1, 1), (5, [float("inf")] * 6, 1, 1, 1), (6, [], 1, 1, 1), (7, rows[3][1], 1, 1, 1)]
    if case == "huge":
        rows += [(1000 + i, [float(np.float32(x)) for x in ((-1) ** i * 3e38, 0.0, 1e30, 1.0, 2.0, i)], 1, 1, 1) for i in range(12)]
    if case == "few":
        rows = rows[:3]
    found, middle = clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), clusters=k, rounds=rounds, dimensions=6)
    wanted, centroids = brute_clusters(rows, k, rounds, 6, 64)
    assert middle == centroids
    most = (1 << 63) - 1
    assert sorted(((r["vec_id"], r["owner"], r["distance"]) for r in found.collect()), key=str) == [(i, c, min(d, most)) for i, c, d in wanted]


def test_only_changed_centroids_are_compared(spark, monkeypatch):
    """With nothing changed, no vector is compared with anything and stored distances stand."""
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0, 5, 0)], "vec_id long, embedding array<double>, owner int, distance long, before int")
    kept = clusters.assign(rows, [[0, 0], [64, 128]], [], 64).first()
    assert (kept["owner"], kept["distance"]) == (0, 5)
    against_one = clusters.assign(rows, [[0, 0], [64, 128]], [1], 64).first()
    assert (against_one["owner"], against_one["distance"], against_one["before"]) == (1, 0, 0)


def test_clusters_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None, 0, 0, 0)], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = clusters.query(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_queries_read_whole_tables(spark, data):
    assert token_files.query(spark, data).count() == common.table(spark, data, "documents").count()
    assert clusters.query(spark, data).count() == clusters.usable(common.table(spark, data, "embeddings")).count()
