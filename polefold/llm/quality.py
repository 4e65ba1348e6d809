"""Operator 6, quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every word has a sparse ternary index vector (hash-seeded). The context vector of
a word is the sum, over all its occurrences in all documents, of the index vectors of the words
before and after it, turned by one place to either side, which tells order. ``contexts`` adds them up
for the whole corpus; words share ``ROWS`` rows by hash (the documented bound on the table, which is
aggregated in Spark, collected and broadcast: ROWS x DIM numbers, whatever the corpus). A word's
vector is its context vector and the index vectors of itself, of its shape and of its ending, the
last two for words that are too rare to have met many others.

A document's input is the mean and the standard deviation of its words' vectors over the whole
text, how well each word fits the context vector of the one before it (mean and deviation), how like
its index vector is to that of the one before it (mean), and its length on a log scale. A network with one hidden layer is fitted in numpy on at most ``SAMPLE``
labelled rows (the documented bound; the rows with the smallest hashes of their doc_id), and one
temperature is fitted on a fold that the weights have not seen.

Defined cases: null and empty texts have the zero input and a score as any other; rows without
a label, or with one other than 0 and 1, teach nothing; of repeated rows with one doc_id only the
text with the smallest digest teaches; a null doc_id counts as the empty string for the fold;
without a labelled row every score is 0.5, with one kind of label the network still gives a number
from 0 to 1; an empty table gives no rows; other columns are not read, except by the pipeline's
stage, which returns them whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lang_id import fold

DIM, PICKS, ROWS, HIDDEN, SAMPLE, FOLDS, ACCEPT = 32, 4, 1 << 14, 32, 20_000, 5, 0.3
OWN, SHAPE, ENDING = 0.5, 1.5, 0.7  # weights of the index vectors beside the context vector
INPUT = 2 * DIM + 4
FEW = 5  # occurrences at which a context vector counts half
_MEMO, _WORDS, _BLOCK, _SALTS = 200_000, 1 << 14, 256, 16
_LONG = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    """Character -> the sign that stands for it in a word's shape."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch
        return self[code]


_KINDS = _Kinds()


def shape(word: str) -> str:
    return _LONG.sub(r"\1", word.translate(_KINDS))


def seeds(keys: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def picks(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places [n, PICKS] of an index vector and their signs."""
    parts = (seed[:, None] >> (np.uint64(16) * np.arange(PICKS, dtype=np.uint64))) & np.uint64(0xFFFF)
    return ((parts >> np.uint64(1)) % np.uint64(DIM)).astype(np.int64), np.where(parts & np.uint64(1), 1, -1)


def index_vectors(seed: np.ndarray) -> np.ndarray:
    places, signs = picks(seed)
    out = np.zeros((len(seed), DIM), np.float32)
    for k in range(PICKS):
        out[np.arange(len(seed)), places[:, k]] += signs[:, k]
    return out


def row_of(seed: np.ndarray) -> np.ndarray:
    return (seed % np.uint64(ROWS)).astype(np.int64)


class _Words:
    """Numbers for words: a memo of bounded size, and places that each call uses anew beyond it."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}

    def number(self, words: list[str]) -> tuple[np.ndarray, list[str], int]:
        """A number for each word; the words without a row yet, whose numbers start at the third value."""
        known = self.place
        found = list(map(known.get, words))
        missing, at = [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                missing.append(at)
        except ValueError:  # no more
            pass
        if not missing:
            return np.array(found, np.int64), [], 0
        new = list(dict.fromkeys([words[i] for i in missing]))
        start = len(known) if len(known) + len(new) <= _MEMO else _MEMO
        fresh = dict(zip(new, range(start, start + len(new))))
        if start < _MEMO:
            known.update(fresh)
        for i in missing:
            found[i] = fresh[words[i]]
        return np.array(found, np.int64), new, start


class Run:
    """Words of some texts one after the other, about ``_WORDS`` of them.

    ``starts``: where each text's words begin; ``texts``: which text it is; ``seen``: words that an
    earlier run has counted and that are here only as the word before the next (zero or one a text).
    """

    def __init__(self) -> None:
        self.words: list[str] = []
        self.starts: list[int] = []
        self.texts: list[int] = []
        self.seen: list[int] = []

    def apart(self) -> np.ndarray:
        """Places whose next word belongs to another text."""
        return np.array(self.starts[1:], np.int64) - 1


def runs(texts: list[str]) -> Iterator[Run]:
    now = Run()
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(0, len(words), _WORDS):
            now.texts.append(i)
            now.starts.append(len(now.words))
            if at:
                now.seen.append(len(now.words))
            now.words += words[max(at - 1, 0) : at + _WORDS]
            if len(now.words) >= _WORDS:
                yield now
                now = Run()
    if now.words:
        yield now


def _fitted(table: np.ndarray, rows: int) -> np.ndarray:
    """``table`` with at least ``rows`` rows."""
    if rows <= len(table):
        return table
    return np.concatenate([table, np.zeros((max(rows - len(table), len(table) // 2), *table.shape[1:]), table.dtype)])


class ContextCounter:
    """Adds up what context vectors its texts give."""

    def __init__(self) -> None:
        self.words = _Words()
        self.seed = np.zeros(1024, np.uint64)
        self.sums = np.zeros((ROWS, DIM), np.int64)
        self.seen = np.zeros(ROWS, np.int64)

    def add(self, texts: list[str]) -> None:
        for run in runs(texts):
            at, new, start = self.words.number(run.words)
            self.seed = _fitted(self.seed, start + len(new))
            self.seed[start : start + len(new)] = seeds(new)
            seed = self.seed[at]
            rows, (places, signs) = row_of(seed), picks(seed)
            joined = np.ones(len(at), bool)
            joined[run.apart()] = joined[-1] = False
            first = np.flatnonzero(joined)
            flat, own, after = self.sums.reshape(-1), rows[first] * DIM, rows[first + 1] * DIM
            for k in range(PICKS):
                np.add.at(flat, after + (places[first, k] + 1) % DIM, signs[first, k])
                np.add.at(flat, own + (places[first + 1, k] - 1) % DIM, signs[first + 1, k])
            self.seen += np.bincount(np.delete(rows, run.seen), minlength=ROWS)


def _blocks(sums: np.ndarray, seen: np.ndarray, salt: int) -> pa.RecordBatch:
    press = zstandard.ZstdCompressor(level=1)
    used = [b for b in range(ROWS // _BLOCK) if seen[b * _BLOCK : (b + 1) * _BLOCK].any()]
    packed = [press.compress(np.concatenate([seen[b * _BLOCK : (b + 1) * _BLOCK, None], sums[b * _BLOCK : (b + 1) * _BLOCK]], axis=1).tobytes()) for b in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()), pa.array(packed, pa.binary())], ["block", "salt", "packed"])


_PARTIAL = "block int, salt int, packed binary"


def contexts(documents: DataFrame) -> np.ndarray:
    """Context vectors [ROWS, DIM] over all texts: mean over a row's occurrences, less the corpus's own mean, drawn to zero where few."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, first = ContextCounter(), None
        for batch in batches:
            raws = common.text_bytes(batch.column("raw"))
            counter.add([r.decode("utf-8", "replace") for r in raws])
            first = xxhash.xxh64_intdigest(raws[0]) % _SALTS if first is None and raws else first
        if first is not None:
            yield _blocks(counter.sums, counter.seen, first)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, total = None, np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([press.compress(total.tobytes())], pa.binary())], ["block", "salt", "packed"])

        for batch in batches:
            for block, salt, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, salt) != now:
                    if now:
                        yield made()
                    now, total = (block, salt), np.zeros(_BLOCK * (DIM + 1), np.int64)
                total = total + np.frombuffer(unpress.decompress(packed), np.int64)
        if now:
            yield made()

    found = common.map_batches(common.with_text_bytes(documents), count, _PARTIAL)
    for _ in range(2):  # salted first, so that no task adds up a block of all tasks
        found = common.map_batches(found.repartition("block", "salt").sortWithinPartitions("block", "salt"), add, _PARTIAL)
    table = np.zeros((ROWS // _BLOCK, _BLOCK, DIM + 1))
    for r in found.select("block", "packed").collect():  # at most ROWS / _BLOCK rows
        table[r["block"]] = np.frombuffer(zstandard.decompress(r["packed"]), np.int64).reshape(_BLOCK, DIM + 1)
    table = table.reshape(ROWS, DIM + 1)
    seen, sums = table[:, :1], table[:, 1:]
    mean = sums.sum(0) / max(seen.sum(), 1.0)
    return np.where(seen > 0, (sums - mean * seen) / (seen + FEW), 0.0).astype(np.float32)


class Embedder:
    """Documents' inputs, with a memo of word vectors of bounded size."""

    def __init__(self, context: np.ndarray) -> None:
        self.context = context
        self.words = _Words()
        self.vectors = np.zeros((1024, DIM), np.float32)
        self.index = np.zeros((1024, DIM), np.int8)
        self.row = np.zeros(1024, np.int64)
        self.places: dict[str, int] = {}  # shapes and endings, in `parts`
        self.parts = np.zeros((1024, DIM), np.float32)

    def _parts(self, keys: list[str], weight: float) -> np.ndarray:
        """Weighted index vectors of shapes or endings, kept in a memo that starts anew when it is full."""
        known = self.places
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            if len(known) + len(new) > _MEMO:
                known.clear()
                new = list(dict.fromkeys(keys))
            start = len(known)
            known.update(zip(new, range(start, start + len(new))))
            self.parts = _fitted(self.parts, start + len(new))
            self.parts[start : start + len(new)] = index_vectors(seeds(new)) * np.float32(weight)
        return self.parts[np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))]

    def _number(self, words: list[str]) -> np.ndarray:
        at, new, start = self.words.number(words)
        if new:
            end = start + len(new)
            self.vectors, self.index, self.row = (_fitted(t, end) for t in (self.vectors, self.index, self.row))
            seed = seeds(new)
            own = index_vectors(seed)
            self.row[start:end] = row_of(seed)
            self.index[start:end] = own
            made = self.context[self.row[start:end]] + OWN * own
            made += self._parts(["s" + shape(w) for w in new], SHAPE)
            made += self._parts(["e" + w[-3:] for w in new], ENDING)
            self.vectors[start:end] = made
        return at

    def embed(self, texts: list[str]) -> np.ndarray:
        """Inputs [texts, INPUT]."""
        total, square, fit, n = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM)), np.zeros((len(texts), 3)), np.zeros(len(texts))
        for run in runs(texts):
            at = self._number(run.words)
            found = self.vectors[at]
            found[run.seen] = 0
            before, after = self.index[at[:-1]], self.index[at[1:]].astype(np.float32)
            like = np.zeros((len(at), 3))
            like[:-1, 0] = np.einsum("ij,ij->i", self.context[self.row[at[:-1]]], np.roll(after, -1, axis=1))
            like[:-1, 2] = np.einsum("ij,ij->i", before, after) / PICKS
            like[run.apart()] = 0
            like[:, 1] = like[:, 0] ** 2
            total[run.texts] += np.add.reduceat(found, run.starts, axis=0)  # a text is in a run once
            square[run.texts] += np.add.reduceat(found * found, run.starts, axis=0)
            fit[run.texts] += np.add.reduceat(like, run.starts, axis=0)
            n[run.texts] += np.diff([*run.starts, len(at)])
            n[[run.texts[int(np.searchsorted(run.starts, p, "right")) - 1] for p in run.seen]] -= 1
        words = np.maximum(n, 1)[:, None]
        mean, fit = total / words, fit / np.maximum(n - 1, 1)[:, None]
        deviation = np.sqrt(np.maximum(square / words - mean**2, 0))
        return np.hstack([mean, deviation, fit[:, :1], np.sqrt(np.maximum(fit[:, 1:2] - fit[:, :1] ** 2, 0)), fit[:, 2:], np.log1p(n)[:, None] / 10]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Input -> tanh layer -> one logit, standardised inputs, tempered probabilities."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(INPUT), np.ones(INPUT)
        self.w = [rng.normal(0, INPUT**-0.5, (INPUT, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
        self.w[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) / self.scale @ self.w[0] + self.w[1])
        return hidden @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid(self.logits(x) / self.temperature), 9)  # the last bits depend on how rows are batched

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> None:
        rng = np.random.default_rng(11)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.shift) / self.scale
        first, second, turn = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                a, b = z[part], y[part]
                hidden = np.tanh(a @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3][0]) - b) / len(part)
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                grads = [a.T @ back + decay * self.w[0], back.sum(0), hidden.T @ error + decay * self.w[2], np.array([error.sum()])]
                turn += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)

    def temper(self, x: np.ndarray, y: np.ndarray) -> None:
        logits = self.logits(x)
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [float(np.mean(np.logaddexp(0, logits / t) - y * logits / t)) for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])


def _embedded(raws: list[bytes | None], embedder: Embedder) -> np.ndarray:
    return embedder.embed([(r or b"").decode("utf-8", "replace") for r in raws])


class Classifier:
    """A fitted network with the context vectors that it was fitted on; network None: nothing was learnt."""

    def __init__(self, context: np.ndarray, network: Network | None):
        self.context, self.network = context, network

    def scores(self, raws: list[bytes | None], embedder: Embedder) -> np.ndarray:
        if self.network is None or not raws:
            return np.full(len(raws), 0.5)
        return self.network.score(_embedded(raws, embedder).astype(np.float64))


def inputs(df: DataFrame, context: np.ndarray, *keep: str) -> DataFrame:
    """The columns ``keep`` (of simple types) and ``x``: the embedded text."""
    shared = df.sparkSession.sparkContext.broadcast(context)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = Embedder(shared.value)
        for batch in batches:
            made = _embedded(batch.column("raw").to_pylist(), embedder)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * INPUT), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "x"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return common.map_batches(common.with_text_bytes(df, *keep), work, ", ".join([*kinds, "x array<float>"]))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on labelled rows outside fold 0; fold 1 sets the temperature."""
    context = contexts(documents)
    part = fold(F.col("doc_id"), FOLDS)
    usable = labels.where(F.col("quality").isin(0, 1) & (part != 0)).select("doc_id", "quality").distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    met = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row for each doc_id and label, so that no more than `sample` rows reach the driver
    first = met.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    rows = first.withColumn("part", part.cast("int"))
    got = inputs(rows, context, "doc_id", "quality", "part").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    if not len(got):
        return Classifier(context, None)
    x, y, late = np.stack(got["x"].to_list()).astype(np.float64), got["quality"].to_numpy(float), got["part"].to_numpy() == 1
    if late.all() or not late.any():
        late = np.zeros(len(y), bool)
    network = Network()
    network.fit(x[~late], y[~late])
    if late.any():
        network.temper(x[late], y[late])
    return Classifier(context, network)


def score(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of all rows; sees doc_id only to return it."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = Embedder(shared.value.context)
        for batch in batches:
            found = shared.value.scores(batch.column("raw").to_pylist(), embedder)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return common.map_batches(common.with_text_bytes(documents, "doc_id"), work, "doc_id long, score double")


def score_column(spark: SparkSession, text: Column, classifier: Classifier) -> Column:
    """The score of a text as a column: only the text travels to Python, other columns stay where they are."""
    shared = spark.sparkContext.broadcast(classifier)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = Embedder(shared.value.context)
        try:
            for part in parts:
                cuts = [pa.array(shared.value.scores(cut.column(0).to_pylist(), embedder)) for cut in common.in_parts([pa.RecordBatch.from_arrays([part], ["raw"])])]
                yield pa.concat_arrays(cuts).cast(pa.float64())
        finally:
            common.trim()

    return scored(text.cast("binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    classifier = train(documents, common.table(spark, sf_dir, "labels"))
    held = fold(F.col("doc_id"), FOLDS) == 0
    return score(documents, classifier).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    classifier = train(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(score_column(spark, docs["text"], classifier) >= ACCEPT)
