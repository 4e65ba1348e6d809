"""Operator 9, best-fit packing with two-for-one exchanges (best-two-fit).

A document's ids are those of the tokenizer and one end id; only documents longer than a
sequence are cut, into full pieces and a rest. A sequence is filled greedily with the longest
piece that still fits; then its smallest piece is replaced by two unpacked ones whose sum fits
the gap so gained more tightly, if there are such. Pieces of one length are alike, so the plan
is made from the number of pieces of each length (at most ``capacity`` counts, whatever the
corpus), one pattern with its multiplicity at a time. Every piece then finds its place from its
rank among those of its length; ranks are dealt out over salted parts of a length, so a length
that a third of all pieces have is split. Texts are never shuffled.

Defined cases: null text is empty and gives one piece holding the end id alone; repeated rows
are pieces of their own; an empty table gives no rows; null doc_id is kept; other columns are
not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID, SALTS = 4096, 1, 256
VOCABULARY = "word_bpe_49k.json"
_MEMO, _PART, _TOGETHER = 250_000, 1 << 18, 1 << 19
_BREAK = re.compile(r"[ \t\n\r\x0b\x0c]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _split_pattern(path: str) -> str:
    """The pattern by which the tokenizer's file cuts normalised text into pieces."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        raise ValueError("a tokenizer that does not cut by one pattern and map bytes")
    return steps[0]["pattern"]["Regex"]


def _byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary; a blank stays, it parts pieces."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 32}


class WordTokenizer:
    """Ids of whole texts, by looking up the pieces that the tokenizer cuts them into.

    The tokenizer finds its added tokens (``<|endoftext|>`` and the like) first, normalises what is
    between them, cuts it by one pattern and encodes the pieces one by one, so a text's ids are
    those of its pieces in order. Each character is tried once: where this class and the tokenizer
    would treat it otherwise (their tables are of other Unicode versions), texts that hold it go
    through the tokenizer itself. Pieces are kept in a memo of bounded size; new ones are encoded
    many at a time, told apart by the ids that end a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        # pieces are normalised and cut here, so the model alone is left to run
        self.model = Tokenizer(self.inner.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        added = self.inner.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in added.values()):
            raise ValueError("an added token that is not matched as it stands")
        self.marks = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        longest = sorted(self.marks, key=len, reverse=True)
        self.at_marks = re.compile("(" + ("|".join(map(re.escape, longest)) or "(?!)") + ")")
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        pattern = _split_pattern(path)
        # the same classes as the built-in engine, which is faster, names them; characters that it sees otherwise are found out
        plain = pattern.replace(r"[\p{L}]+", r"[^\W\d_]+").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+")
        self.cut = (re if r"\p" not in plain else regex).compile(plain).findall
        self.cut_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.A).findall
        self.known: dict[str, bytes] = {}
        self.agreed: set[str] = set()
        self.other: set[str] = set()
        self.plain_ascii = all(self._agrees(chr(c), self.cut_ascii, ()) for c in range(128))

    def _agrees(self, char: str, cut: Callable[[str], list[str]], marked: tuple[str, ...] = ("e{}\u0301\u0323",)) -> bool:
        """The tokenizer normalises and cuts around the character as this class does."""
        if unicodedata.category(char) == "Cn":  # unknown here, so its place among other marks is too
            return False
        for form in ("a{}b", "1{}1", "!{}!", "{0}{0}", "'{}S", *marked):
            text = form.format(char)
            normal = self.inner.normalizer.normalize_str(text)
            theirs = [normal[a:b] for _, (a, b) in self.inner.pre_tokenizer.pre_tokenize_str(normal)]
            if theirs != cut(self._normal(text)):
                return False
        return True

    @staticmethod
    def _normal(text: str) -> str:
        # one character at a time, a sigma has no final form
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _encode(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        out: dict[str, bytes] = {}
        plain = [p for p in new if p.isascii()]  # most letters of these stand for themselves
        others = [p for p in new if not p.isascii()]
        groups = [part[i : i + 256] for part in (plain, others) for i in range(0, len(part), 256)]
        mapped = []
        for group in groups:
            text = " ".join(group)
            mapped.append(text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.letters))
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        for group, found in zip(groups, encode(mapped, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group):
                raw, cuts = ids.tobytes(), [0, *(4 * last).tolist()]
                out.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                out.update((piece, self._whole(piece)) for piece in group)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut_part(self, text: str) -> list[str] | bytes:
        """Pieces of a text without added tokens, or its ids where only the tokenizer itself will do."""
        if text.isascii() and self.plain_ascii:
            return self.cut_ascii(text.lower())
        chars = set(text)
        for char in chars - self.agreed - self.other:
            (self.agreed if self._agrees(char, self.cut) else self.other).add(char)
        if not self.other.isdisjoint(chars):
            return self._whole(text)
        return self.cut(self._normal(text))

    def _parts(self, raw: bytes) -> Iterator[list[str] | bytes]:
        """A text in parts that end at white space; added tokens as their ids."""
        text = raw.decode("utf-8", "replace")
        marked = any(mark in text for mark in self.marks)
        for i, piece in enumerate(self.at_marks.split(text) if marked else [text]):
            if i % 2:
                yield self.marks[piece]
                continue
            at = 0
            while at < len(piece):
                end = len(piece)
                if end - at > _PART and (stop := _BREAK.search(piece, at + _PART)):
                    end = stop.end()
                yield self._cut_part(piece[at:end])
                at = end

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        missing, at = [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                missing.append(at)
        except ValueError:  # no more
            pass
        if missing:
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            fresh = self._encode(new)
            room = _MEMO - len(self.known)
            self.known.update(fresh if len(fresh) <= room else dict(list(fresh.items())[: max(room, 0)]))
            for i in missing:
                found[i] = fresh[pieces[i]]
        return found

    def ids(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of UTF-8 texts; new pieces of all of them are encoded at once."""
        pieces: list[str] = []
        texts: list[list[bytes | slice]] = []
        for raw in raws:
            texts.append(own := [])
            for part in self._parts(raw):
                if isinstance(part, bytes):
                    own.append(part)
                else:
                    own.append(slice(len(pieces), len(pieces) + len(part)))
                    pieces += part
        found = self._look_up(pieces)
        return [b"".join([x if isinstance(x, bytes) else b"".join(found[x]) for x in own]) for own in texts]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            doc_ids, raws = batch.column("doc_id").to_pylist(), common.text_bytes(batch.column("raw"))
            for lo, hi in common.slices(raws, _TOGETHER):
                for doc_id, found in zip(doc_ids[lo:hi], tokenizer.ids(raws[lo:hi])):
                    ids = found + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_batches(common.with_text_bytes(documents, "doc_id"), work, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence) with how many sequences have them."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(left)
    patterns: list[tuple[list[int], int]] = []

    def drop(length: int) -> None:
        del lengths[bisect_right(lengths, length) - 1]

    while lengths:
        used: dict[int, int] = {}
        chosen: list[int] = []
        room = capacity
        at = len(lengths) - 1
        while at >= 0 and room:
            at = min(at, bisect_right(lengths, room) - 1)
            if at < 0:
                break
            length = lengths[at]
            times = min(left[length], room // length)
            chosen += [length] * times
            used[length] = times
            room -= times * length
            at -= 1
        if room and len(chosen) > 1:
            smallest = chosen[-1]
            gap = room + smallest
            best, pair = smallest, None
            # two unpacked pieces that fill the gap better than the smallest piece does
            lo, hi = 0, bisect_right(lengths, gap) - 1
            free = lambda x: left[x] - used.get(x, 0)
            while lo <= hi:
                a, b = lengths[lo], lengths[hi]
                if a + b > gap or not free(b) or (lo == hi and free(a) < 2):
                    hi -= 1
                    continue
                if free(a) and a + b > best:
                    best, pair = a + b, (b, a)
                    if best == gap:
                        break
                lo += 1
            if pair:
                chosen[-1:] = pair
                used[smallest] -= 1
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        used = {k: v for k, v in used.items() if v}
        times = min(left[k] // v for k, v in used.items())
        patterns.append((chosen, times))
        for k, v in used.items():
            left[k] -= v * times
            if not left[k]:
                drop(k)
    return patterns


def _runs(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in order of rank: first rank, first sequence, offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = given.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            given[length] = rank + times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``found`` (with long ``length``) and sequence_id, offset.

    Rows are written once with a salt of their own, so that rows alike in all columns are dealt out as
    well; at most capacity x salts counts reach the driver, whatever the corpus.
    """
    spark = found.sparkSession
    columns = [c for c in found.columns if c not in ("sequence_id", "offset")]
    salt = common.unused("salt", columns)
    salted = common.materialise(found.select(*columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias(salt)))
    sizes = salted.groupBy("length", F.col(salt).alias("salt")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((capacity + 1, salts), np.int64)
    counts[sizes["length"].to_numpy(np.int64), sizes["salt"].to_numpy(np.int64)] = sizes["n"]
    total = counts.sum(1)
    first = spark.sparkContext.broadcast(counts.cumsum(1) - counts)
    runs = spark.sparkContext.broadcast(_runs(plan({k: int(n) for k, n in enumerate(total) if n}, capacity)))
    dealt = salted.repartition(F.col("length"), F.col(salt)).sortWithinPartitions("length", salt, *columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = (-1, -1), 0  # the group that the batch before ended in, and its rows so far
        for batch in batches:
            lengths, own = batch.column("length").to_numpy(), batch.column(salt).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            cuts = np.flatnonzero((lengths[1:] != lengths[:-1]) | (own[1:] != own[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]) if len(lengths) else ():
                group = int(lengths[lo]), int(own[lo])
                seen = seen if group == last else 0
                last = group
                rank = int(first.value[group]) + seen + np.arange(hi - lo)
                starts, sequences, offsets = runs.value[group[0]]
                at = np.searchsorted(starts, rank, "right") - 1
                sequence[lo:hi], offset[lo:hi] = sequences[at] + rank - starts[at], offsets[at]
                seen += hi - lo
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*columns).schema.fields)
    return common.map_batches(dealt, work, f"{kinds}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(documents, path or vocabulary_path(), capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every piece of every document that is left, with its place."""
    return pack_documents(docs)
