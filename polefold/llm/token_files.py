"""Operator 12, token ids in files of patched frame-of-reference blocks.

A document's ids are those of the tokenizer and one end id. Documents are dealt out by ranges of
(doc_id, hash of the text), so equal ids are no hot range, and each task writes its range, in order,
to files of its own in a shared folder. A file holds blocks of ``BLOCK`` ids: a block's minimum is
subtracted, what is left is packed at the width that ``SHARE`` of its values need, and the high bits of
the others stand in the block's list of exceptions. An index at the file's end gives each block's
start and each document's end, so any range of ids is read from its own blocks alone. A list of
files with their first ids lies beside them; it names only files of tasks that succeeded, so tasks
that are tried again or twice leave nothing behind that would be read.

Layout of a file (little-endian): blocks; doc_ids (i8), missing doc_ids (u1), ends (i8), minimums
(u4), widths (u1), exceptions (u2), starts of blocks (u8); then documents, blocks, ids, place of the
index (u8 each) and ``MAGIC``. A block: 32 rows of 32 lanes, row r at bit r x width of its lane's
words; then places (u2) and high bits (u4) of exceptions. The last block is filled with its minimum.

Defined cases: null text is empty and gives the end id alone; rows with equal doc_id follow each other
in order of a hash of the text, null doc_id first; repeated rows are written each; an empty table
gives a folder without files and no rows; literal special tokens give their ids, as the tokenizer
does by default; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
BLOCK, SHARE, MAGIC = 1024, 0.9, b"PFORIDS1"
FILE_IDS = 1 << 25
_AT_ONCE = 256  # blocks
_MEMO, _WORDS, _PART, _TOGETHER = 200_000, 800_000, 1 << 18, 1 << 20
_DOUBLED = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
_TRAILER = struct.Struct("<4Q8s")
_INDEX = (("doc_ids", "<i8"), ("missing", "u1"), ("ends", "<i8"), ("minimums", "<u4"), ("widths", "u1"), ("exceptions", "<u2"), ("starts", "<u8"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- ids of texts


class ByteTokenizer:
    """Ids of whole texts by a byte-level tokenizer, piece by piece.

    The tokenizer finds its added tokens, cuts what is between them by one pattern and encodes the
    pieces one by one. Pieces are cut here, in bytes where all characters beyond ASCII are letters, and
    kept in a memo of bounded size; new ones go to the tokenizer's model many at a time. Each character
    is tried against the tokenizer once; texts with one that it sees otherwise go through it whole.
    """

    CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut = told["pre_tokenizer"]
        if told["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError("a tokenizer that does not cut whole bytes by the usual pattern")
        added = self.inner.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("an added token that is not matched as it stands")
        self.marks = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.at_marks = re.compile(b"(" + (b"|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) or b"(?!)") + b")")
        self.model = Tokenizer(self.inner.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.sizes = np.zeros(self.inner.get_vocab_size(), np.int64)
        for token, i in self.inner.get_vocab().items():
            self.sizes[i] = len(token)
        wide, near = "[^\\W\\d_]", "A-Za-z\\x80-\\xff"
        rest = f"|{self.CONTRACTIONS}| ?%s+| ?%s+|\\s+(?!\\S)|\\s+"
        self.cut_bytes = re.compile((f" ?[{near}]+" + rest % ("[0-9]", f"[^\\s{near}0-9]")).encode()).findall
        self.cut_text = re.compile(f" ?{wide}+" + rest % ("\\d", "(?:[^\\s\\w]|_)")).findall
        self.beyond = re.compile(rb"[\x80-\xff]+").findall
        self.break_at = re.compile(rb"[!-~][ \n]")
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.lettered: dict[bytes, bool] = {}
        self.agreed: dict[str, bool] = {}
        self.plain = [bytes([c]) for c in range(128) if self._kind(chr(c)) != self._own_kind(lambda t: self.cut_bytes(t.encode()), chr(c))]

    def _kind(self, char: str) -> tuple[bool, ...]:
        return self._own_kind(lambda t: [t[a:b] for _, (a, b) in self.inner.pre_tokenizer.pre_tokenize_str(t)], char)

    @staticmethod
    def _own_kind(cut, char: str) -> tuple[bool, ...]:
        """Is it cut as letter, number, other sign or white space, and does a blank before it belong to it?"""
        return tuple(len(cut(form.format(char))) == n for form, n in (("a{}", 1), ("1{}", 1), ("!{}", 1), ("\n{}", 1), (" {}", 1), ("a {0}{0}b", 2), ("{0} a", 2)))

    def _cut(self, raw: bytes) -> list[bytes] | tuple[bytes, ...] | None:
        """Pieces of a text without added tokens, or its parts between blanks, which pieces do not cross
        where no white space is doubled; None where only the tokenizer itself will do."""
        if any(c in raw for c in self.plain):
            return None
        plain = not any(x in raw for x in _DOUBLED)
        if raw.isascii():
            return tuple(raw.split(b" ")) if plain else self.cut_bytes(raw)
        for run in set(self.beyond(raw)):
            known = self.lettered.get(run)
            if known is None:
                known = all(self._kind(c)[0] for c in run.decode("utf-8", "replace"))
                if len(self.lettered) < _MEMO:
                    self.lettered[run] = known
            if not known:
                break
        else:
            return tuple(raw.split(b" ")) if plain else self.cut_bytes(raw)
        text = raw.decode("utf-8", "replace")
        for char in set(text):
            if char not in self.agreed:
                self.agreed[char] = self._kind(char) == self._own_kind(self.cut_text, char)
            if not self.agreed[char]:
                return None
        return [p.encode() for p in self.cut_text(text)]

    def _parts(self, raw: bytes) -> Iterator[list[bytes] | tuple[bytes, ...] | bytes]:
        """Pieces of a text part by part; ids of added tokens and of parts that the tokenizer takes whole."""
        marked = any(mark in raw for mark in self.marks)
        for i, piece in enumerate(self.at_marks.split(raw) if marked else [raw]):
            if i % 2:
                yield self.marks[piece]
                continue
            at = 0
            while at < len(piece):
                end = len(piece)
                if end - at > _PART and (stop := self.break_at.search(piece, at + _PART)):
                    end = stop.start() + 1  # a blank after a sign begins a piece
                part = piece[at:end]
                cut = self._cut(part)
                if cut is None:
                    yield np.array(self.inner.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield cut
                at = end

    def _encode(self, new: list[bytes]) -> list[bytes]:
        texts = [self.letters[np.frombuffer(b"\xff".join(new[i : i + 256]), np.uint8)].tobytes().decode("utf-32-le") for i in range(0, len(new), 256)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        # an id stands for so many bytes, so a piece's ids end where its bytes do
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))) + 1
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            fresh = dict(zip(new, self._encode(new)))
            if len(self.known) + len(fresh) <= _MEMO:
                self.known.update(fresh)
            for i in missing:
                found[i] = fresh[pieces[i]]
        return found

    def _look_up_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word with a blank before it."""
        found = list(map(self.words.get, words))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            new = list(dict.fromkeys([words[i] for i in missing]))
            cut = [self.cut_bytes(b" " + w) for w in new]
            ids, ends = self._look_up([p for c in cut for p in c]), np.cumsum([len(c) for c in cut]).tolist()
            fresh = dict(zip(new, [b"".join(ids[a:b]) if b - a > 1 else ids[a] for a, b in zip([0, *ends], ends)]))
            if len(self.words) + len(fresh) <= _WORDS:
                self.words.update(fresh)
            for i in missing:
                found[i] = fresh[words[i]]
        return found

    def ids(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of UTF-8 texts; new pieces of all of them are encoded at once."""
        pieces: list[bytes] = []
        words: list[bytes] = []
        texts: list[list[tuple]] = []
        for raw in raws:
            texts.append(own := [])
            for part in self._parts(raw):
                if isinstance(part, bytes):
                    own.append((part, None))
                    continue
                whole = isinstance(part, tuple)
                cut = self.cut_bytes(part[0]) if whole else part
                own.append((pieces, slice(len(pieces), len(pieces) + len(cut))))
                pieces += cut
                if whole:
                    own.append((words, slice(len(words), len(words) + len(part) - 1)))
                    words += part[1:]
        found = {id(pieces): self._look_up(pieces), id(words): self._look_up_words(words)}
        return [b"".join([x if at is None else b"".join(found[id(x)][at]) for x, at in own]) for own in texts]


def _byte_letters() -> np.ndarray:
    """Byte -> the character that stands for it in a byte-level vocabulary; 255, which UTF-8 lacks, is a blank."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = np.arange(256, dtype="<u4")
    others = [b for b in range(256) if b not in plain]
    out[others] = 256 + np.arange(len(others))
    out[255] = ord(" ")
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


# --- blocks


def pack(values: np.ndarray, share: float = SHARE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Payload, minimums, widths, exceptions and sizes (bytes) of blocks of unsigned 32-bit values [block, BLOCK]."""
    values = values.astype(np.uint32, copy=False)
    least = values.min(1)
    rest = values - least[:, None]
    kth = max(0, int(np.ceil(share * BLOCK)) - 1)
    width = np.frexp(np.partition(rest, kth, axis=1)[:, kth].astype(np.float64))[1].astype(np.int64)
    beyond = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    count = beyond.sum(1)
    at_block, at = np.nonzero(beyond)
    high = (rest[at_block, at].astype(np.uint64) >> width[at_block].astype(np.uint64)).astype("<u4")
    at = at.astype("<u2")
    ends = np.cumsum(count)
    packed: list[np.ndarray | None] = [None] * len(values)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        low = (rest[own].astype(np.uint64) & np.uint64((1 << w) - 1)).astype(np.uint32).reshape(-1, 32, 32)
        words = np.zeros((len(own), w, 32), "<u4")
        for r in range(32 if w else 0):
            word, shift = divmod(r * w, 32)
            words[:, word] |= low[:, r] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= low[:, r] >> np.uint32(32 - shift)
        for i, block in zip(own.tolist(), words):
            packed[i] = block
    parts = []
    for i, end in enumerate(ends.tolist()):
        first = end - int(count[i])
        parts += [packed[i].tobytes(), at[first:end].tobytes(), high[first:end].tobytes()]
    return b"".join(parts), least, width.astype(np.uint8), count.astype(np.uint16), 128 * width + 6 * count


def unpack(payload: bytes, starts: np.ndarray, least: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Values [block, BLOCK] of blocks that begin at ``starts`` of the payload."""
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if not w:
            out[own] = 0
            continue
        words = np.stack([np.frombuffer(payload, "<u4", 32 * w, int(starts[i])) for i in own]).reshape(-1, w, 32)
        values = np.zeros((len(own), 32, 32), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for r in range(32):
            word, shift = divmod(r * w, 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | words[:, word + 1] << np.uint32(32 - shift)
            values[:, r] = value & mask
        out[own] = values.reshape(-1, BLOCK)
    for i in np.flatnonzero(count).tolist():
        n, after = int(count[i]), int(starts[i]) + 128 * int(width[i])
        high = np.frombuffer(payload, "<u4", n, after + 2 * n)
        out[i, np.frombuffer(payload, "<u2", n, after)] |= high << np.uint32(width[i])
    return out + least.astype(np.uint32)[:, None]


# --- files


def _place(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


class Writer:
    """One file: documents in order, then the index."""

    def __init__(self, folder: str, name: str, share: float = SHARE):
        system, path = _place(folder)
        self.out = system.open_output_stream(f"{path}/{name}")
        self.share, self.name, self.at, self.ids = share, name, 0, 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.index: list[tuple[np.ndarray, ...]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids += len(ids) // 4
        self.doc_ids.append(doc_id)
        self.ends.append(self.ids)
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)
        if self.waiting_bytes >= 4 * BLOCK * _AT_ONCE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(values) // BLOCK * BLOCK
        blocks, rest = values[:whole].reshape(-1, BLOCK), values[whole:]
        if last and len(rest):
            blocks = np.concatenate([blocks, np.concatenate([rest, np.full(BLOCK - len(rest), rest.min(), np.uint32)])[None]])
            rest = rest[:0]
        self.waiting, self.waiting_bytes = [rest.tobytes()], rest.nbytes
        for lo in range(0, len(blocks), _AT_ONCE):
            payload, least, width, count, size = pack(blocks[lo : lo + _AT_ONCE], self.share)
            starts = self.at + np.cumsum(size) - size
            self.index.append((least, width, count, starts))
            self.out.write(payload)
            self.at += len(payload)

    def close(self) -> tuple[str, int, int, int]:
        """Name, documents, ids, bytes."""
        self._flush(True)
        of_blocks = [np.concatenate(x) for x in zip(*self.index)] or [np.zeros(0)] * 4
        columns = [np.array([d or 0 for d in self.doc_ids], np.int64), np.array([d is None for d in self.doc_ids]), np.array(self.ends), *of_blocks]
        index = b"".join(c.astype(kind).tobytes() for c, (_, kind) in zip(columns, _INDEX))
        self.out.write(index)
        self.out.write(_TRAILER.pack(len(self.ends), len(of_blocks[0]), self.ids, self.at, MAGIC))
        self.out.close()
        return self.name, len(self.ends), self.ids, self.at + len(index) + _TRAILER.size


class Reader:
    """Random access to one file."""

    def __init__(self, folder: str, name: str):
        system, path = _place(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        documents, blocks, self.ids_in_all, at, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a file of packed ids")
        raw, done = self.file.read_at(size - _TRAILER.size - at, at), 0
        for i, (key, kind) in enumerate(_INDEX):
            many = documents if i < 3 else blocks
            setattr(self, key, np.frombuffer(raw, kind, many, done))
            done += many * np.dtype(kind).itemsize
        self.last = at

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids of a range, from its blocks alone."""
        if end <= first:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, -(-end // BLOCK)
        begin = int(self.starts[lo])
        stop = int(self.starts[hi]) if hi < len(self.starts) else self.last
        found = unpack(self.file.read_at(stop - begin, begin), (self.starts[lo:hi] - np.uint64(begin)).astype(np.int64), self.minimums[lo:hi], self.widths[lo:hi], self.exceptions[lo:hi])
        return found.ravel()[first - lo * BLOCK : end - lo * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, first id, ids, CRC-32 of the ids, of every document; a bounded number of blocks at a time."""
        first = crc = doc = 0
        for at in range(0, max(self.ids_in_all, 0), BLOCK * _AT_ONCE):
            values = self.ids(at, min(at + BLOCK * _AT_ONCE, self.ids_in_all)).astype("<u4")
            done = at
            while doc < len(self.ends) and (end := int(self.ends[doc])) <= at + len(values):
                crc = zlib.crc32(values[done - at : end - at], crc)
                yield None if self.missing[doc] else int(self.doc_ids[doc]), first, end - first, crc
                first = done = end
                crc, doc = 0, doc + 1
            crc = zlib.crc32(values[done - at :], crc)

    def close(self) -> None:
        self.file.close()


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, share: float = SHARE, file_ids: int = FILE_IDS) -> list[dict]:
    """Writes all documents to files in ``folder``, in ascending order; the list of files, which is also written there."""
    path = path or vocabulary_path()
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    end = np.array([end_id], "<u4").tobytes()
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumn("tie", F.xxhash64("raw"))
    dealt = named.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "raw")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = _tokenizer(path), TaskContext.get()
        made: list[tuple] = []
        writer: Writer | None = None
        for batch in batches:
            doc_ids, raws = batch.column("doc_id").to_pylist(), common.text_bytes(batch.column("raw"))
            for lo, hi in common.slices(raws, _TOGETHER):
                for doc_id, ids in zip(doc_ids[lo:hi], tokenizer.ids(raws[lo:hi])):
                    if writer is None:
                        writer = Writer(folder, f"part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.pfor", share)
                    writer.add(doc_id, ids + end)
                    if writer.ids >= file_ids:
                        made.append(writer.close())
                        writer = None
        if writer is not None:
            made.append(writer.close())
        columns = list(zip(*[(task.partitionId(), i, *x) for i, x in enumerate(made)])) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "place", "file", "documents", "ids", "bytes"])

    written = common.materialise(common.map_batches(dealt, work, "part int, place int, file string, documents long, ids long, bytes long"))
    files, first = [], 0
    for row in sorted(written.collect()):  # a row a file
        files.append({"file": row["file"], "first": first, "documents": row["documents"], "ids": row["ids"], "bytes": row["bytes"]})
        first += row["ids"]
    with system.open_output_stream(f"{root}/files.json") as out:
        out.write(json.dumps({"format": MAGIC.decode(), "block": BLOCK, "files": files}).encode())
    return files


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    system, root = _place(folder)
    with system.open_input_stream(f"{root}/files.json") as told:
        files = json.loads(told.read())["files"]
    rows = spark.createDataFrame([(f["file"], f["first"]) for f in files], "file string, first long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 4, kinds)], names)

        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                reader, found = Reader(folder, name), []
                for doc_id, start, n, crc in reader.documents():
                    found.append((doc_id, first + start, n, crc))
                    if len(found) == 10_000:
                        yield batch_of(found)
                        found = []
                reader.close()
                yield batch_of(found)

    return common.map_batches(rows.repartition(max(1, len(files))), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.own_folder(spark)
    write(common.table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
