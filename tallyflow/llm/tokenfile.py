"""Token-ID files with byte-plane (or bit-plane) shuffling.

A file holds ids of documents in order. Blocks of a fixed number of ids (the last may be shorter) are transposed into planes: plane
p holds byte p (or bit p) of every id. Each plane is compressed with zstandard; a plane of zeros only is stored as nothing.

    b"TFPL0001"
    planes of block 0, 1, ...
    index, zstandard: JSON of {unit, block, docs, ids, chunks: [[offset, ids, [compressed size of each plane]], ...]}
    lengths, zstandard: unsigned 32-bit ids of each document; then the document ids as signed 64-bit integers, then null flags
    offset of the index, sizes of index and of lengths: three unsigned 64-bit integers; b"TFPLEND1"

All integers are little-endian. A reader takes any block by itself through the index.

Writing sorts documents by range partitions of the id, encodes in the writing task and writes one file a partition; files are
named by a fresh name each attempt and count only when the manifest (a table of the finished ones) names them, so a task that is lost
or run twice leaves nothing that is read. Ids before a document: of the files before its own, from the manifest (one row a file),
and of those before it in the file.

Defined results: a null or empty text has the end id only; a text of any length is one document, its ids in as many blocks as it
takes; documents with equal ids are in order of their texts' hash; null ids come first; other columns are ignored; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.bpe import byte_symbols
from tallyflow.llm.common import filesystem, shared_folder, slices, without_cycle_search, written

MAGIC, TAIL = b"TFPL0001", b"TFPLEND1"
BLOCK_IDS = 1 << 16
#: Ids in the files that a task reads.
READ_IDS = 1 << 20
#: Bytes of pieces and their ids that a worker keeps; the half used least lately goes first.
CACHE_BYTES = 96 << 20
#: Of a piece in the table, besides its string and its ids.
_PLACE_BYTES = 90
#: Characters of texts whose pieces are looked up before the table's size is looked at, and of pieces whose library encodings are held at once.
TEXT_CHARS, LIBRARY_CHARS = 1 << 20, 1 << 16
_SPACES = str.maketrans("\n\r\t", "   ")


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids, lowest first; empty if all zero."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows = raw.T if unit == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [np.ascontiguousarray(r).tobytes() if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    width = n if unit == "byte" else (n + 7) // 8
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if unit == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class Writer:
    def __init__(self, out, block_ids: int = BLOCK_IDS, unit: str = "byte", level: int = 3):
        self.out, self.block, self.unit, self.zstd = out, block_ids, unit, zstandard.ZstdCompressor(level=level)
        self.buffer, self.held, self.at, self.chunks, self.lengths, self.docs, self.total = [], 0, len(MAGIC), [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.lengths.append(len(ids) // 4)
        self.docs.append(doc_id)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        a = np.frombuffer(b"".join(self.buffer), "<u4")
        end = len(a) if last else len(a) // self.block * self.block
        for i in range(0, end, self.block):
            part = a[i : min(end, i + self.block)]
            planes = [self.zstd.compress(p) if p else b"" for p in to_planes(part, self.unit)]
            self.chunks.append([self.at, len(part), list(map(len, planes))])
            self.out.write(b"".join(planes))
            self.at += sum(map(len, planes))
        self.total += end
        self.buffer, self.held = [a[end:].tobytes()], 4 * (len(a) - end)

    def close(self) -> int:
        """Writes what is left and the index; returns the number of ids."""
        self._flush(True)
        index = self.zstd.compress(json.dumps({"unit": self.unit, "block": self.block, "docs": len(self.docs), "ids": self.total, "chunks": self.chunks}).encode())
        null = np.array([d is None for d in self.docs], np.uint8)
        lengths = self.zstd.compress(np.array(self.lengths, "<u4").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes())
        self.out.write(index + lengths + struct.pack("<QQQ", self.at, len(index), len(lengths)) + TAIL)
        self.out.close()
        return self.total


class Reader:
    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(file.size() - 32)
        at, n_index, n_lengths = struct.unpack("<QQQ", (tail := file.read(32))[:24])
        if tail[24:] != TAIL:
            raise ValueError("not a token-ID file, or cut short")
        file.seek(at)
        self.index = json.loads(self.zstd.decompress(file.read(n_index)))
        rest, n = self.zstd.decompress(file.read(n_lengths)), self.index["docs"]
        self.lengths = np.frombuffer(rest, "<u4", n)
        null = np.frombuffer(rest, np.uint8, n, 12 * n)
        self.docs = [None if x else d for d, x in zip(np.frombuffer(rest, "<i8", n, 4 * n).tolist(), null.tolist())]

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][i]
        self.file.seek(at)
        planes = [self.zstd.decompress(self.file.read(s)) if s else b"" for s in sizes]
        return from_planes(planes, n, self.index["unit"])

    def documents(self):
        """(doc_id, ids as little-endian bytes) in order, a block at a time."""
        held, k = bytearray(), 0
        for doc, n in zip(self.docs, self.lengths.tolist()):
            while len(held) < 4 * n:
                held += self.block(k).tobytes()
                k += 1
            yield doc, bytes(held[: 4 * n])
            del held[: 4 * n]


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """texts in runs of at most so many characters (one text may be longer)."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield texts[start:]


class _Pieces(dict):
    """Ids of pieces, made where they are first looked up. Of two generations, the one used least lately goes first."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: str) -> bytes:
        return self.keep(piece, self.make(piece) if (ids := self.older.get(piece)) is None else ids)

    def keep(self, piece: str, ids: bytes) -> bytes:
        self.held += _PLACE_BYTES + sys.getsizeof(piece) + sys.getsizeof(ids)
        self[piece] = ids
        return ids

    def age(self) -> None:
        """To be called between groups of texts: bounds both generations to CACHE_BYTES."""
        if self.held > CACHE_BYTES // 2:
            self.older, self.held = dict(self), 0
            self.clear()
            self[""] = b""


class PieceEncoder:
    """The library's ids of whole texts, from those of their white-space separated pieces.

    Holds for vocabularies whose normaliser and splitter drop white space and never look across it. Pieces are encoded by the
    library once while they are in the table. Where normalising is lower-casing alone (Latin-1 without special tokens), case is
    folded first and the library's BPE model is given the words of a piece; any other piece goes to the library as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.pieces = _Pieces(self._plain)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in normal.get("normalizers", [])]
        folds = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and not spec["post_processor"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if folds else None
        #: Not for the short way: white space that splitters differ on, and the beginnings of special tokens in any case.
        self.odd = regex.compile("|".join(["[\x1c-\x1f\x85\xa0]", *(f"(?i:{regex.escape(x['content'][:2])})" for x in spec["added_tokens"])]))
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def _is_plain(self, text: str) -> bool:
        if self.pattern is None or self.odd.search(text):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in _groups(texts, TEXT_CHARS):
            self.pieces.age()
            out += self._encode(some)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, out, rest = self.pieces.__getitem__, [], []
        for i, text in enumerate(texts):
            if self._is_plain(text):
                out.append(b"".join(map(get, text.lower().split())))
            else:
                out.append(b"")
                rest.append((i, text.translate(_SPACES).split(" ")))
        if rest:
            self._by_library(set().union(*(cut for _, cut in rest)))
            for i, cut in rest:
                out[i] = b"".join(map(get, cut))
        return out

    def _by_library(self, pieces: set[str]) -> None:
        """Brings pieces that need the whole library into the table."""
        whole = [p for p in pieces if p not in self.pieces and p not in self.pieces.older and not (self._is_plain(p) and p == p.lower())]
        for some in _groups(whole, LIBRARY_CHARS):
            for p, x in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                self.pieces.keep(p, array("I", x.ids).tobytes())

    def _plain(self, piece: str) -> bytes:
        """The ids of a plain piece in lower case; its words, which are such pieces too, share the table."""
        if not piece.isalpha() and (words := self.pattern.findall(piece)) != [piece]:
            return b"".join(map(self.pieces.__getitem__, words))
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


@lru_cache(1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _write(folder: str, vocabulary: str, end_id: int | None, unit: str, block_ids: int):
    def run(batches):
        encoder, end, writer, first = piece_encoder(vocabulary), b"" if end_id is None else struct.pack("<I", end_id), None, None
        fs, base = filesystem(folder)
        name = f"{uuid.uuid4().hex}.tfpl"
        with without_cycle_search():
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    if writer is None and ids:
                        fs.create_dir(base, recursive=True)
                        writer, first = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), block_ids, unit), (ids[0], part.column("text_key")[0].as_py())
                    for doc, x in zip(ids, encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                        writer.add(doc, x + end)
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (*first, len(writer.docs), writer.close()))], ["file", "first_id", "first_key", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 2, unit: str = "byte", block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the documents' ids in ascending order of the id; returns the folder and the manifest.

    The manifest has file, first_id, first_key, n_docs, n_tokens. Range partitions are cut by the id and a hash of the text, so that an id
    which very many rows share, or a null one, is spread over tasks and files."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    manifest = ordered.mapInArrow(_write(folder, vocabulary, end_id, unit, block_ids), "file string, first_id long, first_key long, n_docs long, n_tokens long")
    return folder, written(manifest.repartition(1), "token-manifest")  # a row a file


def _read(folder: str, make):
    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                reader, rows = Reader(fs.open_input_file(f"{base}/{name}")), []
                for doc, raw in reader.documents():
                    n = len(raw) // 4
                    rows.append((doc, start, n, make(raw)))
                    start += n
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.list_(pa.int64()) if isinstance(x[0], list) else pa.int64())], ["doc_id", "start", "n_tokens", "x"])


def _with_starts(manifest: DataFrame) -> DataFrame:
    """One row a file; small files are read together, READ_IDS by a task. The window without partitions has as many rows as there are files."""
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_key", "file").rowsBetween(Window.unboundedPreceding, -1)
    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    tasks = min(files, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-ids // READ_IDS)))
    return manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).repartition(max(1, tasks))


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids array<bigint> of each document."""
    return _with_starts(manifest).mapInArrow(_read(folder, lambda raw: np.frombuffer(raw, "<u4").tolist()), "doc_id long, start long, n_tokens long, x array<bigint>").withColumnRenamed("x", "ids")


def digest(folder: str, manifest: DataFrame) -> DataFrame:
    """The columns of the op4 contract, from the files."""
    return _with_starts(manifest).mapInArrow(_read(folder, zlib.crc32), "doc_id long, start long, n_tokens long, x long").withColumnRenamed("x", "ids_crc32")


