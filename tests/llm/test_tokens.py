"""BPE, token files."""

import hashlib
import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge_rows import EDGES
from tokenizers import Tokenizer

from tallyflow.llm import bpe, tokenfile

POOL = ["'s", "'LL", " ", "  ", "\n", " \n", "\t", "é", "é", "́", "Σ", "ΑΣ", "J̌", "漢字", "👩‍👧", "a", "The", "<|endoftext|>", "<|startoftext|>", "12", "½", "²", "\xa0", "　", "\x1c", "\x85", "\0", "###", "____", "=" * 30, "Don't", "\r\n", "ſ", "K", "İ"]


def texts():
    rnd = random.Random(1)
    return ["".join(rnd.choices(POOL, k=rnd.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t in EDGES]


def test_trie_encoding_is_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library, all_texts = bpe.TrieBPE(path), Tokenizer.from_file(path), texts()
    want = [x.ids for x in library.encode_batch(all_texts, add_special_tokens=False)]
    got = own.encode_batch(all_texts)
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want] == all_texts


def test_cache_bound_changes_nothing(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = bpe.TrieBPE(path).encode_batch(texts())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    own = bpe.TrieBPE(path)
    assert [own.encode_batch([t])[0] for t in texts()] == want


def test_decode_of_partial_characters():
    own = bpe.trie_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.decode(own.encode_batch(["漢"])[0][:1]) == "�"


def test_round_trip_operator(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.round_trip(documents(EDGES), path).collect()
    want = []
    for i, t in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(EDGES), path), path).collect()}
    assert back == {i: t or "" for i, t in EDGES}
    assert bpe.round_trip(documents([]), path).count() == 0


def test_pieces_are_encoded_as_the_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokenfile.PieceEncoder(path)
    all_texts = texts()
    assert own.encode(all_texts) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(all_texts, add_special_tokens=False)]


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes(unit, n):
    a = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (tokenfile.from_planes(tokenfile.to_planes(a, unit), n, unit) == a).all()


class Memory(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_file_round_trip_and_damage(unit):
    docs = [(i if i % 5 else None, np.arange(i * 3, dtype="<u4").tobytes()) for i in range(40)]
    out = Memory()
    w = tokenfile.Writer(out, block_ids=64, unit=unit)
    for d in docs:
        w.add(*d)
    assert w.close() == sum(len(x) // 4 for _, x in docs)
    assert list(tokenfile.Reader(Memory(out.getvalue())).documents()) == docs
    r = tokenfile.Reader(Memory(out.getvalue()))
    assert (r.block(3) == np.frombuffer(b"".join(x for _, x in docs), "<u4")[192:256]).all()
    with pytest.raises(ValueError):
        tokenfile.Reader(Memory(out.getvalue()[:-1]))


def test_files_operator(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder, manifest = tokenfile.write(documents(EDGES), path, block_ids=100)
    rows = sorted(tokenfile.digest(folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in EDGES), key=lambda i: (i is not None, i))
    at, by = 0, {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in EDGES}
    for r in rows:
        raw = by[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    ids = {r.doc_id: r.ids for r in tokenfile.read(folder, manifest).collect()}
    assert all(np.array(ids[i], "<u4").tobytes() == by[i] for i in by)
    assert tokenfile.digest(*tokenfile.write(documents([]), path)).count() == 0


@pytest.mark.parametrize("letters", ["漢字仮名交文" * 5, "abcdefghijklm"])
def test_piece_table_keeps_to_its_bytes(monkeypatch, letters):
    """Pieces of any length and script, with their ids, count by what they take, also within one call."""
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 1 << 20)
    monkeypatch.setattr(tokenfile, "TEXT_CHARS", 20_000, raising=False)
    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    texts = [" ".join("".join(rnd.choices(letters, k=rnd.randint(5, 60))) for _ in range(50)) for _ in range(300)]
    own = tokenfile.PieceEncoder(path)
    got = own.encode(texts)
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for table in (own.pieces, own.pieces.older) for k, v in table.items())
    assert held <= 1.2 * (1 << 20)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(x.ids, "<u4").tobytes() for x in want]


def test_small_files_share_tasks(spark, documents, monkeypatch):
    """The manifest is one file, and files of few ids are read together: each task that writes in the JVM starts processes there."""
    monkeypatch.setattr(tokenfile, "READ_IDS", 1 << 20, raising=False)
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        folder, manifest = tokenfile.write(documents([(i, f"text {i}") for i in range(400)]), public_tokenizers.path("word_bpe_49k.json"))
        found = tokenfile.digest(folder, manifest)
        assert manifest.count() > spark.sparkContext.defaultParallelism and len(manifest.inputFiles()) == 1
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert [r.doc_id for r in found.orderBy("start").collect()] == list(range(400))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
