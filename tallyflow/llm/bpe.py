"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of every prefix determines that encoding: cut it off and what remains is the encoding of a shorter
prefix. So a trie node needs one state, its last token, found among the tokens that end there: the one that no merge joins
with the last token of the prefix before it. Distinct words are inserted in a trie, held as their sorted list (its depth-first
order), and the walk keeps the states of the current path; a word pays only for the bytes it doesn't share with the one before.

Work is narrow: each worker walks a trie of the words it hasn't seen, and keeps encodings in a table of CACHE_BYTES, and of a slice beyond.

Defined results: a null or empty text has no tokens, and an empty table gives no rows; a text of any length is encoded whole (its pieces
are held at once); special tokens' strings in a text become their ids, as the tokenizers
library does by default; repeated documents each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import lru_cache, partial
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyflow.llm.common import map_text

#: Words' encodings that a worker keeps, by number and by bytes; the half used least lately goes first.
CACHE_WORDS, CACHE_BYTES = 1_200_000, 128 << 20
#: Of a word in the table: its string, its tuple and its place (token numbers are shared).
_WORD_BYTES = 190

#: Fixed value: the byte-level vocabularies' split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 is itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        vocab = {k: v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        self.by_bytes: dict[bytes, int] = {}
        for k, v in vocab.items():
            if k not in self.special:
                self.token[v] = bytes(map(symbol.__getitem__, k))
                self.by_bytes[self.token[v]] = v
        for k, v in self.special.items():
            self.token[v] = k.encode()
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocab[a], vocab[b]
            t = vocab[a + b]
            self.merge.setdefault((x, y), r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        #: Every ending of a token: its id, or -1 if it isn't a token itself.
        self.tails = {t[i:]: -1 for t in self.by_bytes for i in range(len(t))} | self.by_bytes
        self.text = list(map(str, range(size)))
        self.split = regex.compile(SPLIT)
        self.spaces = re.compile(r" \s|\0")
        self.border = re.compile(r" (?=\S)")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.stands = lru_cache(1 << 16)(self._stands)

    def _stands(self, x: int, y: int) -> bool:
        """Whether tokens x, y stay apart when their bytes are merged: their sides of the border, undone merge by merge."""
        limit = 1 << 60
        while True:
            r = self.merge.get((x, y))
            if r is not None and r < limit:
                return False
            a, b = self.rank[x], self.rank[y]
            if a > b:
                limit, x = a, self.right[x]
            elif b < 0:
                return True
            else:
                limit, y = b + 1, self.left[y]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words."""
        out: dict[bytes, tuple[int, ...]] = {}
        get, stands = self.tails.get, self.stands
        before, last = b"", [-1]
        for w in sorted(words):
            n, shared = len(w), 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                j = i - 1
                while (t := get(w[j:i])) is not None:
                    if t >= 0 and (j == 0 or stands(last[j], t)):
                        last.append(t)
                        break
                    j -= 1
                    if j < 0:
                        break
                if len(last) == i:
                    raise ValueError(f"no token ends at byte {i} of {w[:80]!r}")
            ids, i = [], n
            while i:
                ids.append(t := last[i])
                i -= len(self.token[t])
            out[w] = tuple(reversed(ids))
            before = w
        return out

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that are encoded apart: cut before single spaces where the split pattern cuts for certain."""
        if not self.spaces.search(text):
            out = text.replace(" ", "\0 ").split("\0")
        elif "\0" not in text:  # white space that goes on stays with what is before
            out = self.border.sub("\0 ", text).split("\0")
        else:
            at = [0, *(m.start() for m in self.border.finditer(text)), len(text)]
            out = [text[a:b] for a, b in zip(at, at[1:])]
        return out if out[0] else out[1:]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        cut = [[p if i % 2 else self.pieces(p) for i, p in enumerate(self.cut.split(t))] if self.cut and self.cut.search(t) else [self.pieces(t)] for t in texts]
        get = self.known(set(chain.from_iterable(p for c in cut for p in c[::2]))).__getitem__
        out = []
        for c in cut:
            if len(c) == 1:
                out.append(list(chain.from_iterable(map(get, c[0]))))
            else:
                out.append([x for i, p in enumerate(c) for x in ([self.special[p]] if i % 2 else chain.from_iterable(map(get, p)))])
        return out

    def known(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct pieces, from the two halves of the table or else from a trie of what is new."""
        if len(self.words) + len(pieces) > CACHE_WORDS // 2 or self.held > CACHE_BYTES // 2:
            self.older, self.words, self.held = self.words, {}, 0
        words, older = self.words, self.older
        new = pieces.difference(words)
        again = new.intersection(older)
        words.update(zip(again, map(older.__getitem__, again)))
        new -= again
        # letters after at most one space are one word; words of other pieces are often known as pieces
        plain = {p for p in new if p[1:].isalpha() and (p[0] == " " or p[0].isalpha())}
        split = {p: self.split.findall(p) for p in new - plain}
        parts = {w: words.get(w) or older.get(w) for w in set(chain.from_iterable(split.values()))}
        fresh = {w: w.encode() for w in plain.union(w for w, ids in parts.items() if ids is None)}
        ids = self.encode_words(fresh.values())
        parts.update(zip(fresh, map(ids.__getitem__, fresh.values())))
        words.update(zip(plain, map(parts.__getitem__, plain)))
        for p, ws in split.items():
            words[p] = parts[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(parts.__getitem__, ws)))
        for some in (again, new):
            self.held += _WORD_BYTES * len(some) + sum(map(len, some)) + 8 * sum(map(len, map(words.__getitem__, some)))
        return words

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Ids outside the vocabulary raise; bytes that aren't UTF-8 become U+FFFD, as in the tokenizers library."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(1)
def trie_bpe(path: str) -> TrieBPE:
    """One table for each worker process."""
    return TrieBPE(path)


def _encode(path: str, id_col: str, text_col: str):
    bpe = trie_bpe(path)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = bpe.encode_batch([t or "" for t in batch.column(text_col).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each document."""
    docs = docs.select(id_col, text_col)
    return map_text(docs, partial(_encode, path, id_col, text_col), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give a null text."""

    def run(batches):
        bpe = trie_bpe(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def _digest(path: str, id_col: str, text_col: str):
    bpe = trie_bpe(path)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for ids in bpe.encode_batch([t or "" for t in batch.column(text_col).to_pylist()]):
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(bpe.text.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return part


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, so that ids needn't leave the worker."""
    docs = docs.select(id_col, text_col)
    return map_text(docs, partial(_digest, path, id_col, text_col), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)
