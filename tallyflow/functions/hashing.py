"""Hashes of n-grams: one 64-bit hash each, masked to any power-of-two number of buckets.

Modes: "murmur" (MurmurHash3 x64 128, halves XORed; an Arrow UDF over the distinct values of a batch), "md5" (its first 32 bits, SQL
everywhere) and "xxhash" (built in, fastest). Row i of a Count-Min sketch has its own hash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The feature-hashing seed, and the golden-ratio step of sketch rows (its low 32 bits count).
FEATURE_SEED = 262469836
ROW_STEP = 0x9E3779B97F4A7C15

# MurmurHash3 x64 128 constants.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_A1, _A2, _FIVE = np.uint64(0x52DCE729), np.uint64(0x38495AB5), np.uint64(5)


def row_seed(i: int) -> int:
    return (i * ROW_STEP) & 0xFFFFFFFF


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _F1
    x = (x ^ (x >> np.uint64(33))) * _F2
    return x ^ (x >> np.uint64(33))


def murmur_halves(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of MurmurHash3 x64 128 of each key, all keys at once: round j handles block j of those that have one."""
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    h1 = np.full(len(keys), seed, np.uint64)
    h2 = h1.copy()
    order = np.argsort(n, kind="stable")
    longest = int(n.max(initial=0))
    width = longest // 16 * 16 + 16
    # keys of very different sizes are padded group by group, so that one long key doesn't widen all
    for part in np.split(order, np.searchsorted(n[order], [2 ** e for e in range(5, max(6, width.bit_length() + 1))])):
        if not len(part):
            continue
        w = int(n[part].max()) // 16 * 16 + 16
        words = np.frombuffer(b"".join(keys[i].ljust(w, b"\0") for i in part), "<u8").reshape(len(part), -1)
        a, b, blocks = h1[part], h2[part], n[part] // 16
        for j in range(int(blocks.max())):
            on = np.flatnonzero(blocks > j)
            x = _rotl(words[on, 2 * j] * _C1, 31) * _C2
            y = _rotl(words[on, 2 * j + 1] * _C2, 33) * _C1
            p = _rotl(a[on] ^ x, 27) + b[on]
            p = p * _FIVE + _A1
            a[on] = p
            b[on] = (_rotl(b[on] ^ y, 31) + p) * _FIVE + _A2
        at = np.arange(len(part))
        x, y = words[at, 2 * blocks], words[at, 2 * blocks + 1]
        a ^= _rotl(x * _C1, 31) * _C2
        b ^= _rotl(y * _C2, 33) * _C1
        h1[part], h2[part] = a, b
    size = n.astype(np.uint64)
    h1, h2 = h1 ^ size, h2 ^ size
    h1 += h2
    h2 += h1
    h1, h2 = _mix(h1), _mix(h2)
    h1 += h2
    h2 += h1
    return h1, h2


def murmur(keys: list[bytes], seed: int) -> np.ndarray:
    """The halves XORed, as signed 64-bit integers."""
    h1, h2 = murmur_halves(keys, seed)
    return (h1 ^ h2).view(np.int64)


# MD5's shifts and constants (RFC 1321).
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_FROM = [(1, 0), (5, 1), (3, 5), (7, 0)]
#: Keys that are hashed at once (their state stays in the processor's cache), and bytes of a key that fits in one block.
_MD5_KEYS, _MD5_BYTES = 4096, 55


def _md5_block(words: np.ndarray) -> np.ndarray:
    """First 32 bits, as a little-endian word, of the MD5 of each column: 16 words, one padded block."""
    start = [np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    used = words.any(axis=1)
    for i in range(64):
        step, at = _FROM[i >> 4]
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, np.uint32(_SINES[i]), out=f)
        if used[m := (step * (i & 15) + at) & 15]:
            np.add(f, words[m], out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=g), np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, g, out=f), np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a + start[0]


def md5_first(keys: list[str], prefixes: list[bytes]) -> np.ndarray:
    """The first 32 bits of the MD5 of each prefix and key, a row a prefix, as signed 64-bit integers: short keys all at once, others
    one by one."""
    out = np.empty((len(prefixes), len(keys)), np.int64)
    most = _MD5_BYTES - max(map(len, prefixes))
    for first in range(0, len(keys), _MD5_KEYS):
        part = keys[first : first + _MD5_KEYS]
        data = "".join(part).encode()
        n = np.fromiter(map(len, part), np.int64, len(part))
        if len(data) != n.sum() or n.max() > most:
            coded = [x.encode() for x in part]
            n = np.fromiter(map(len, coded), np.int64, len(part))
            long = np.flatnonzero(n > most)
            for i in long:
                for j, p in enumerate(prefixes):
                    out[j, first + i] = int.from_bytes(hashlib.md5(p + coded[i]).digest()[:4], "big")
                coded[i] = b""
            n[long] = 0
            data = b"".join(coded)
        else:
            long = ()
        text = np.zeros((len(part), 64), np.uint8)
        text[np.arange(64) < n[:, None]] = np.frombuffer(data, np.uint8)
        text[np.arange(len(part)), n] = 0x80
        words = np.empty((16, len(prefixes), len(part)), np.uint32)
        for j, p in enumerate(prefixes):
            block = text
            if p:
                block = np.empty_like(text)
                block[:, len(p) :], block[:, : len(p)] = text[:, : -len(p)], np.frombuffer(p, np.uint8)
            words[:, j] = block.view("<u4").T
            words[14, j] = (n + len(p)) * 8
        found = _md5_block(words.reshape(16, -1)).byteswap().reshape(len(prefixes), -1)
        short = np.ones(len(part), bool)
        short[list(long)] = False
        out[:, first : first + len(part)][:, short] = found[:, short]
    return out


def _murmur_udf(seeds: list[int]):
    @F.pandas_udf("array<bigint>")
    def hashed(s: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(s)
        keys = [x.encode() for x in distinct]
        table = np.stack([murmur(keys, seed) for seed in seeds], axis=1) if keys else np.zeros((0, len(seeds)), np.int64)
        return pd.Series(list(table[codes]))

    return hashed


def _md5(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def feature_hash(ng: Column, mode: str = "md5") -> Column:
    """One hash a row: array of one, for feature hashing."""
    if mode == "murmur":
        return _murmur_udf([FEATURE_SEED])(ng)
    return F.array(_md5(ng) if mode == "md5" else F.xxhash64(ng))


def sketch_hashes(ng: Column, rows: int, mode: str = "md5") -> Column:
    """One hash for each sketch row. Fewer rows are a prefix of more."""
    if mode == "murmur":
        return _murmur_udf([row_seed(i) for i in range(rows)])(ng)
    if mode == "md5":
        return F.array(*(_md5(F.concat(F.lit(f"{i}:"), ng)) for i in range(rows)))
    return F.array(*(F.xxhash64(F.lit(i), ng) for i in range(rows)))


def bucket(h: Column, log_buckets: int | Column) -> Column:
    """h mod 2^log_buckets, by mask."""
    if isinstance(log_buckets, int):
        return h.bitwiseAND(F.lit((1 << log_buckets) - 1))
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), log_buckets) - 1)


