"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned to principal axes and then by rotations learned to lose least in taking signs (alternating
least squares on a bounded sample); ROTATIONS rotations give as many bits as there are axes each. Codes are split into substrings of
8 bits and every substring is indexed.

Search: within Hamming radius r of a query, by the pigeonhole principle, some substring s is within its share r_s (the shares are
floor(r / m) or one less, with sum r - m + 1). For each substring the index holds, for each of its 256 values, the set of rows within
the share; a query's candidates are the union of its own values' sets, so every code within r is retrieved. Codes over r are dropped,
and the rest is ranked by inner products of the original vectors in double precision. A query that finds fewer than k rows in an
index block has its radius grown there until it does, so no query comes back short.

The radius is learned: a bounded set of queries is held against all rows exactly, and r is the distance within which RECALL of
their true neighbours lie.

Plan: rows are dealt evenly into index blocks of about INDEX_ROWS and query blocks of about QUERY_ROWS; each pair of blocks meets in
one task of bounded memory and yields at most k rows a query. Every row is indexed.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do those of another
length than the most frequent one (of equals the smaller); rows that repeat a vec_id are candidates each, but not of their own id's
query, and a repeated query is answered once; rows with a null id take no part; ties go to the smaller id; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that rotations are learned from, and queries that the radius is learned from.
FIT_ROWS, FIT_QUERIES = 4096, 96
ROTATIONS, ROUNDS, RECALL = 2, 30, 0.97
INDEX_ROWS, QUERY_ROWS = 1 << 15, 1 << 10


@dataclass
class Codes:
    """Learned codes: bits of a vector are the signs of (vector - mean) @ axes."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int = 0
    popcount: np.ndarray = field(default_factory=lambda: np.array([i.bit_count() for i in range(256)], np.uint8))

    @classmethod
    def fit(cls, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS, seed: int = 7) -> Codes:
        mean = sample.mean(axis=0)
        _, _, vt = np.linalg.svd(sample - mean, full_matrices=False)
        if len(vt) < sample.shape[1]:  # fewer rows than axes
            vt = np.linalg.qr(np.concatenate((vt, np.eye(sample.shape[1]))).T)[0].T[: sample.shape[1]]
        v, rng, axes = (sample - mean) @ vt.T, np.random.default_rng(seed), []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            axes.append(vt.T @ r)
        return cls(mean, np.concatenate(axes, axis=1))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substrings (bytes) of each row's code."""
        return np.packbits((x - self.mean) @ self.axes > 0, axis=1)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances of all codes a to all codes b."""
        out = np.zeros((len(a), len(b)), np.uint16)
        for s in range(a.shape[1]):
            out += self.popcount[a[:, s, None] ^ b[None, :, s]]
        return out


class MultiIndex:
    """Substring indexes over a block of codes."""

    def __init__(self, codes: Codes, rows: np.ndarray):
        self.codes, self.rows, self.sets = codes, rows, {}
        pad = -rows.shape[1] % 8
        self.wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(np.uint64)
        self.pad = pad

    def _near(self, s: int, share: int) -> np.ndarray:
        """For each value of substring s, the bit set of rows whose substring is within the share."""
        if (s, share) not in self.sets:
            values = np.arange(256, dtype=np.uint8)[:, None]
            self.sets[s, share] = np.packbits(self.codes.popcount[values ^ self.rows[None, :, s]] <= share, axis=1)
        return self.sets[s, share]

    def within(self, queries: np.ndarray, radius: int) -> list[np.ndarray]:
        """Positions of all rows within the radius of each query code."""
        m, n = self.rows.shape[1], len(self.rows)
        share, more = divmod(radius, m)
        found = np.zeros((len(queries), (n + 7) // 8), np.uint8)
        for s in range(m):
            own = share if s <= more else share - 1
            if own >= 0:
                found |= self._near(s, own)[queries[:, s]]
        wide = np.ascontiguousarray(np.pad(queries, ((0, 0), (0, self.pad)))).view(np.uint64)
        out = []
        for q, bits in zip(wide, found):
            at = np.flatnonzero(np.unpackbits(bits, count=n))
            out.append(at[np.bitwise_count(self.wide[at] ^ q).sum(axis=1, dtype=np.int64) <= radius])
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 0))
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def best(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k largest inner products among rows `at`, ties to smaller ids. Equal vectors get equal scores."""
    at = at[ids[at] != own]
    score = (x[at] * q).sum(axis=1)
    if len(at) > k:
        keep = score >= np.partition(score, len(at) - k)[len(at) - k]
        at, score = at[keep], score[keep]
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at[order]], score[order]


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """The n rows whose ids' hashes are smallest; n is a fixed bound."""
    return _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vector").toArrow().column("vector"))


def _exact(codes: Codes, queries: pa.Table, k: int):
    own, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"))
    code = codes.encode(q)

    def run(batches):
        top: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(own)
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector"))
            if not len(ids):
                continue
            far, score = codes.distances(code, codes.encode(x)), q @ x.T
            for i, (a, s, d) in enumerate(top):
                at = np.flatnonzero(ids != own[i])
                at = at[np.argsort(-score[i, at])[:k]]
                a, s, d = np.concatenate((a, ids[at])), np.concatenate((s, score[i, at])), np.concatenate((d, far[i, at]))
                keep = np.argsort(-s)[:k]
                top[i] = a[keep], s[keep], d[keep]
        rows = [(o, *x) for o, t in zip(own.tolist(), top) for x in zip(*(c.tolist() for c in t))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query_id", "vec_id", "score", "far"])

    return run


def _radius(rows: DataFrame, queries: DataFrame, codes: Codes, k: int) -> int:
    """The Hamming distance within which RECALL of the true neighbours of a bounded set of queries lie, of all rows."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).toArrow()
    exact = rows.mapInArrow(_exact(codes, some, k), "query_id long, vec_id long, score double, far long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    far = exact.withColumn("rank", rank).where(F.col("rank") <= k).agg(F.percentile("far", RECALL).alias("r")).first()["r"]
    return int(np.ceil(far)) if far is not None else 0


def _search(codes: Codes, k: int):
    def pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(rows):
            own, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"))
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"))
            index, code, r = MultiIndex(codes, codes.encode(x)), codes.encode(q), codes.radius
            need, left = min(k + 1, len(ids)), np.arange(len(own))
            while len(left):
                found = index.within(code[left], r)
                short = np.array([len(at) < need and r < codes.axes.shape[1] for at in found])
                for i, at in zip(left[~short].tolist(), (at for at, s in zip(found, short) if not s)):
                    a, s = best(q[i], own[i], x, ids, at, k)
                    out += zip([int(own[i])] * len(a), a.tolist(), s.tolist())
                left, r = left[short], r + 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return pair


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; both sides as `valid_vectors` gives them."""
    queries = queries.dropDuplicates(["vec_id"])
    n, n_q = rows.count(), queries.count()
    schema = "query_id long, vec_id long, score double"
    if not n or not n_q:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = Codes.fit(_sample(rows, FIT_ROWS))
    codes.radius = _radius(rows, queries, codes, k)
    blocks, q_blocks = -(-n // index_rows), -(-n_q // query_rows)
    block = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vector"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "vector", block(q_blocks, 1).alias("q_block")).select("*", every(blocks).alias("x_block"))
    right = rows.select("vec_id", "vector", block(blocks, 2).alias("x_block")).select("*", every(q_blocks).alias("q_block"))
    keys = ("q_block", "x_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(codes, k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
