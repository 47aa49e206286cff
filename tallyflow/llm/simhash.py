"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits. For radius r = 3, bit i gets a vector m(i) in {1..15}, all of them equally often; table v in {1..15}
keeps the bits whose <m(i), v> is odd. Any 3 differing bits leave a v that is orthogonal to their three vectors, and table v masks
all of them: every pair within the radius meets in some table, without exception.

Distinct fingerprints only are tabled (copies collapse first). A bucket's links are cut down to a spanning forest where they are
found, so at most one link leaves for each fingerprint and table. Buckets of over HOT fingerprints are dealt again by a second
covering family over the bits that the first left free; what the two leave free is at most 16 bits, so such a bucket holds at most
2^16 fingerprints whatever the data. No bucket is capped.

Defined results: a text of any length is read whole (its shingles' hashes are held at once, 8 bytes each and an object); a null, empty
or wordless text has fingerprint zero and is linked like any other; under three words the whole
sequence is the one shingle; repeated documents share a component; null ids take part but are never a component's id (a component
of null ids only has a null one); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import map_text, text_bytes, written
from tallyflow.llm.components import connected_components

RADIUS, BITS, SHINGLE, SEED = 3, 64, 3, 42
#: Fingerprints in a bucket that one task compares at once; larger buckets are dealt by more bits.
HOT = 512
#: Hot buckets that are sent to all executors (24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


def fingerprint(text: bytes | None) -> int:
    w = (text or b"").lower().split()  # bytes: A-Z only; white space is \x20, \x09-\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(a: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero of none."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(a), 1 << 16):
        count += np.unpackbits(a[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(a), bitorder="little").view(np.uint64)[0])


def _fingerprints(id_col: str, text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in text_bytes(batch.column(text_col))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps)], ["doc_id", "fp"])

    return part


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    docs = docs.select(id_col, text_col)
    return map_text(docs, partial(_fingerprints, id_col, text_col), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long", text_col)


def covering_masks(bits: list[int]) -> list[int]:
    """2^(RADIUS+1) - 1 masks over the given bit positions; of any RADIUS positions, some mask has none."""
    n = (1 << (RADIUS + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = covering_masks(list(range(BITS)))
#: For each first mask, the second family: over what it leaves free, with the first mask's own bits.
SECOND = [[m | s for s in covering_masks([b for b in range(BITS) if not m >> b & 1])] for m in MASKS]


def _forest(a: np.ndarray) -> tuple[list, list]:
    """A spanning forest of distinct fingerprints within RADIUS: breadth-first, each found once."""
    left, right, rest = [], [], a
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                left.extend([x] * len(found))
                right.extend(found)
    return left, right


def _bucket_links(batches):
    """Rows come sorted by (t, key); a bucket may span batches."""
    t = np.zeros(0, np.int32)
    key = fp = np.zeros(0, np.int64)

    def links(t, key, fp):
        edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True])))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= RADIUS]
        a, b = [fp[near]], [fp[near + 1]]
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            x, y = _forest(fp[s : s + n].view(np.uint64))
            a.append(np.array(x, np.uint64).view(np.int64))
            b.append(np.array(y, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        t, key, fp = (np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate((t, key, fp)))
        if not len(t):
            continue
        last = len(t) - int(np.argmax(((t != t[-1]) | (key != key[-1]))[::-1])) if (t[0] != t[-1] or key[0] != key[-1]) else 0
        if last:
            yield links(t[:last], key[:last], fp[:last])
        t, key, fp = t[last:], key[last:], fp[last:]
    if len(t):
        yield links(t, key, fp)


def _linked(probes: DataFrame) -> DataFrame:
    dealt = probes.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_bucket_links, "a long, b long")


def _tabled(fps: DataFrame, masks: list[int], base: int = 0) -> DataFrame:
    tables = F.explode(F.array(*(F.struct(F.lit(base + i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    return fps.select("fp", tables.alias("x")).select("x.t", "x.key", "fp")


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect what is within RADIUS, of distinct fingerprints `fp`."""
    probes = _tabled(fps, MASKS)
    hot = written(probes.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("t", "key"), "hot-buckets")
    n_hot = hot.count()
    if not n_hot:
        return _linked(probes)
    known = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    out = _linked(probes.join(known, ["t", "key"], "left_anti"))
    large = probes.join(known, ["t", "key"], "left_semi")
    second = [F.when(F.col("t") == i, F.array(*(F.struct(F.lit(len(MASKS) * (i + 1) + j).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for j, m in enumerate(ms)))) for i, ms in enumerate(SECOND)]
    return out.unionByName(_linked(large.select("fp", F.explode(F.coalesce(*second)).alias("x")).select("x.t", "x.key", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of each document."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(firsts.select("fp")))
    members = written(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "members")
    least = members.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id")).hint("rebalance")
    of_fp = written(members.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "components")
    return fps.join(of_fp, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op3 contract."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each component that `find` gives, that with the smallest id; all its columns stay.

    An id names a document: if one of its rows isn't a component's representative, all its rows go, and of rows that repeat an id
    and a text one stays. Rows with a null id can't be named and all stay."""
    found = written(find(docs, id_col, text_col), "near-duplicates")
    name = "_".join(["gone", *docs.columns])  # longer than any column of docs, so none clashes
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(kept.where(F.col(id_col).isNull()))
