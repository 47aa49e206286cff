"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and, beside it, MinHash bands for candidates, verified exactly.

A text is the set of its WORDS-word shingles (lower-cased A-Z, white space as in SimHash, hashed to 64 bits). Two texts are linked if
their sets' Jaccard similarity is LEAST or more. Candidates are sets whose SimHash fingerprints differ in 3 bits or fewer (`simhash.links`:
covering tables, no such pair is missed), and, since most pairs of similarity 0.8 differ in more, those of BANDS bands of ROWS minimums each:
a pair of similarity s meets in some band but for a probability of (1 - s^ROWS)^BANDS, which is 8e-6 at 0.8 and falls quickly above.

Equal sets collapse first. A bucket links its members to the smallest, so candidate links are as many as bucket entries at most, and
SimHash adds one link a fingerprint and table at most. Only texts that share a bucket have their sets sent, once for each block pair of their candidate component: a component is cut into blocks
of about BLOCK shingles and each two blocks meet in one task, which compares all pairs of whole sets and passes on a spanning forest. No bucket or
component is capped.

Defined results: a text under WORDS words has its whole sequence as its one shingle; null, empty and wordless texts have the empty set
and are copies of each other; repeated documents share a component; null ids take part but are never a component's id; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm import simhash
from tallyflow.llm.common import map_text, text_bytes, written
from tallyflow.llm.components import connected_components

WORDS, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 64, 8
#: Shingles of a block of a candidate component.
BLOCK = 1 << 18

_rng = np.random.default_rng(17)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order."""
    w = (text or b"").lower().split()
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= WORDS:
        return np.array([h(joined, SEED)] if w else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), (ends[WORDS - 1 :] - 1).tolist())], np.uint64))


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band; none of the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    x = (own >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        least = np.minimum(least, ((x[i : i + 256] ^ _XOR) * _MUL).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _sketches(id_col: str, text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in text_bytes(batch.column(text_col))]
        keys = np.array([key_of(s) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(keys), pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "key", "fp", "bands"])

    return part


def _sets(text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in text_bytes(batch.column(text_col))]
        keys = np.array([key_of(s) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "own"])

    return part


def forest(keys: np.ndarray, sets: list[np.ndarray]) -> tuple[list, list]:
    """A spanning forest of the sets that are similar: breadth-first, each found once."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    rest, left, right = np.ones(len(sets), bool), [], []
    num, den = LEAST
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front and rest.any():
            x = front.pop()
            own = ids[starts[x] : starts[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            found = np.flatnonzero(rest & (both * den >= num * (size + size[x] - both)))
            rest[found] = False
            front.extend(found.tolist())
            left.extend([keys[x]] * len(found))
            right.extend(keys[found].tolist())
    return left, right


def _verified(batches):
    """Rows come sorted by (root, i, j); a group may span batches."""

    def links(keys, sets):
        a, b = forest(np.array(keys, np.int64), sets) if len(keys) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    now, keys, sets = None, [], []
    for batch in batches:
        own = batch.column("own")
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "key")))):
            if row[:3] != now:
                yield links(keys, sets)
                now, keys, sets = row[:3], [], []
            keys.append(row[3])
            sets.append(own[i].values.to_numpy().copy())
    yield links(keys, sets)


def simhash_links(firsts: DataFrame) -> DataFrame:
    """key, least: links that connect the distinct sets (key, fp) whose fingerprints are within SimHash's radius."""
    of_fp = written(firsts.groupBy("fp").agg(F.min("key").alias("of")), "fingerprints")
    same = firsts.select("key", "fp").join(of_fp, "fp").where("key <> of").select("key", F.col("of").alias("least"))
    a, b = (of_fp.select(F.col("fp").alias(c), F.col("of").alias(n)) for c, n in (("a", "key"), ("b", "least")))
    return same.unionByName(simhash.links(of_fp.select("fp")).join(a, "a").join(b, "b").select("key", "least"))


def candidates(firsts: DataFrame) -> DataFrame:
    """key, root of the distinct sets (key, fp, bands) that SimHash links or that share a bucket, directly or by others."""
    probes = firsts.select("key", F.explode("bands").alias("band"))
    shared = probes.select("key", F.min("key").over(Window.partitionBy("band")).alias("least")).where("key <> least")
    links = simhash_links(firsts.where(F.size("bands") > 0)).unionByName(shared).distinct()  # the empty set is like no other
    roots = connected_components(links, "key", "least")
    return written(roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct()), "candidates")


def verified_links(docs: DataFrame, firsts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: links that connect the sets of similarity LEAST or more; firsts has key, first (an id), fp and bands."""
    of = candidates(firsts)
    ids = firsts.join(of, "key").select(F.col("first").alias("wanted")).distinct()
    texts = docs.select(id_col, text_col).join(ids, F.col(id_col).eqNullSafe(F.col("wanted")), "left_semi").select(F.col(text_col).cast("string").alias("text"))
    sets = written(map_text(texts, partial(_sets, "text"), "key long, own array<long>", "text").join(of, "key").dropDuplicates(["key"]), "sets")
    blocks = sets.groupBy(F.col("root").alias("r")).agg(F.ceil(F.sum(F.size("own")) / BLOCK).cast("int").alias("blocks"))
    dealt = sets.join(blocks, F.col("root") == F.col("r")).select("root", "key", "own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "key", "own")
    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = map_text(docs.select(id_col, text_col), partial(_sketches, id_col, text_col), f"doc_id {kind}, key long, fp long, bands array<long>", text_col)
    found = written(found, "sketches")
    firsts = written(found.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-sets")
    roots = connected_components(verified_links(docs, firsts, id_col, text_col))
    members = written(firsts.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root")), "members")
    least = members.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id")).hint("rebalance")
    of_key = written(members.join(least, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "component_id"), "components")
    return found.select("doc_id", "key").join(of_key, F.col("key") == F.col("k"), "left").select("doc_id", "component_id")
