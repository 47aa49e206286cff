"""Benchmark decontamination by winnowing.

Both sides keep, of every `WINDOW` consecutive k-gram hashes, the smallest (the rightmost of equals). Any shared span of
`K + WINDOW - 1` words holds a whole window on both sides, and both sides then keep the same k-gram from it, so a join of the
kept fingerprints meets every shared span of SPAN = K + WINDOW - 1 words. Each meeting is extended to the spans of SPAN words
around it; those that an item holds word for word are hits. Items under SPAN words are looked up whole (one hash for each length).

Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. A word that no item has can't be in a hit, so
documents are coded by the items' vocabulary and all hashing and winnowing run on integer arrays.

A benchmark of at most BLOCK_WORDS words is sent to the workers as one index, and hits come from one map over the documents. A larger
one stays in tables: of its fingerprints a bit filter of at most FILTER_BITS bits is sent, documents give the spans around the kept
fingerprints that pass it (again one map), and a join of these spans with the items' decides. Both ways give the same rows. Neither
what is sent nor what the driver holds grows with the documents or, beyond the bounds, with the benchmark.

Defined results: a text of any length is read whole; null, empty or wordless texts have no words and no hits; null, empty or wordless items never occur; repeated
documents each get a row; an item id on several rows counts once and hits if one of its texts does; null item ids count as
items and print as the empty string; other columns are ignored; an empty table of
documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import map_text, text_bytes, written

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Words of items that are sent to the workers as an index, about 250 bytes each there.
BLOCK_WORDS = 1 << 17
#: Bits of the filter that stands for a larger benchmark: 16 a fingerprint, up to this (16 MB).
FILTER_BITS = 1 << 27

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n].astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the hashes kept: the rightmost smallest of each window (of all, if there are fewer)."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, min(window, len(h)))
    at = w.shape[1] - 1 - np.argmin(w[:, ::-1], axis=1)
    return np.unique(at + np.arange(len(w)))


class ItemIndex:
    """Fingerprints of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k, self.window = span, k, span - k + 1
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.windows: dict[bytes, list[int]] = defaultdict(list)
        kept: set[int] = set()
        for item_id, text in items:
            if not (w := words(text)):
                continue
            c = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32)
            n = len(self.ids)
            self.ids.append(item_id)
            if len(c) < span:
                self.short[len(c)][c.tobytes()].append(n)
                continue
            h = gram_hashes(c, k)
            kept.update(h[winnow(h, self.window)].tolist())
            for p in range(len(c) - span + 1):
                self.windows[c[p : p + span].tobytes()].append(n)
        self.windows = {x: tuple(set(got)) for x, got in self.windows.items()}
        self.keys = np.array(sorted(kept), np.uint64)

    def hits(self, w: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are inside an occurrence (None: none), and the numbers of the items that occur."""
        codes = np.fromiter(map(self.vocab.get, w, [0] * len(w)), np.int32, len(w))
        known = codes != 0
        n, hit, items = len(codes), None, set()
        if not known.any():
            return None, items
        for size, texts in self.short.items():
            ok = np.lib.stride_tricks.sliding_window_view(known, size).all(axis=1) if n >= size else np.zeros(0, bool)
            for p in np.flatnonzero(ok):
                if got := texts.get(codes[p : p + size].tobytes()):
                    hit = np.zeros(n, bool) if hit is None else hit
                    hit[p : p + size] = True
                    items.update(got)
        if n < self.span or not len(self.keys):
            return hit, items
        # only runs of known words as long as a span can hold one
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a < self.span:
                continue
            run = codes[a:b]
            h = gram_hashes(run, self.k)
            at = winnow(h, self.window)
            at = at[np.isin(h[at], self.keys)]
            if not len(at):
                continue
            # each kept fingerprint that both sides have is extended to the spans around it
            starts = np.unique((at[:, None] - np.arange(self.window)).ravel())
            for p in starts[(starts >= 0) & (starts + self.span <= b - a)].tolist():
                if got := self.windows.get(run[p : p + self.span].tobytes()):
                    hit = np.zeros(n, bool) if hit is None else hit
                    hit[a + p : a + p + self.span] = True
                    items.update(got)
        return hit, items


def _intervals(hit: np.ndarray | None) -> list[int]:
    return [] if hit is None else np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def _scan(index: ItemIndex, id_col: str, text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, spans, items = [], [], []
        for text in text_bytes(batch.column(text_col)):
            w = words(text)
            hit, got = index.hits(w)
            n_words.append(len(w))
            spans.append(_intervals(hit))
            items.append(sorted({"" if index.ids[i] is None else str(index.ids[i]) for i in got}))
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "bounds", "items"])

    return part


def small_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> ItemIndex | None:
    """The benchmark's index if it has at most block_words words (two bytes each at least), else None."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    most = items.agg(F.sum(F.floor(F.coalesce(F.octet_length("t"), F.lit(0)) / 2) + 1)).first()[0] or 0
    return ItemIndex([(r.i, bytes(r.t or b"")) for r in items.collect()]) if most <= block_words else None


def hashed(w: list[bytes]) -> np.ndarray:
    """A code of each word that needs no vocabulary."""
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def short_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words, for items of n words."""
    return gram_hashes(codes, n) ^ np.uint64(n)


def _item_rows(batches):
    """Fingerprints and windows of the items."""
    for batch in batches:
        prints, windows, sizes = [], [], []
        for text in text_bytes(batch.column("text")):
            w = words(text)
            codes, n = hashed(w), min(len(w), SPAN)
            h = gram_hashes(codes, K)
            prints.append((h[winnow(h)] if n == SPAN else short_hashes(codes, n) if n else h[:0]).view(np.int64))
            windows.append(list({b" ".join(w[p : p + n]) for p in range(len(w) - n + 1)} if n else ()))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.binary()))], ["item", "size", "prints", "windows"])


class Filter:
    """Whether a fingerprint may be an item's: two bits of each are set."""

    def __init__(self, prints: DataFrame, most_bits: int):
        n = prints.count()
        self.bits = max(6, min((16 * n).bit_length(), most_bits.bit_length() - 1))
        at = F.explode(F.array(*(F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << self.bits) - 1)) for s in (0, 64 - self.bits))))
        cells = prints.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("on")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[cells.column("word").to_numpy()] = cells.column("on").to_numpy().view(np.uint64)

    def passes(self, h: np.ndarray) -> np.ndarray:
        def on(at: np.ndarray) -> np.ndarray:
            return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        return on(h & np.uint64((1 << self.bits) - 1)) & on(h >> np.uint64(64 - self.bits))


def _candidates(own: Filter, shorts: list[int], id_col: str, text_col: str):
    def spans(codes: np.ndarray):
        for n in shorts:
            for p in np.flatnonzero(own.passes(short_hashes(codes, n))).tolist():
                yield p, n
        if len(codes) >= SPAN:
            h = gram_hashes(codes, K)
            at = winnow(h)
            at = at[own.passes(h[at])]
            starts = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            for p in starts[(starts >= 0) & (starts + SPAN <= len(codes))].tolist():
                yield p, SPAN

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, found = [], []
        for text in text_bytes(batch.column(text_col)):
            w = words(text)
            n_words.append(len(w))
            found.append([{"start": p, "end": p + n, "window": b" ".join(w[p : p + n])} for p, n in spans(hashed(w))])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())]))
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("row_key"), pa.array(n_words, pa.int64()), pa.array(found, kind)], ["doc_id", "row_key", "n_words", "found"])

    return part


def _joined(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, row_key, n_words of each document, and doc_id, row_key, start, end, item of each window that occurs.

    Documents are known by their id and their text's hash; rows that repeat both have the same result."""
    items = written(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(_item_rows, "item string, size int, prints array<bigint>, windows array<binary>"), "benchmark-items")
    own = Filter(items.select(F.explode("prints").alias("h")).distinct(), FILTER_BITS)
    shorts = sorted(r["size"] for r in items.where(F.col("size").between(1, SPAN - 1)).select("size").distinct().collect())
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("row_key"))
    scanned = written(map_text(keyed, partial(_candidates, own, shorts, id_col, text_col), f"doc_id {kind}, row_key long, n_words long, found array<struct<start: bigint, end: bigint, window: binary>>", text_col), "candidates")
    spans = scanned.select("doc_id", "row_key", F.explode("found").alias("x")).select("doc_id", "row_key", "x.*")
    windows = items.select("item", F.explode("windows").alias("of_item")).distinct()
    return scanned.select("doc_id", "row_key", "n_words"), spans.join(windows, F.col("window") == F.col("of_item")).select("doc_id", "row_key", "start", "end", "item")


def _bounds(hits: DataFrame) -> DataFrame:
    """d, r (a document's id and key), bounds, items: its windows joined where they touch, in order."""
    own, keys = Window.partitionBy("doc_id", "row_key").orderBy("start", "end"), ("doc_id", "row_key")
    cut = hits.select(*keys, "start", "end").distinct().withColumn("before", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    runs = cut.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("bounds"))
    items = hits.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return items.join(one, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row_key"))).select("d", "r", F.flatten("bounds").alias("bounds"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, bounds (start, end, start, end ... of hit words), items (ids as sorted strings) of each document."""
    docs = docs.select(id_col, text_col)
    index = small_index(benchmark, block_words=block_words)
    if index is not None:
        schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, bounds array<bigint>, items array<string>"
        return map_text(docs, partial(_scan, index, id_col, text_col), schema, text_col)
    every, hits = _joined(docs, benchmark, id_col, text_col)
    both = every.join(_bounds(written(hits, "hits")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left")
    return both.select("doc_id", "n_words", *(F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c) for c in ("bounds", "items")))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op10 contract."""
    ends = F.aggregate("bounds", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["s"] + a["sign"] * x).alias("s"), (-a["sign"]).alias("sign")), lambda a: a["s"])
    return found.select("doc_id", "n_words", ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("bounds") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a hit; all their columns stay. A narrow filter, or for a large benchmark a join with what is hit."""
    index = small_index(benchmark, block_words=block_words)
    if index is None:
        hits = written(_joined(docs, benchmark, id_col, text_col)[1].select("doc_id", "row_key").distinct(), "hits")
        names = ["_".join([x, *docs.columns]) for x in ("id", "key")]  # longer than any column of docs, so none clashes
        gone = hits.toDF(*names)
        return docs.join(gone, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1])), "left_anti")

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([index.hits(words(t))[0] is None for t in text_bytes(batch.column(text_col))], pa.bool_()))

        return part

    return map_text(docs, make, docs.schema, text_col)
