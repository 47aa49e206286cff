"""Language-model scoring by prediction by partial matching (PPM).

A trie of byte contexts up to ORDER bytes holds how often each byte followed. A byte's probability is sought in the longest context seen;
a byte not seen there costs an escape (method C: distinct followers / (all + distinct followers)), and the next shorter context goes on
without the bytes that the longer ones have excluded; below order 0 the bytes left are equally likely. A document's score is the
log10 probability of its words, lower-cased (A-Z) and joined by single spaces, and of the end (byte 0xFF, in no UTF-8 text), each
after the bytes before it (ORDER times 0xFF before the first).

`pretrained`: the trie's counts come from all training documents, gathered in two aggregations: (ORDER + 1)-grams of bytes, and word
counts for the unigram base score. Exclusions depend on contexts alone, so each context stores what its parent's total and number
of followers are without its own followers, and scoring is table look-ups over arrays. `adaptive_code_length` is the
sequential form, which learns a text as it reads it.

What goes to every worker is bounded: of the trie, the contexts of at least a total so chosen that at most MAX_NODES n-grams remain (all,
while there are no more); of the words, those of at least a count so chosen that at most MAX_WORDS remain. A context that is sent has all
its followers, and the shorter contexts of its ending are sent too, so what it gives is exact. Bytes after other contexts are left open:
a text's distinct open n-grams are joined by shuffle to the table of all nodes, which stays in the shared folder, and scored exactly from
it. Other words' counts are joined likewise. A document brings each such word and n-gram once, with its number. One that few training
documents have, or none, may still be in very many that are only scored: both joins have exchanges of their own on both sides and no
aggregation by that key after them, so adaptive execution splits such a key's rows over tasks.

Defined results: a text of any length is counted and scored whole, in memory in proportion to it; a null text is empty (its one token is the end); with no training documents counts are 0 and bytes equally likely;
repeated documents count and are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import slices, text_bytes, written

ORDER = 5
END = 0xFF
MAX_NODES, MAX_WORDS = 3 << 19, 1 << 17
#: Bytes of text whose n-grams are counted at once, and scored at once.
SLICE, SCORED = 1 << 20, 1 << 18
#: Distinct words or n-grams that a task holds before it passes its counts on.
HELD = 1 << 19

_PAD = bytes([END]) * ORDER


def words(text: bytes | None) -> list[bytes]:
    """Words of the lower-cased text; white space is \\x20 and \\x09-\\x0D."""
    return (text or b"").lower().split()


def grams(texts: list[bytes]) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each byte and end of the texts, in order, as an integer, first byte highest."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (_PAD, t, b"\xff")) or b"\xff", np.uint8)
    key = np.zeros(max(len(raw) - ORDER, 0), np.uint64)
    for i in range(ORDER + 1):
        key = (key << np.uint64(8)) | raw[i : i + len(key)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    return key[at]


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts (or sums of n)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys))) if n is None else (np.add.reduceat(n, at) if len(at) else n[:0])


class Table:
    """Open-addressing hash table from distinct integers to their positions, which are all that its slots hold."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, h = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(left):
            free = self.at[h] < 0
            self.at[h[free]] = left[free]
            won = self.at[h] == left
            left, h = left[~won], (h[~won] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        h = self._hash(keys)
        out = self.at[h]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        h = h[left]
        while len(left):
            h = (h + 1) & ((1 << self.bits) - 1)
            at = self.at[h]
            out[left] = at
            go = (at >= 0) & (self.keys[at] != keys[left])
            left, h = left[go], h[go]
        return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts as 32-bit integers where these and 256 more fit."""
    return x.astype(np.int32) if x.max(initial=0) < (1 << 31) - 512 else x


@dataclass
class Level:
    """Contexts of one length: the bytes that followed, and what excluding them leaves of the next shorter context."""

    followers: Table
    count: np.ndarray
    contexts: Table
    total: np.ndarray
    distinct: np.ndarray
    parent_total: np.ndarray
    parent_distinct: np.ndarray


class Trie:
    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], whole: bool = True):
        """From n-grams and their counts, for n from 1 to ORDER + 1; an n-gram's ending must be an (n - 1)-gram.

        Contexts have all their followers. If not `whole`, there are contexts that it doesn't hold."""
        self.levels: list[Level] = []
        self.whole = whole
        for k, (keys, n) in enumerate(nodes):
            own, count = counted(keys.astype(np.uint64), n.astype(np.int64))
            contexts, total = counted(own >> np.uint64(8), count)
            _, distinct = counted(own >> np.uint64(8))
            parent_total, parent_distinct = total, distinct
            if k:
                low = self.levels[-1]
                in_parent = low.count[low.followers.find(own & np.uint64((1 << (8 * k)) - 1))].astype(np.int64)
                _, excluded = counted(own >> np.uint64(8), in_parent)
                parent = low.contexts.find(contexts & np.uint64((1 << (8 * (k - 1))) - 1))
                parent_total, parent_distinct = low.total[parent] - excluded, low.distinct[parent] - distinct
            self.levels.append(Level(Table(own), small(count), Table(contexts), small(total), distinct.astype(np.int16), small(parent_total), parent_distinct.astype(np.int16)))
        top = self.levels[-1]
        context = top.contexts.find(own >> np.uint64(8))
        #: Most bytes are found in their longest context: one look-up.
        self.direct = np.log10(top.count / (top.total + top.distinct)[context]) if len(own) else np.zeros(0)

    def log10(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the last byte of each (ORDER + 1)-gram after the others, and where it is left open (as 0)."""
        out = np.zeros(len(keys))
        found = self.levels[-1].followers.find(keys)
        hit = found >= 0
        out[hit] = self.direct[found[hit]]
        left, opened = np.flatnonzero(~hit), np.zeros(0, np.int64)
        if not self.whole:
            known = self.levels[-1].contexts.find(keys[left] >> np.uint64(8)) >= 0
            left, opened = left[known], left[~known]
        rest = np.full(len(left), -1, np.int64)  # the longer context whose followers are excluded; -1: none
        for k in range(ORDER, -1, -1):
            level, gram = self.levels[k], keys[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            found, context = level.followers.find(gram), level.contexts.find(gram >> np.uint64(8))
            here = context >= 0
            total, distinct = np.where(here, level.total[context], 0) if len(level.total) else np.zeros(len(left), np.int64), np.where(here, level.distinct[context], 0) if len(level.distinct) else np.zeros(len(left), np.int16)
            if k < ORDER:
                above, cut = self.levels[k + 1], rest >= 0
                total[cut], distinct[cut] = above.parent_total[rest[cut]], above.parent_distinct[rest[cut]]
            got = found >= 0
            out[left[got]] += np.log10(level.count[found[got]] / (total + distinct)[got])
            escape = ~got & here & (distinct > 0)
            out[left[escape]] += np.log10(distinct[escape] / (total + distinct)[escape])
            left, rest = left[~got], np.where(here, context, -1)[~got]
        if len(left):
            seen = int(self.levels[0].distinct[0]) if len(self.levels[0].distinct) else 0
            out[left] -= math.log10(max(256 - seen, 1))
        return out, opened

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """log10 probability of each text and its end, but for its open (ORDER + 1)-grams; these, and how often each occurs."""
        if not texts:
            return np.zeros(0), []
        keys = grams(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        value, opened = self.log10(keys)
        edge = np.searchsorted(opened, np.concatenate(([0], ends)))
        return np.add.reduceat(value, np.concatenate(([0], ends[:-1]))), [counted(keys[opened[a:b]]) for a, b in zip(edge[:-1], edge[1:])]

    def missing(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts of each (ORDER + 1)-gram, those not held: the n-gram, the size of the context's nodes, the context."""
        found = []
        for k, level in enumerate(self.levels):
            context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
            away = level.contexts.find(context) < 0
            found.append((keys[away], np.full(int(away.sum()), k + 1, np.int32), context[away]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def joined(self, keys: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of (ORDER + 1)-grams, given the nodes of all their contexts that aren't held here."""
        nodes = []
        for k, level in enumerate(self.levels):
            own, at = np.unique(gram[size == k + 1], return_index=True)
            context = np.unique((keys >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
            first, last = (np.searchsorted(level.followers.keys, (context + np.uint64(i)) << np.uint64(8)) for i in (0, 1))
            held = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(context) else first
            nodes.append((np.concatenate((own, level.followers.keys[held])), np.concatenate((n[size == k + 1][at], level.count[held]))))
        return Trie(nodes).log10(keys)[0]


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end by a trie that starts empty and learns each byte after it is coded."""
    trie: dict[bytes, Counter] = {}
    history, total = bytes([END]) * order, 0.0
    for byte in [*text, END]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            node = trie.get(history[len(history) - k :])
            if node is None:
                continue
            left = {s: c for s, c in node.items() if s not in excluded}
            whole, distinct = sum(left.values()), len(left)
            if byte in left:
                total += math.log10(left[byte] / (whole + distinct))
                break
            if distinct:
                total += math.log10(distinct / (whole + distinct))
            excluded |= left.keys()
        else:
            total -= math.log10(max(256 - len(excluded), 1))
        for k in range(order + 1):
            trie.setdefault(history[len(history) - k :], Counter())[byte] += 1
        history = (history + bytes([byte]))[-order:] if order else b""
    return total


def _word_counts(text_col: str):
    def run(batches):
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, text_col):
                for t in text_bytes(part.column(text_col)):
                    c.update(words(t))
                if len(c) > HELD:
                    yield out()
                    c.clear()
        if c:
            yield out()

    return run


def _gram_counts(text_col: str):
    def run(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                k, c = counted(grams([b" ".join(words(t)) for t in text_bytes(part.column(text_col))]))
                keys, n = counted(np.concatenate((keys, k)), np.concatenate((n, c)))
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["gram", "n"])
                    keys, n = keys[:0], n[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` rows reach, among 1 and the eighth powers of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    by = {r["b"]: r["count"] for r in counts.groupBy(step.alias("b")).count().collect()}
    total, least = 0, max(by, default=-1) + 1
    for b in sorted(by, reverse=True):
        total += by[b]
        if total > most:
            break
        least = b
    return 1 if least <= min(by, default=0) else math.ceil(2 ** (least / 8) - 1e-9)


@dataclass
class Model:
    trie: Trie
    #: size, gram, n, total, distinct: all n-grams, with the total and number of followers of their contexts; the trie has contexts of at least `least_total`.
    nodes: DataFrame
    least_total: int
    #: Words of at least `least` occurrences in training, with log10(count + 1).
    frequent: dict[bytes, float]
    least: int
    word_counts: DataFrame
    train_tokens: int
    vocabulary: int
    ends: int


def train(docs: DataFrame, is_training: Column, text_col: str = "text") -> Model:
    """Counts of all the documents for which is_training holds."""
    texts = docs.where(is_training).select(F.col(text_col).cast("string").alias("text"))
    word_counts = written(texts.mapInArrow(_word_counts("text"), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    gram_counts = written(texts.mapInArrow(_gram_counts("text"), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    ends = texts.count()
    least = least_count(word_counts, MAX_WORDS)
    some = word_counts.where(F.col("n") >= least).toArrow()
    frequent = dict(zip((bytes(w) for w in some.column("word").to_pylist()), np.log10(some.column("n").to_numpy() + 1.0).tolist()))
    # shorter n-grams are the endings of the longest: every byte has a whole context, thanks to the padding
    ending = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
    sizes = F.explode(F.array(*(F.struct(F.lit(k).alias("size"), ending(k).alias("gram")) for k in range(1, ORDER + 2))))
    all_nodes = gram_counts.select("n", sizes.alias("x")).groupBy("x.size", "x.gram").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("size", F.shiftright("gram", 8))  # at most 256 rows each
    all_nodes = written(all_nodes.select("size", "gram", "n", F.sum("n").over(same).alias("total"), F.count("*").over(same).alias("distinct")), "trie-nodes")
    least_total = least_count(all_nodes.select(F.col("total").alias("n")), MAX_NODES)
    nodes = all_nodes.where(F.col("total") >= least_total).select("size", "gram", "n").toArrow()
    size_of, gram_of, n_of = (nodes.column(c).to_numpy() for c in ("size", "gram", "n"))
    size = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    trie = Trie([(gram_of[size_of == k], n_of[size_of == k]) for k in range(1, ORDER + 2)], least_total == 1)
    return Model(trie, all_nodes, least_total, frequent, least, word_counts, size["n"] + ends, size["v"] + (ends > 0), ends)


def _score(tables, end: float, id_col: str, text_col: str):
    def run(batches):
        trie, frequent = tables.value
        get = frequent.get
        for batch in batches:
            for part in slices(batch, text_col, SCORED):
                split = [words(t) for t in text_bytes(part.column(text_col))]
                known, base, rare = [], [], []
                for w in split:
                    values = list(map(get, w))
                    others = Counter(x for x, v in zip(w, values) if v is None)
                    known.append(len(w) - others.total())
                    base.append(math.fsum(v for v in values if v is not None) + end)
                    rare.append(others)
                score, opened = trie.score([b" ".join(w) for w in split])
                arrays = [part.column(id_col), pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
                arrays += [pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64()))]
                arrays += [pa.array([g.astype(np.int64) for g, _ in opened], pa.list_(pa.int64())), pa.array([n for _, n in opened], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_frequent", "frequent_part", "score", "rare", "rare_times", "opened", "times"])

    return run


def _missing(tables):
    def run(batches):
        trie = tables.value[0]
        for batch in batches:
            gram, size, context = trie.missing(batch.column("gram").to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(size), pa.array(context.astype(np.int64))], ["gram", "size", "context"])

    return run


def _joined(tables):
    def run(batches):
        trie = tables.value[0]
        for batch in batches:
            own = batch.column("nodes").flatten()
            size, gram, n = (own.field(c).to_numpy(zero_copy_only=False) for c in ("size", "node", "n"))
            value = trie.joined(batch.column("gram").to_numpy().astype(np.uint64), size, gram.astype(np.uint64), n)
            yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(value)], ["gram", "value"])

    return run


def gram_values(opened: DataFrame, model: Model, tables) -> DataFrame:
    """gram, value: log10 probabilities of the distinct (ORDER + 1)-grams `gram`, from all nodes."""
    longest = model.nodes.where(F.col("size") == ORDER + 1).select(F.col("gram").alias("g"), "n", "total", "distinct")
    every = written(opened.join(longest, F.col("gram") == F.col("g"), "left"), "open-grams")
    seen = every.where(F.col("n").isNotNull()).select("gram", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("value"))
    unseen = every.where(F.col("n").isNull()).select("gram")
    asked = unseen.mapInArrow(_missing(tables), "gram long, size int, context long")
    rest = model.nodes.where(F.col("total") < model.least_total).select(F.col("size").alias("s"), F.shiftright("gram", 8).alias("c"), F.struct("size", F.col("gram").alias("node"), "n").alias("x"))
    nodes = asked.join(rest, (F.col("size") == F.col("s")) & (F.col("context") == F.col("c"))).select("gram", "x")
    none = unseen.select("gram", F.lit(None).cast(rest.schema["x"].dataType).alias("x"))
    both = nodes.unionByName(none).groupBy("gram").agg(F.collect_list("x").alias("nodes"))  # nulls are left out
    return seen.unionByName(both.mapInArrow(_joined(tables), "gram long, value double"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    docs = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    tables = spark.sparkContext.broadcast((model.trie, model.frequent))
    end = math.log10(model.ends + 1)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_frequent long, frequent_part double, score double, rare array<binary>, rare_times array<long>, opened array<long>, times array<long>"
    scored = docs.mapInArrow(_score(tables, end, id_col, "text"), schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # a table: rows keep their numbers
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_times").alias("times"))
    counts = model.word_counts.where(F.col("n") < model.least).select(F.col("word").alias("w"), "n")
    parts = rare.join(counts, F.col("word") == F.col("w")).groupBy(F.col("row").alias("r")).agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_part"))
    floor = math.log10(model.train_tokens + model.vocabulary + 1)
    both = scored.drop("rare", "rare_times", "opened", "times").join(parts, F.col("row") == F.col("r"), "left")
    if model.trie.whole:
        both = both.withColumn("open_part", F.lit(0.0))
    else:
        cells = scored.where(F.size("opened") > 0).select("row", F.explode(F.arrays_zip("opened", "times")).alias("x")).select(F.col("row").alias("o"), F.col("x.opened").alias("gram"), F.col("x.times").alias("times"))
        values = written(gram_values(cells.select("gram").distinct(), model, tables), "gram-values").withColumnRenamed("gram", "g")
        opened = cells.join(values, F.col("gram") == F.col("g")).groupBy("o").agg(F.sum(F.col("times") * F.col("value")).alias("open_part"))
        both = both.join(opened, F.col("row") == F.col("o"), "left")
    tables.destroy()  # what needs it is in tables: executors don't keep it
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(model.ends > 0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("frequent_part") + F.coalesce("rare_part", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("open_part", F.lit(0.0))).alias("score"),
    )
