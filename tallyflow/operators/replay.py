"""Scores by replaying the stream in chunks: for models whose counters fit in a worker.

As rows, an email's n-grams times the counters of every configuration are many times its text. Counters are additive, so here the
text alone is dealt out, in chunks of whole slots: each chunk's counters are summed (`_counted`), a chunk's state is what the mode knows
when its first slot is scored (`_known`: for test-then-train the sum of all chunks before), and each chunk is scored from its state,
slot by slot, learning each slot after it was scored (`_replayed`). All n-grams count; results are those of the joins in `models`.
A slot larger than a chunk is scored in parts, which learn nothing of each other. States are blocks of counters, so none meets in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import hashing
from tallyflow.sources.shared import discard, written

try:
    import xxhash
except ImportError:
    xxhash = None

#: Counters of all tables (16 bytes each, and 16 for their logarithms) that a worker holds at most.
CELLS = 1 << 18
#: Counters in a row of a state.
BLOCK = 1 << 10
#: Emails in a chunk at least; more in long streams, so that states grow with the root of the stream's length.
CHUNK = 1 << 10
#: Characters of the n-grams, and number of them, that a worker's tables keep before they begin anew.
KEPT_CHARS, KEPT_GRAMS = 12 << 20, 1 << 18
#: Groups whose counters a task sums at once.
OPEN = 16
#: Texts that are Python strings at once, and whose n-grams are.
ROWS, AHEAD = 256, 32


@dataclass
class Layout:
    """Where the counters of configurations are in one vector for each class.

    tables: (classifier, ngram, log_buckets, depth, first counter), deepest first, so that those with a row i of a sketch are a prefix.
    After the counters come the number of emails and, for each ngram, that of n-grams."""

    configs: list
    tables: list = field(init=False)
    ngrams: list = field(init=False)
    size: int = field(init=False)

    def __post_init__(self):
        depth: dict = {}
        for c in self.configs:
            key = c.classifier, c.ngram, c.log_buckets
            depth[key] = max(depth.get(key, 1), c.num_hashes)
        self.tables, at = [], 0
        for (classifier, n, b), d in sorted(depth.items(), key=lambda x: (-x[1], x[0])):
            self.tables.append((classifier, n, b, d, at))
            at += d << b
        self.counters = at
        self.ngrams = sorted({c.ngram for c in self.configs})
        self.size = -(-(at + 1 + len(self.ngrams)) // BLOCK) * BLOCK
        self.totals = np.arange(at, at + 1 + len(self.ngrams))

    def level(self, k: int) -> tuple[list, list, list]:
        """Of k-grams: (table, row of its sketch) of each column, the columns of each row as a slice, and (depth, which columns of its row,
        which configurations) for each depth that configurations have."""
        own = [(j, t) for j, t in enumerate(self.tables) if t[1] >= k]
        columns, rows, wanted = [], [], []
        for i in range(max((t[3] for _, t in own), default=0)):
            here = [t for _, t in own if t[3] > i]
            rows.append(slice(len(columns), len(columns) + len(here)))
            columns += [(t, i) for t in here]
            at = [(p, q) for p, t in enumerate(here) for q, c in enumerate(self.configs) if (c.classifier, c.ngram, c.log_buckets) == t[:3] and max(1, c.num_hashes) == i + 1]
            wanted.append((i, [p for p, _ in at], [q for _, q in at]))
        return columns, rows, [w for w in wanted if w[1]]


def fits(configs: list, hash_mode: str) -> bool:
    return sum(max(1, c.num_hashes) << c.log_buckets for c in configs) <= 4 * CELLS and Layout(configs).size <= CELLS and (hash_mode != "xxhash" or xxhash is not None)


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Grams:
    """N-grams of texts as numbers, and the counters of each number. A k-gram is the number of its first k - 1 tokens, the separator
    and the number of its last token."""

    def __init__(self, layout: Layout, hash_mode: str):
        self.layout, self.mode, self.n = layout, hash_mode, layout.ngrams[-1]
        self.levels = [layout.level(k) for k in range(1, self.n + 1)]
        self.depth = max((t[3] for t in layout.tables if t[0] == "CM"), default=0)
        self.has_fh = any(t[0] == "FH" for t in layout.tables)
        self.seeds = [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in range(self.depth)] if hash_mode == "xxhash" else []
        self.clear()

    def clear(self) -> None:
        self.numbers = [_Numbers() for _ in self.levels]
        self.names: list[list[str]] = [[] for _ in self.levels]
        self.cells = [np.empty((1024, len(c)), np.int32) for c, *_ in self.levels]
        self.chars = 0

    def full(self) -> bool:
        return self.chars > KEPT_CHARS or any(len(x) > KEPT_GRAMS for x in self.numbers)

    def _hashes(self, names: list[str], rows: list[int]) -> list[np.ndarray]:
        """Of each row; row -1 is the hash for feature hashing."""
        if self.mode == "md5":
            return list(hashing.md5_first(names, [b"" if i < 0 else b"%d:" % i for i in rows]))
        keys = [x.encode() for x in names]
        if self.mode == "murmur":
            return [hashing.murmur(keys, hashing.FEATURE_SEED if i < 0 else hashing.row_seed(i)) for i in rows]
        return [np.fromiter((xxhash.xxh64_intdigest(x, 42 if i < 0 else self.seeds[i]) for x in keys), np.uint64, len(keys)).view(np.int64) for i in rows]

    def learn(self) -> None:
        """The counters of the n-grams that came since: hashed together, since hashing few at once is dear."""
        for k, own in enumerate(self.numbers):
            if own.new:
                new, own.new = own.new, []
                if k:
                    before, last = self.names[k - 1], self.names[0]
                    new = [before[x >> 32] + ("\n" if x & 1 else " ") + last[(x & 0xFFFFFFFF) >> 1] for x in new]
                self._learn(k, new)

    def _learn(self, k: int, names: list[str]) -> None:
        """The counters of new k-grams (from 0)."""
        first, columns = len(self.numbers[k]) - len(names), self.levels[k][0]
        if len(self.numbers[k]) > len(self.cells[k]):
            grown = np.empty((2 * len(self.numbers[k]), len(columns)), np.int32)
            grown[:first] = self.cells[k][:first]
            self.cells[k] = grown
        wanted = sorted({-1 if t[0] == "FH" else i for t, i in columns})
        made = dict(zip(wanted, self._hashes(names, wanted)))
        for j, ((classifier, _, b, _, at), i) in enumerate(columns):
            row = -1 if classifier == "FH" else i
            self.cells[k][first : first + len(names), j] = (made[row] & ((1 << b) - 1)) + (at + (i << b))
        self.chars += sum(map(len, names))
        if k + 1 < self.n:
            self.names[k] += names

    def of(self, body: str | None, distinct: bool) -> tuple[int, list]:
        """The number of tokens, and for each k the numbers of its k-grams with how often each is there (`distinct`), or of each one.
        Their counters are there after `learn`."""
        if not body:
            return 0, []
        inner, seps = body[:-1], None
        if "\n" in inner:
            parts = inner.replace("\n", "\n ").split(" ")
            seps = np.fromiter((p[-1:] == "\n" for p in parts), np.int64, len(parts))
            parts = [p[:-1] if p[-1:] == "\n" else p for p in parts]
        else:
            parts = inner.split(" ")
        own = self.numbers[0]
        words = np.fromiter(map(own.__getitem__, parts), np.int64, len(parts))
        out, now = [np.unique(words, return_counts=True) if distinct else (words, None)], words
        for k in range(1, min(self.n, len(parts))):
            keys = (now[:-1] << 32) | (words[k:] << 1)
            if seps is not None:
                keys |= seps[k - 1 : -1]
            more = k + 1 < self.n
            if distinct:
                keys, *where, tf = np.unique(keys, return_inverse=more, return_counts=True)
            own = self.numbers[k]
            ids = np.fromiter(map(own.__getitem__, keys.tolist()), np.int64, len(keys))
            out.append((ids, tf) if distinct else (ids, None))
            now = ids[where[0]] if distinct and more else ids
        return len(parts), out


def _totals(words: int, ngrams: list[int]) -> np.ndarray:
    """1, and the number of 1..n-grams for each n."""
    return np.array([1, *((m := min(n, words)) * words - m * (m - 1) // 2 for n in ngrams)], np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    column = batch.column("body")
    for at in range(0, batch.num_rows, ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def _ahead(grams: _Grams, rows) -> Iterator[tuple]:
    """rows with the text, their last field, as its number of tokens and (counters, how often) of its k-grams for each k.

    Some texts are taken at once, so that their n-grams are hashed together."""
    rows = iter(rows)
    while held := list(islice(rows, AHEAD)):
        if grams.full():
            grams.clear()
        found = [grams.of(r[-1], True) for r in held]
        grams.learn()
        for r, (words, of) in zip(held, found):
            yield *r[:-1], (words, [(grams.cells[k][ids], tf) for k, (ids, tf) in enumerate(of)])


def _counted(layout: Layout, hash_mode: str):
    """g, spam, trains, body to block, g, s, h: counters of the emails that train, of each group; some in several rows."""

    def run(batches):
        grams = _Grams(layout, hash_mode)
        sums: dict[int, np.ndarray] = {}
        seen: dict = {}  # group and class: how often each n-gram, as far as it isn't in sums

        def settle():
            grams.learn()
            for (g, spam), counts in seen.items():
                for k, of in enumerate(counts):
                    ids = np.concatenate(of) if of else np.empty(0, np.int64)
                    tf = np.bincount(ids)
                    at = np.flatnonzero(tf)
                    cells = grams.cells[k][at]
                    sums[g][spam] += np.bincount(cells.ravel(), np.repeat(tf[at], cells.shape[1]), layout.size).astype(np.int64)
            seen.clear()

        def rows():
            settle()
            at = [(b, g) for g in sums for b in range(layout.size // BLOCK)]
            cut = lambda spam: pa.array([sums[g][spam, b * BLOCK : (b + 1) * BLOCK].tobytes() for b, g in at], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([b for b, _ in at], pa.int32()), pa.array([g for _, g in at], pa.int64()), cut(1), cut(0)], ["block", "g", "s", "h"])
            sums.clear()
            return out

        held = 0
        for batch in batches:
            of = zip(batch.column("g").to_pylist(), batch.column("spam").to_pylist(), batch.column("trains").to_pylist(), _texts(batch))
            for g, spam, trains, body in of:
                if g not in sums:
                    if len(sums) >= OPEN:
                        yield rows()
                        held = 0
                    sums[g] = np.zeros((2, layout.size), np.int64)
                if not trains or spam is None:
                    continue
                if grams.full() or held > 1 << 21:
                    settle()
                    held = 0
                    if grams.full():
                        grams.clear()
                words, found = grams.of(body, False)
                counts = seen.setdefault((g, int(spam)), [[] for _ in grams.levels])
                for k, (ids, _) in enumerate(found):
                    counts[k].append(ids)
                    held += len(ids)
                sums[g][int(spam), layout.totals] += _totals(words, layout.ngrams)
        if sums:
            yield rows()

    return run


def _known(layout: Layout, mode: str, base: tuple[np.ndarray, np.ndarray] | None, whole: bool = False):
    """block, g, s, h, sorted by block and group, to what the mode knows of each block when it scores the group; if `whole`, s and h go on
    with the block's sums of all groups."""

    def run(batches):
        block = group = None
        known = own = total = None
        groups: dict[int, np.ndarray] = {}

        def start(b):
            out = np.zeros((2, BLOCK), np.int64)
            if base is not None:
                for i in (0, 1):  # rows are of spam, then ham
                    out[i] += base[1 - i][b * BLOCK : (b + 1) * BLOCK]
            return out

        def row(b, g, x):
            return b, g, x[0].tobytes(), x[1].tobytes()

        def fold_rows():
            for g, x in groups.items():
                yield row(block, g, np.concatenate((total - x, total), axis=1) if whole else total - x if mode == "folds" else x)
            groups.clear()

        def made(rows):
            names, types = ["block", "g", "s", "h"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            out = []
            for b, g, s, h in zip(*(batch.column(c).to_pylist() for c in ("block", "g", "s", "h"))):
                x = np.stack([np.frombuffer(s, np.int64), np.frombuffer(h, np.int64)])
                if b != block:
                    out += fold_rows()
                    block, group, known, own, total = b, None, start(b), np.zeros((2, BLOCK), np.int64), np.zeros((2, BLOCK), np.int64)
                if mode == "prequential":
                    if g != group:
                        known, own, group = known + own, np.zeros((2, BLOCK), np.int64), g
                        out.append(row(b, g, known))
                    own += x
                else:
                    total += x
                    groups[g] = groups[g] + x if g in groups else x
            if out:
                yield made(out)
        if last := list(fold_rows()):
            yield made(last)

    return run


def _add_ratios(ll: np.ndarray, level: tuple[list, list, list], tf: np.ndarray, ls: np.ndarray, lh: np.ndarray) -> None:
    """Adds the log ratios of an email's k-grams, by each layer's logarithms of their counters, to its row of each layer."""
    _, rows, wanted = level
    now = None
    for i, p, q in wanted:
        for r in range(0 if now is None else now + 1, i + 1):
            m = rows[r].stop - rows[r].start
            if r == 0:
                cs, ch = ls[..., rows[0]], lh[..., rows[0]]
            else:
                cs, ch = np.minimum(cs[..., :m], ls[..., rows[r]]), np.minimum(ch[..., :m], lh[..., rows[r]])
        now = i
        ll[:, q] += (tf @ (ch - cs))[:, p]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _replayed(layout: Layout, hash_mode: str, learns: bool, out_schema: pa.Schema, layers: int = 1):
    """States (kind 0) and emails (kind 1), sorted by chunk, kind, slot and position, to what each email's score is made of.

    A state may have several layers, one after the other: a score of each is taken of an email's n-grams. Only the first learns."""

    def run(batches):
        grams = _Grams(layout, hash_mode)
        counts, logs = (np.zeros((2 * layers, layout.size), t) for t in (np.int64, np.float64))  # of ham and spam for each layer
        added = np.zeros((2, layout.size), np.int64)
        n_configs, n_totals = len(layout.configs), len(layout.totals)
        touched: list[list[np.ndarray]] = [[], []]
        chunk = slot = None
        fresh = False

        def learn():
            for spam, of in enumerate(touched):
                if of:
                    at = np.concatenate(of)
                    new = counts[spam][at] + added[spam][at]
                    counts[spam][at] = new
                    logs[spam][at] = np.log(new + 1)
                    added[spam][at] = 0
                    of.clear()

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            meta = zip(batch.column("g").to_pylist(), batch.column("part").to_pylist(), kinds.tolist(), batch.column("block").to_pylist(), batch.column("s").to_pylist(), batch.column("h").to_pylist(), batch.column("slot").to_pylist(), batch.column("spam").to_pylist(), batch.column("trains").to_pylist(), _texts(batch))
            n = int(kinds.sum())
            ll = np.zeros((n, layers * n_configs))
            known, sizes = np.zeros((2, n, layers * n_totals), np.int64), np.zeros(n, np.int64)
            j = 0
            for g, part, kind, b, s, h, at_slot, spam, trains, found in _ahead(grams, meta):
                if (g, part) != chunk:
                    for of in touched:
                        of.clear()
                    added[:] = 0
                    counts[:] = 0
                    chunk, slot, fresh = (g, part), at_slot, True
                if not kind:
                    counts[1::2, b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(s, np.int64).reshape(layers, BLOCK)
                    counts[::2, b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(h, np.int64).reshape(layers, BLOCK)
                    continue
                if fresh:
                    np.log(counts + 1, out=logs)
                    fresh, slot = False, at_slot
                if learns and at_slot != slot:
                    learn()
                    slot = at_slot
                sizes[j], found = found
                into = added[int(spam)] if learns and trains and spam is not None else None
                for k, (ids, tf) in enumerate(found):
                    cells = ids.astype(np.intp)
                    _add_ratios(ll[j].reshape(layers, n_configs), grams.levels[k], tf, logs[1::2, cells], logs[::2, cells])
                    if into is not None:
                        flat = cells.ravel()
                        np.add.at(into, flat, np.repeat(tf, cells.shape[1]))
                        touched[int(spam)].append(flat)
                known[0, j], known[1, j] = counts[1::2, layout.totals].ravel(), counts[::2, layout.totals].ravel()
                if into is not None:
                    into[layout.totals] += _totals(int(sizes[j]), layout.ngrams)
                    touched[int(spam)].append(layout.totals)
                    if sum(map(len, touched[int(spam)])) > 4 * layout.size:
                        touched[int(spam)][:] = [np.flatnonzero(into)]
                j += 1
            if n:
                own = batch.filter(pa.array(kinds == 1))
                made = [own.column(c) for c in out_schema.names[:4]] + [pa.array(sizes), _lists(ll), _lists(known[0]), _lists(known[1])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, out_schema)], schema=out_schema)

    return run


def in_order(emails: DataFrame) -> DataFrame:
    """emails, written so that a task that reads them meets neighbours in the stream: for several scores of one stream (`stored`)."""
    n = int(emails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(emails.withColumn("_at", F.floor(F.col("seq") / CHUNK)).repartition(n, "_at").sortWithinPartitions("seq").drop("_at"), "stream")


def parts(emails: DataFrame, layout: Layout, mode: str, hash_mode: str, base: tuple[np.ndarray, np.ndarray] | None = None, stored: bool = False, whole: bool = False) -> DataFrame:
    """doc_id, seq, spam, slot, words, ll (for each configuration), s and h (what is known of the number of emails and of n-grams for each
    ngram). base: counters of ham and of spam from before the stream. emails: doc_id, seq, spam, slot (no nulls), trains, body. The emails are read twice, so they are written once, unless `stored`.
    `whole`, with mode "folds": ll, s and h go on with those by all emails that train, as mode "in_sample" has them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = emails.sparkSession
    row = emails.agg(F.count("*"), F.max("slot"), F.countDistinct("slot") if mode in ("folds", "in_sample") else F.lit(None)).first()
    count, span = row[0], max(CHUNK, isqrt(row[0]))
    if mode == "split":
        g, many = F.lit(0).cast("long"), -(-count // span)
    elif mode == "prequential":
        slots = (row[1] or 0) + 2
        each = max(1, span * slots // max(count, 1))
        g, many = F.floor((F.col("slot") + 1) / each).cast("long"), 1 if each > 1 else -(-count // (span * slots))
    else:
        g, many = F.col("slot") + 1, -(-count // (span * max(row[2], 1)))
    many, n = max(1, many), int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["doc_id", "seq", "spam", "slot"]
    given = emails.select(*columns, "trains", "body")
    dealt = given.withColumns({"g": g, "part": F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int")})
    table = dealt if stored else written(dealt.repartition(n, "g", "part").sortWithinPartitions("g", "part"), "chunks")
    sums = written(table.select("g", "spam", "trains", "body").mapInArrow(_counted(layout, hash_mode), "block int, g bigint, s binary, h binary"), "chunk-counters")
    states = sums.repartition(n, "block").sortWithinPartitions("block", "g").mapInArrow(_known(layout, mode, base, whole), "block int, g bigint, s binary, h binary")
    both = table if mode != "split" else table.where(~F.col("trains"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in given.schema}
    state_rows = states.select(*(c.alias(k) for k, c in blank.items()), "g", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part"), F.lit(0).alias("kind"), "block", "s", "h")
    email_rows = both.select(*given.columns, "g", "part", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("s"), F.lit(None).cast("binary").alias("h"))
    sorted_rows = state_rows.unionByName(email_rows).repartition(n, "g", "part").sortWithinPartitions("g", "part", "kind", "slot", "seq")
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", words bigint, ll array<double>, s array<bigint>, h array<bigint>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    out = written(sorted_rows.mapInArrow(_replayed(layout, hash_mode, mode == "prequential", arrow, 2 if whole else 1), schema), "replayed")
    for made in (sums, *([] if stored else [table])):
        discard(made)
    return out


def _windowed(layout: Layout, hash_mode: str, windows: list[int], span: int, out_schema: pa.Schema):
    """States (kind 0) and emails (kind 1), sorted by chunk, kind and position, to what each email's scores by each window size are made of.

    One sum goes on email by email; a layer takes it over where a window of its size begins. Emails from before the chunk only train."""

    def run(batches):
        grams, layers, n_totals = _Grams(layout, hash_mode), len(windows), len(layout.totals)
        total, logs = np.zeros((2, layout.size), np.int64), np.zeros((2, layers, layout.size))  # of ham and spam
        seen = np.zeros((2, layers, n_totals), np.int64)
        chunk = slots = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("g", "kind", "block", "s", "h", "seq", "spam", "trains"))
            own = np.flatnonzero((batch.column("kind").to_numpy() == 1) & (batch.column("seq").fill_null(-1).to_numpy() >= batch.column("g").to_numpy() * span))
            n = len(own)
            ll, known, sizes = np.zeros((n, layers, len(layout.configs))), np.zeros((2, n, layers * n_totals), np.int64), np.zeros(n, np.int64)
            j = 0
            for g, kind, b, s, h, seq, spam, trains, (words, found) in _ahead(grams, zip(*columns, _texts(batch))):
                if g != chunk:
                    total[:], chunk, slots = 0, g, [None] * layers
                if not kind:
                    total[1, b * BLOCK : (b + 1) * BLOCK], total[0, b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(s, np.int64), np.frombuffer(h, np.int64)
                    continue
                if new := [i for i, w in enumerate(windows) if seq // w != slots[i]]:
                    logs[:, new] = np.log(total + 1)[:, None]
                    seen[:, new] = total[:, None, layout.totals]
                    slots = [seq // w for w in windows]
                learns = trains and spam is not None
                for k, (ids, tf) in enumerate(found):
                    cells = ids.astype(np.intp)
                    if seq >= g * span:
                        _add_ratios(ll[j], grams.levels[k], tf, logs[1][:, cells], logs[0][:, cells])
                    if learns:
                        np.add.at(total[int(spam)], cells.ravel(), np.repeat(tf, cells.shape[1]))
                if learns:
                    total[int(spam), layout.totals] += _totals(words, layout.ngrams)
                if seq >= g * span:
                    known[0, j], known[1, j], sizes[j] = seen[1].ravel(), seen[0].ravel(), words
                    j += 1
            if n:
                rows = batch.take(pa.array(own))
                made = [rows.column(c) for c in out_schema.names[:3]] + [pa.array(sizes), _lists(ll.reshape(n, -1)), _lists(known[0]), _lists(known[1])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, out_schema)], schema=out_schema)

    return run


def windowed(emails: DataFrame, layout: Layout, windows: list[int], hash_mode: str) -> DataFrame | None:
    """doc_id, seq, spam, words, and ll, s and h as in `parts` for each window size one after the other, test-then-train; nothing if seq
    isn't 0, 1, 2, ... without gaps. emails: doc_id, seq, spam, body, as `in_order` gives them; all train.

    The texts are dealt once for all sizes. A chunk gets the emails before it from where the longest window that reaches into it began,
    and the sums of those before these."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = emails.sparkSession
    count, least, most, places = emails.agg(F.count("*"), F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
    if not count or (least, most, places) != (0, count - 1, count):
        return None
    span, n = max(CHUNK, isqrt(count), 2 * max(windows)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.floor(F.col("seq") / span).cast("long")
    before = F.least(*(F.floor(((chunk + 1) * span - 1) / w) * w for w in windows), (chunk + 1) * span - 1)  # at least one, so that there is a group
    given = emails.select("doc_id", "seq", "spam", F.lit(True).alias("trains"), "body").withColumns({"chunk": chunk, "late": F.col("seq") >= before})
    groups = given.select((2 * F.col("chunk") + F.col("late").cast("long")).alias("g"), "spam", "trains", "body")
    sums = written(groups.mapInArrow(_counted(layout, hash_mode), "block int, g bigint, s binary, h binary"), "chunk-counters")
    states = sums.repartition(n, "block").sortWithinPartitions("block", "g").mapInArrow(_known(layout, "prequential", None), "block int, g bigint, s binary, h binary").where("g % 2 = 1")
    names = ["doc_id", "seq", "spam", "trains", "body"]
    blank = (F.lit(None).cast(given.schema[c].dataType).alias(c) for c in names)
    state_rows = states.select(*blank, ((F.col("g") + 1) / 2).cast("long").alias("g"), F.lit(0).alias("kind"), "block", "s", "h")
    twice = F.explode(F.when(F.col("late") & (F.col("chunk") < most // span), F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk")))
    email_rows = given.select(*names, twice.alias("g"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("s"), F.lit(None).cast("binary").alias("h"))
    sorted_rows = state_rows.unionByName(email_rows).repartition(n, "g").sortWithinPartitions("g", "kind", "seq")
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in names[:3]) + ", words bigint, ll array<double>, s array<bigint>, h array<bigint>"
    out = written(sorted_rows.mapInArrow(_windowed(layout, hash_mode, windows, span, to_arrow_schema(_parse_datatype_string(schema))), schema), "replayed")
    discard(sums)
    return out


def counted(emails: DataFrame, layout: Layout, hash_mode: str) -> tuple[np.ndarray, np.ndarray]:
    """The counters of all emails (spam, body) that ham and spam have: one vector each, of at most CELLS numbers."""
    sums = emails.select(F.lit(0).cast("long").alias("g"), "spam", F.lit(True).alias("trains"), "body").mapInArrow(_counted(layout, hash_mode), "block int, g bigint, s binary, h binary")
    n = int(emails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((2, layout.size), np.int64)
    for r in sums.repartition(n, "block").sortWithinPartitions("block", "g").mapInArrow(_known(layout, "split", None), "block int, g bigint, s binary, h binary").collect():
        out[1, r.block * BLOCK : (r.block + 1) * BLOCK], out[0, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.s, np.int64), np.frombuffer(r.h, np.int64)
    return out[0], out[1]
