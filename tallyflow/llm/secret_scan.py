"""Secret scans with multipart credential linking.

Strong kinds (assign, access, hex) are reported by themselves. Weak parts are not: an access identifier (`AKIA`/`ASIA` and the
like with 16 to 24 characters, or an e-mail or user name assigned to a login word), an unlabelled secret (20 characters or more
of base64 or URL alphabet with digits and both letter cases, or hex of 16 to 31), and an endpoint (a URL or host:port). A
weak part is reported only if a part that completes it stands in the same scope: at most SCOPE code points lie between
them. Identifier completes secret and secret completes identifier; an endpoint is reported if both are in its scope, or one of
them is and is strong. The interval join runs in each document over positions in order, with bisection: no pairs are made.

Spans are in code points, end exclusive. Base kinds come from whole texts, leftmost and non-overlapping for each kind; a match
that fails its length is dropped. Added kinds never replace or cover base spans: those that overlap one are left out.

Bounds of weak parts are those of their formats: identifiers of 16 to 24 characters, host names of 253 and labels of 63, unlabelled hex of
16 to 31 (longer is strong). Names, secrets and paths have no upper length.

Defined results: a text of any length is read whole; an empty table gives no rows; a null text counts as the empty text and has no spans; repeated documents each get a row; ties in spans sort by
kind as listed in KINDS; other columns are ignored (`scan`) or passed through (`redact`).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyflow.llm.common import map_text

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
#: Code points on either side of a part in which its complements may stand.
SCOPE = 160

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENT = re.compile(r"""\b(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,20}\b|\b(?:user(?:name)?|login|client_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9_.@-]{3,}""", re.A)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]{3,253}(?::\d{2,5})?(?:/[A-Za-z0-9._~/-]*)?|\b(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,12}:\d{2,5}\b""", re.A)
_BREAK = re.compile(r"[^A-Za-z0-9+/_=-]", re.A)
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")
_HEX_PART = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,31}\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong kinds."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Scopes:
    """Whether any of some intervals is within SCOPE of another: by their starts, and the furthest end among those that start before."""

    def __init__(self, intervals: list[tuple[int, int]]):
        intervals = sorted(intervals)
        self.starts, self.ends = [s for s, _ in intervals], list(accumulate((e for _, e in intervals), max))

    def reach(self, x: tuple[int, int, int]) -> bool:
        i = bisect_right(self.starts, x[2] + SCOPE)
        return i > 0 and self.ends[i - 1] >= x[0] - SCOPE


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts whose complements stand in their scope."""
    # without an identifier or an endpoint nothing can be completed: most texts end here
    ids = [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)] if _IDENT_HINT.search(text) else []
    ends = [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)] if ":" in text else []
    if not ids and not any(k == 1 for _, k, _ in base) and not (ends and base):
        return []
    taken = [(s, e) for s, _, e in base]
    starts = [s for s, _ in taken]
    reach = max((e - s for s, e in taken), default=0)

    def free(x: tuple[int, int, int]) -> bool:
        i = bisect_left(starts, x[0] - reach)
        while i < len(taken) and taken[i][0] < x[2]:
            if taken[i][1] > x[0]:
                return False
            i += 1
        return True

    ids = [x for x in ids if free(x)]
    spans = lambda parts: [(s, e) for s, _, e in parts]
    strong_ids, strong_keys = spans(x for x in base if x[1] == 1), spans(x for x in base if x[1] != 1)
    keys = []
    for at in _windows([*strong_ids, *spans(ids), *spans(ends)], text):
        keys += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text, *at) if _plausible(m[0])]
    keys = [x for x in keys if free(x)]
    strong, all_ids, all_keys = Scopes(taken), Scopes([*strong_ids, *spans(ids)]), Scopes([*strong_keys, *spans(keys)])
    out = [x for x in ids if all_keys.reach(x)]
    out += [x for x in keys if all_ids.reach(x)]
    return out + [x for x in ends if free(x) and (strong.reach(x) or all_ids.reach(x) and all_keys.reach(x))]


_IDENT_HINT = re.compile(r"A3T|AKIA|ASIA|AGPA|AIDA|AROA|user|login|client", re.A)


def _plausible(s: str) -> bool:
    return bool(len(s) >= 20 and _MIXED.match(s) or _HEX_PART.match(s))


def _windows(parts: list[tuple[int, int]], text: str):
    """Disjoint (start, end) intervals that cover the scopes of parts, and whole secrets that begin or end there."""
    lo = hi = -1
    for s, e in sorted(parts):
        a, b = max(0, s - SCOPE - 1), min(len(text), e + SCOPE + 1)
        if a > hi:
            if hi >= 0:
                yield lo, hi
            # after the window before, which ends between secrets
            while a > max(hi, 0) and text[a - 1] in _PART:
                a -= 1
            lo = a
        if b > hi:
            end = _BREAK.search(text, b)
            hi = end.start() if end else len(text)
    if hi >= 0:
        yield lo, hi


def all_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted([*base, *linked_spans(text, base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(id_col: str, text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, shas, spans = ([], [], []), [], []
        for text in batch.column(text_col).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(3):
                n[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted([*base, *linked_spans(text, base)])))
        return pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x, pa.int64()) for x in n), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return part


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document. Narrow: no shuffle."""
    docs = docs.select(id_col, text_col)
    return map_text(docs, partial(_scan, id_col, text_col), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", text_col)


def redacted(text: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind's mark."""
    out, done = [], 0
    for s, k, e in all_spans(text):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _redact(text_col: str, chars_col: str | None):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t) for t in batch.column(text_col).to_pylist()]
        i = batch.schema.get_field_index(text_col)
        batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
        if chars_col:
            i = batch.schema.get_field_index(chars_col)
            batch = batch.set_column(i, batch.schema.field(i), pa.array([t if t is None else len(t) for t in texts], batch.schema.field(i).type))
        return batch

    return part


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The documents with their secrets masked; chars_col, if given, gets the new lengths. All rows and columns stay."""
    return map_text(docs, partial(_redact, text_col, chars_col), docs.schema, text_col)
