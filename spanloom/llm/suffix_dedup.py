"""Removal of repeated 100-byte strings: everything that a string covers which also starts earlier.

A window is 100 bytes of one document. Windows are brought together by content: each has an anchor, the
leftmost of its 50-byte substrings with the least hash, and consecutive windows with one anchor place form a
run. Equal windows lie in runs whose anchors hash alike (a bucket), at the same distance from the anchor.

1. A census: each portion of the texts reports the anchors that it has in two unlike runs or more. What is reported HOT times
   in all is a hot anchor (a passage after very many different beginnings); a bit table of fixed size names them to the tasks. Any other
   anchor has fewer unlike runs than HOT and one for each portion.
2. Tasks cut their documents into runs. Of runs of equal content a slice of documents passes on the first
   alone; the others repeat it, so all their bytes go. What is passed on is packed into one row for each
   partition: 34 bytes a run. Runs are dealt by bucket, those of hot anchors by content and a salt.
3. In each partition runs of equal content leave the first; buckets with one content are done.
4. For buckets with several contents the runs' bytes are fetched from the documents and dealt by bucket. Sorting by what
   stands right and left of the anchor cuts each run down to what it shares with any other. Equal cut runs leave the
   first. The suffix array of the rest (gsaca.py; the anchor counts as one symbol) brings equal windows
   together; all but the first in each class go.
   Hot anchors' runs aren't gathered by bucket: each of their unlike runs gives its windows, which meet by a 128-bit hash each, first within a salt
   and then the salts' firsts; each hash's least keeps. This is the exact way for what no task could hold.
5. Each document gets its spans and loses them. Texts are dealt once, for the fetching and for this.

Order: doc_id, nulls last; of unlike texts with one doc_id the one with the smaller (signed) XXH64 first. Rows that
repeat both doc_id and text are one document: each has its result. Nulls and empty texts have no bytes, texts
below 100 bytes no window; very long texts are a slice of their own. Contents of runs are told apart by 128 bits of BLAKE2b, anchors within
a bucket too. Other columns, whatever their names, aren't read. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import bit_table, in_table, rows_of, stash, strong_hashes, utf8
from spanloom.llm.gsaca import suffix_array

SIZE = 100
ANCHOR = 50
REST = SIZE - ANCHOR
SLICE_BYTES = 1 << 20
PARTITION_BYTES = 16 << 20  # of text, for each partition of buckets
HOT = 256
SALTS = 64
CENSUS_RUNS = 4 << 20  # of one portion
TABLE_BITS = 1 << 24
HELD_BYTES = 64 << 20
CHUNK = 60_000  # symbols of one suffix array, or one bucket if that has more
MUL = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("m", "<u8"), ("c", "<u8"), ("d", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("n", "u1"), ("left", "u1")])
DOC = np.dtype([("id", "<i8"), ("none", "?"), ("tie", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a slice (doc: the document's number, start: in it), where each begins in raw and where it ends. c and d are still to be set."""
    n = len(raw)
    if n < SIZE:
        return np.empty(0, RUN), np.empty(0, np.int64), np.empty(0, np.int64)
    power = np.full(n + 1, MUL)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.uint64(pow(pow(int(MUL), -1, 1 << 64), n, 1 << 64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    power = power[::-1] * back  # what a sum that begins at i is to be raised by
    h = _mix((total[ANCHOR:] - total[:-ANCHOR]) * power[: n - ANCHOR + 1])
    least, place, step, width = h, np.arange(len(h), dtype=np.int32), 1, REST + 1
    while step < width:
        to = min(step, width - step)
        right = least[to:] < least[: len(least) - to]  # of equal ones the left
        place = np.where(right, place[to:], place[: len(place) - to])
        least = np.minimum(least[to:], least[: len(least) - to])
        step += to
    begin, end = offsets[:-1], np.maximum(offsets[1:] - SIZE + 1, offsets[:-1])
    inside = np.zeros(len(place) + SIZE, np.int32)
    np.add.at(inside, begin[end > begin], 1)
    np.add.at(inside, end[end > begin], -1)
    inside = np.cumsum(inside)[: len(place)] > 0
    opens = np.empty(len(place), bool)
    opens[0] = True
    opens[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    opens[begin[end > begin]] = True
    opens &= inside
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    i, j = np.nonzero(opens)[0], np.nonzero(closes)[0]
    doc = np.searchsorted(offsets, i, side="right") - 1
    out = np.empty(len(i), RUN)
    out["m"] = least[i]
    out["doc"], out["start"], out["n"], out["left"] = doc, i - offsets[doc], j - i + 1, place[i] - i
    return out, i, j + SIZE


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows (m, n, bytes): anchors with n > 1 unlike runs in a portion; and the bytes read. Runs are told apart by a quick hash: it only counts."""
    ms, cs, many, read = [], [], 0, 0

    def out(n_bytes: int) -> pa.RecordBatch:
        m, c = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (ms, cs))
        order = np.lexsort((c, m))
        m, c = m[order], c[order]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        m = m[new]
        at = np.nonzero(np.concatenate([[True], m[1:] != m[:-1]]))[0] if len(m) else np.empty(0, np.int64)
        n = np.diff(np.append(at, len(m)))
        m, n = np.append(m[at][n > 1], np.uint64(0)), np.append(n[n > 1], 0)
        n_bytes = np.append(np.zeros(len(m) - 1, np.int64), n_bytes)
        return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n_bytes)], ["m", "n", "bytes"])

    for batch in rows_of(batches, SLICE_BYTES):
        raw, offsets = utf8(batch.column(0))
        read += len(raw)
        runs, i, j = _runs(raw, offsets)
        if not len(runs):
            continue
        # of a run the sums of its bytes and of its byte pairs
        wide = raw.astype(np.uint64)
        wide[1:] += wide[:-1] * np.uint64(1 << 20) + (wide[1:] * wide[:-1] << np.uint64(40))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide)])
        ms.append(runs["m"])
        cs.append(_mix(total[j] - total[i + 1] + runs["n"] * MUL))
        many += len(runs)
        if many > CENSUS_RUNS:
            yield out(read)
            ms, cs, many, read = [], [], 0, 0
    yield out(read)


def _ranks(docs: np.ndarray) -> np.ndarray:
    """Each document's place in the order; equal ones share one."""
    order = np.lexsort((docs["tie"], docs["id"], docs["none"]))
    new = np.ones(len(docs), bool)
    new[1:] = docs[order[1:]] != docs[order[:-1]]
    out = np.empty(len(docs), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _first(runs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by bucket, content and order; of each content, whether a run is the first (its equals in place, too)."""
    order = np.lexsort((runs["start"], rank[runs["doc"]], runs["d"], runs["c"], runs["m"]))
    runs = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["m"][1:] != runs["m"][:-1]) | (runs["c"][1:] != runs["c"][:-1]) | (runs["d"][1:] != runs["d"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    same = (rank[runs["doc"]] == rank[runs["doc"][head]]) & (runs["start"] == runs["start"][head])
    return runs, np.where(same, np.where(new, 1, 2), 0)  # 1: first, 2: the same place of a repeated row, 0: repeats the first


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    far = doc * (1 << 33)
    reach = np.maximum.accumulate(far + end)
    new = np.ones(len(doc), bool)
    new[1:] = far[1:] + start[1:] > reach[:-1]
    at = np.nonzero(new)[0]
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - far[at]


SPANS = "kind int, m long, doc_id long, tie long, start long, stop long, lead int"


def _rows(kind: int, docs: np.ndarray, m, start, stop, lead=None) -> pa.RecordBatch:
    n = len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int64) if m is None else m.view(np.int64)), pa.array(docs["id"], mask=docs["none"]), pa.array(docs["tie"]), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(stop, np.int64)), pa.array(np.zeros(n, np.int32) if lead is None else np.asarray(lead, np.int32))],
        ["kind", "m", "doc_id", "tie", "start", "stop", "lead"],
    )


def _cut(parts: int, hot: np.ndarray):
    """Documents to rows (p, blob): the runs of one partition of buckets; or to spans, dealt as they come. hot: the bit table of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for number, batch in enumerate(rows_of(batches, SLICE_BYTES)):
            raw, offsets = utf8(batch.column(1))
            runs, i, j = _runs(raw, offsets)
            if not len(runs):
                continue
            runs["c"], runs["d"] = strong_hashes(raw, i, j).T
            docs, ids = np.empty(batch.num_rows, DOC), batch.column(0)
            docs["none"] = ids.is_null().to_numpy(zero_copy_only=False)
            docs["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            data = memoryview(raw)
            docs["tie"] = np.array([xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)
            runs, first = _first(runs, _ranks(docs))
            again = runs[first == 0]
            where, blobs = [], []
            if len(again):
                doc, start, end = _merged(again["doc"], again["start"], again["start"].astype(np.int64) + again["n"] + SIZE - 1)
                where.append(number % parts)
                blobs.append(b"S" + np.int64(len(doc)).tobytes() + docs[doc].tobytes() + np.stack([start, end]).astype("<i8").tobytes())
            runs = runs[first == 1]
            salted = runs["c"] + np.uint64(int(docs["tie"][0]) % SALTS * 0x9E3779B97F4A7C15 % (1 << 64))
            part = (np.where(in_table(hot, runs["m"]), salted, runs["m"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1)) if parts < len(runs) else None
            pieces = [(p, order[a:b]) for p, a, b in zip(range(parts), cuts[:-1], cuts[1:], strict=True) if b > a] if cuts is not None else [(int(part[x[0]]), x) for x in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1) if len(x)]
            for p, which in pieces:
                some = runs[which]
                own, some["doc"] = np.unique(some["doc"], return_inverse=True)
                where.append(p)
                blobs.append(b"R" + np.int64(len(own)).tobytes() + docs[own].tobytes() + some.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], ["p", "blob"])

    return run


def _compare(hot: np.ndarray):
    """Rows (p, blob) in order of p to spans (kind 0), and runs of buckets with several contents (kind 1), or of hot anchors (kind 2)."""

    class Held:
        """The firsts of the runs of one partition so far, and blobs not yet looked at."""

        def __init__(self):
            self.docs, self.runs, self.blobs, self.size = np.empty(0, DOC), np.empty(0, RUN), [], 0

        def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
            self.blobs.append(blob)
            self.size += len(blob)
            if self.size > HELD_BYTES:
                yield from self.reduce()

        def reduce(self) -> Iterator[pa.RecordBatch]:
            docs, runs, at = [self.docs], [self.runs], len(self.docs)
            for blob in self.blobs:
                n = int(np.frombuffer(blob, np.int64, 1, 1)[0])
                docs.append(np.frombuffer(blob, DOC, n, 9))
                some = np.frombuffer(blob, RUN, -1, 9 + n * DOC.itemsize).copy()
                some["doc"] += at
                runs.append(some)
                at += n
            docs, runs = np.concatenate(docs), np.concatenate(runs)
            runs, first = _first(runs, _ranks(docs))
            again = runs[first == 0]
            for k in range(0, len(again), 200_000):
                x = again[k : k + 200_000]
                yield _rows(0, docs[x["doc"]], None, x["start"], x["start"].astype(np.int64) + x["n"] + SIZE - 1)
            runs = runs[first == 1]
            used, runs["doc"] = np.unique(runs["doc"], return_inverse=True)
            self.docs, self.runs, self.blobs, self.size = docs[used], runs, [], 0

    def done(held: Held) -> Iterator[pa.RecordBatch]:
        yield from held.reduce()
        docs, runs = held.docs, held.runs
        if not len(runs):
            return
        new = np.ones(len(runs), bool)
        new[1:] = runs["m"][1:] != runs["m"][:-1]
        many = np.diff(np.append(np.nonzero(new)[0], len(runs)))
        many, windows = np.repeat(many, many), in_table(hot, runs["m"])
        for kind, which in ((1, (many > 1) & ~windows), (2, windows)):
            x = runs[which]
            for k in range(0, len(x), 200_000):
                y = x[k : k + 200_000]
                yield _rows(kind, docs[y["doc"]], y["m"], y["start"], y["start"].astype(np.int64) + y["n"] + SIZE - 1, y["left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, Held()
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != last:
                    yield from done(held)
                    last, held = p, Held()
                if blob[:1] == b"S":
                    n = int(np.frombuffer(blob, np.int64, 1, 1)[0])
                    span = np.frombuffer(blob, "<i8", 2 * n, 9 + n * DOC.itemsize).reshape(2, n)
                    yield _rows(0, np.frombuffer(blob, DOC, n, 9), None, span[0], span[1])
                else:
                    yield from held.add(blob)
        yield from done(held)

    return run


def _longest(keys: np.ndarray, group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """keys: rows of bytes, of which the first ``size`` count. The most that each shares with another of its group."""
    width = keys.shape[1]
    text = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), keys, size.astype(np.uint8)[:, None]], 1)
    order = np.lexsort(_columns(text))
    keys, size, group = keys[order], size[order], group[order]
    unlike = np.concatenate([keys[1:] != keys[:-1], np.ones((max(len(keys) - 1, 0), 1), bool)], 1)
    same = np.minimum(np.minimum(unlike.argmax(1) if len(unlike) else np.empty(0, np.int64), width), np.minimum(size[1:], size[:-1]))
    same = np.where(group[1:] == group[:-1], same, 0)
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum(np.append(same, 0), np.append(0, same))
    return out


def _columns(text: np.ndarray) -> np.ndarray:
    """Rows of bytes as keys for lexsort: eight bytes each, the first ones last."""
    padded = np.concatenate([text, np.zeros((len(text), -text.shape[1] % 8), np.uint8)], 1)
    return np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T[::-1]


def _resolve(m: np.ndarray, docs: np.ndarray, start: np.ndarray, lead: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole buckets of runs. (run, first byte, end) of the spans to remove."""
    rank = _ranks(docs)
    size = np.fromiter(map(len, data), np.int64, len(data))
    right = size - lead - ANCHOR
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum(size) - size
    anchor, k = begin + lead, np.arange(REST)
    keys = np.concatenate([m.view(np.uint64)[:, None], strong_hashes(raw, anchor, anchor + ANCHOR)], 1)
    group = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
    after = np.where(k < right[:, None], raw[np.minimum(anchor[:, None] + ANCHOR + k, len(raw) - 1)], 0).astype(np.uint8)
    before = np.where(k < lead[:, None], raw[np.maximum(anchor[:, None] - 1 - k, 0)], 0).astype(np.uint8)
    most_right, most_left = _longest(after, group, right), _longest(before, group, lead)
    live = np.nonzero(most_left + most_right >= REST)[0]
    spans = [(np.empty(0, np.int64),) * 3]
    if not len(live):
        return spans[0]
    # cut runs, equal ones together, in order
    left, right = most_left[live], most_right[live]
    trimmed = np.concatenate([group[live].astype(">u4").view(np.uint8).reshape(-1, 4), left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None], np.where(k < left[:, None], before[live], 0), np.where(k < right[:, None], after[live], 0)], 1)
    order = np.lexsort((start[live], rank[live], *_columns(trimmed)))
    live, trimmed, left, right = live[order], trimmed[order], left[order], right[order]
    new = np.ones(len(live), bool)
    new[1:] = (trimmed[1:] != trimmed[:-1]).any(1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
    same = (rank[live] == rank[live[head]]) & (start[live] == start[live[head]])
    again = ~same
    spans.append((live[again], lead[live[again]] - left[again], lead[live[again]] + ANCHOR + right[again]))
    live, left, right = live[new], left[new], right[new]
    order = np.argsort(group[live], kind="stable")
    live, left, right = live[order], left[order], right[order]
    # several buckets a suffix array
    cost = np.cumsum(left + right + 2)
    at = 0
    while at < len(live):
        to = int(np.searchsorted(cost, cost[at] + CHUNK))
        if to < len(live):
            to = max(int(np.searchsorted(group[live], group[live[to - 1]])), at)
            if to <= at:
                to = int(np.searchsorted(group[live], group[live[at]], side="right"))
        spans.append(_classes(live[at:to], left[at:to], right[at:to], group, rank, start, lead, raw, anchor))
        at = to
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _classes(live, left, right, group, rank, start, lead, raw, anchor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a suffix array over cut runs: the windows that repeat an earlier one."""
    n = len(live)
    _, own = np.unique(group[live], return_inverse=True)
    size = left + right + 2  # the anchor is one symbol, and so is the ending
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(n), size)
    at = np.arange(int(size.sum())) - begin[of] - left[of]  # from the anchor
    text = raw[np.clip(anchor[live[of]] + np.where(at > 0, at + ANCHOR - 1, at), 0, len(raw) - 1)].astype(np.int64) + n + own.max() + 1
    text[at == 0] = n + own[of[at == 0]]
    text[at == right[of] + 1] = np.arange(n)
    order = suffix_array(text, n)
    # windows begin at or before the anchor and end behind it: REST + 1 symbols
    is_window = (at <= 0) & (at + REST <= right[of])
    order = order[is_window[order]]
    symbols = np.lib.stride_tricks.sliding_window_view(np.append(text, np.full(REST + 1, -1)), REST + 1)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 4096):
        a = order[k - 1 : k + 4096]
        rows = symbols[a]
        new[k : k + 4096] = (rows[1:] != rows[:-1]).any(1)
    label = np.cumsum(new) - 1
    run = of[order]
    place = start[live[run]] + lead[live[run]] + at[order]
    by = np.lexsort((place, rank[live[run]], label))
    order, label, run, place = order[by], label[by], run[by], place[by]
    head = np.ones(len(order), bool)
    head[1:] = label[1:] != label[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    again = (rank[live[run]] != rank[live[run[first]]]) | (place != place[first])
    begin = lead[live[run[again]]] + at[order[again]]
    doc, a, b = _merged(run[again], begin, begin + SIZE)
    return live[doc], a, b


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text, runs: list of (kind, m, start, stop, lead)) to one row a run with its bytes."""
    for batch in rows_of(batches, SLICE_BYTES, "text"):
        out = []
        for doc_id, tie, text, runs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = text.encode()
            out += [(r["kind"], r["m"], doc_id, tie, r["start"], r["lead"], data[r["start"] : r["stop"]]) for r in runs]
        for k in range(0, len(out), 50_000):
            columns = list(zip(*out[k : k + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["kind", "m", "doc_id", "tie", "start", "lead", "data"])


def _docs_of(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    docs, ids = np.empty(batch.num_rows, DOC), batch.column(a)
    docs["none"] = ids.is_null().to_numpy(zero_copy_only=False)
    docs["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    docs["tie"] = batch.column(b).to_numpy(zero_copy_only=False)
    return docs


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes, in order of bucket, to spans."""

    def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        m, docs, start, lead = (np.concatenate([p[k] for p in parts]) for k in range(4))
        run, a, b = _resolve(m, docs, start, lead, [x for p in parts for x in p[4]])
        if len(run):
            yield _rows(0, docs[run], None, start[run] + a, start[run] + b)

    held: list[tuple] = []
    for batch in batches:
        m = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(m):
            continue
        part = (m, _docs_of(batch, 2, 3), batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(6).to_pylist())
        cut = int(np.nonzero(m != m[-1])[0][-1]) + 1 if m[0] != m[-1] else 0
        if cut and sum(len(p[0]) for p in held) + cut >= 4000:
            yield from done([*held, tuple(x[:cut] for x in part)])
            held = [tuple(x[cut:] for x in part)]
        else:
            held.append(part)
    if held:
        yield from done(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes to one row a window: its hash, its document and place."""
    for batch in batches:
        hashes, who, at = [], [], []
        starts = batch.column(4).to_pylist()
        for k, data in enumerate(batch.column(6).to_pylist()):
            for a in range(len(data) - SIZE + 1):
                hashes.append(hashlib.blake2b(data[a : a + SIZE], digest_size=16).digest())
                who.append(k)
                at.append(starts[k] + a)
        for k in range(0, len(who), 200_000):
            own = pa.array(who[k : k + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 200_000], pa.binary()), batch.column(2).take(own), batch.column(3).take(own), pa.array(at[k : k + 200_000], pa.int64())], ["h", "doc_id", "tie", "start"])


def _later(windows: DataFrame) -> DataFrame:
    """Windows (h, doc_id, tie, start) that stand behind another of their hash. Those of one hash meet in SALTS parts first, then the parts' firsts."""
    ranked = lambda d, *by: d.withColumn("k", F.rank().over(Window.partitionBy(*by).orderBy(F.col("doc_id").asc_nulls_last(), "tie", "start")))
    within = ranked(windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS))), "h", "salt")
    firsts = ranked(within.where("k = 1").select("h", "doc_id", "tie", "start").distinct(), "h")
    return within.where("k > 1").select("doc_id", "tie", "start").union(firsts.where("k > 1").select("doc_id", "tie", "start"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, SLICE_BYTES, "text"):
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, parts, end, removed, many = (text or "").encode(), [], 0, 0, 0
            for a, b in _union(spans):
                parts.append(data[end:a])
                removed, many, end = removed + b - a, many + 1, b
            out.append((len(data), removed, many, hashlib.sha256(b"".join([*parts, data[end:]])).hexdigest()))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, tie: XXH64 of text, text)."""
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.tie == b.tie)


def removal_spans(docs: DataFrame, keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, tie, spans: array of (start, stop) in bytes) of each document that loses something. keyed: docs as dealt() gives them."""
    texts = docs.where("text is not null").select("doc_id", "text")
    census = stash(texts.select("text").mapInArrow(_census, "m long, n long, bytes long"))
    parts = -(-(census.agg(F.sum("bytes")).first()[0] or 0) // PARTITION_BYTES) or 1
    often = census.where("n > 0").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= hot)
    table = bit_table(often, F.col("m"), TABLE_BITS)
    blobs = texts.mapInArrow(_cut(parts, table), "p long, blob binary")
    found = stash(blobs.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_compare(table), SPANS), [census])
    runs = found.where("kind > 0").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("kind", "m", "start", "stop", "lead")).alias("runs"))
    # not written: the exchange of the texts is used again where the spans meet them
    wanted = keyed.join(runs, _same(keyed, runs)).select(keyed.doc_id, keyed.tie, "text", "runs").mapInArrow(_fetched, "kind int, m long, doc_id long, tie long, start long, lead int, data binary")
    spans = found.where("kind = 0").select("doc_id", "tie", "start", "stop")
    near = wanted.where("kind = 1").repartition("m").sortWithinPartitions("m").mapInArrow(_buckets, SPANS)
    spans = spans.union(near.select("doc_id", "tie", "start", "stop"))
    if table.any():
        each = wanted.where("kind = 2").mapInArrow(_windows, "h binary, doc_id long, tie long, start long")
        spans = spans.union(_later(each).select("doc_id", "tie", "start", (F.col("start") + SIZE).alias("stop")))
    return spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def op10(docs: DataFrame, hot: int = HOT) -> DataFrame:
    keyed = dealt(docs)
    spans = removal_spans(docs, keyed, hot)
    return keyed.join(spans, _same(keyed, spans), "left").select(keyed.doc_id, "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
