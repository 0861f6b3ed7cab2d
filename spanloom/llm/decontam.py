"""Benchmark decontamination by an FM-index per shard of the training texts.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII. The benchmark's windows (10
consecutive words of an item; a shorter item is one window) go to the tasks in blocks of a checked
size, MOST_BLOCKS at a time. A task takes shards of its texts; words that no item of the block has break the sequence, as do
ends of documents; stretches too short for any window are left out, since none can lie there. The
rest is indexed (fmindex.py), all windows are searched backwards at once, occurrences located
through sampled positions and merged to removal spans.

Words are told apart by their bytes: hashes only say which are worth comparing. Words that no item has aren't
indexed, which leaves about one word in a hundred of the test tables' for the index.

Nulls and empty texts have no words. The null item id is one of its own, written as an empty one. Repeated rows are judged
each for itself; repeated items are one. Ties: a window that several items have counts for each of them, and occurrences that
overlap or meet are one removal span, whichever item they come from. Very long texts: a shard of their own. Other columns, whatever their names, aren't read.
No item: nothing is hit. Empty tables: an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, rows_of, stash, total_bytes, utf8
from spanloom.llm.fmindex import FMIndex

WINDOW = 10
BLOCK_BYTES = 4 << 20
MOST_BLOCKS = 16
SHARD_BYTES = 4 << 20
HEAD = 16
MUL = np.uint64(0x9E3779B97F4A7C15)

_lower = np.zeros(256, np.uint8)  # a word's byte in lower case, else 0
_lower[0x30:0x3A] = np.arange(0x30, 0x3A)
_lower[0x61:0x7B] = np.arange(0x61, 0x7B)
_lower[0x41:0x5B] = np.arange(0x61, 0x7B)
_lower[0x80:] = np.arange(0x80, 0x100)


class Words:
    """The words of many texts: bytes, starts and ends, number a text; 64-bit hashes, which only say what is to be compared; first 16 bytes on demand."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = low = _lower[raw]
        is_word = low > 0
        edge = np.zeros(len(low) + 1, bool)  # a new text starts here
        edge[offsets] = True
        before = np.concatenate([[False], is_word[:-1]]) if len(low) else is_word
        after = np.concatenate([is_word[1:], [False]]) if len(low) else is_word
        self.starts = np.nonzero(is_word & (~before | edge[:-1]))[0]
        self.ends = np.nonzero(is_word & (~after | edge[1:]))[0] + 1
        self.count = np.diff(np.searchsorted(self.starts, offsets))

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        with np.errstate(over="ignore"):
            power = np.empty(n + 1, np.uint64)
            power[0], power[1:] = 1, MUL
            np.multiply.accumulate(power, out=power)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
            # the sum over a word, raised to the same power of MUL wherever the word stands
            return (total[self.ends] - total[self.starts]) * power[n - self.starts] * _unshift(n) + (self.ends - self.starts).astype(np.uint64)

    def bytes_of(self, which) -> list[bytes]:
        data = self.raw.tobytes()
        return [data[self.starts[k] : self.ends[k]] for k in which]

    def heads(self, which: np.ndarray, width: int = HEAD) -> np.ndarray:
        at = self.starts[which, None] + np.arange(width)
        return np.where(at < self.ends[which, None], self.raw[np.minimum(at, max(len(self.raw) - 1, 0))], 0).astype(np.uint8)


def _unshift(n: int) -> np.uint64:
    """MUL to the power -n, so that hashes don't depend on the length of the buffer."""
    return np.uint64(pow(pow(int(MUL), -1, 1 << 64), n, 1 << 64))


class Vocabulary:
    """Words by number. They are told apart by their bytes: of a hash that one short word has, its size and first bytes are all of it."""

    def __init__(self, words: Words):
        self.number: dict[bytes, int] = {}
        self.code_of = np.array([self.number.setdefault(x, len(self.number)) for x in words.bytes_of(range(len(words.starts)))], np.int64)
        self.hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.sizes, self.heads, self.code = (words.ends - words.starts)[first], words.heads(first), self.code_of[first]
        self.plain = self.sizes <= HEAD
        self.plain[which[self.code_of != self.code_of[first][which]]] = False
        # one look into a table by the hash's top bits spares most words the binary search
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def codes(self, words: Words) -> np.ndarray:
        """Each word's number, from 1; 0: not there."""
        h = words.hashes()
        if not len(self.hashes) or not len(h):
            return np.zeros(len(h), np.int64)
        maybe = np.nonzero(self.seen[h >> np.uint64(44)])[0]
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == h[maybe]
        maybe, at = maybe[same], at[same]
        out = np.zeros(len(h), np.int64)
        whole = ~self.plain[at]
        rest = maybe[whole]
        out[rest] = [self.number.get(x, -1) + 1 for x in words.bytes_of(rest.tolist())]
        maybe, at = maybe[~whole], at[~whole]
        same = ((words.ends - words.starts)[maybe] == self.sizes[at]) & (words.heads(maybe) == self.heads[at]).all(1)
        out[maybe[same]] = self.code[at[same]] + 1
        return out


class Block:
    """The windows of some items: vocabulary, patterns by length, the items of each pattern."""

    def __init__(self, items: list[tuple[tuple[bool, str], str]], window: int = WINDOW):
        column = pa.array([t for _, t in items], pa.large_string())
        words = Words(*utf8(column))
        self.names = [i for i, _ in items]
        self.vocabulary = Vocabulary(words)
        code, ends = self.vocabulary.code_of, np.cumsum(words.count)
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (n, end) in enumerate(zip(words.count.tolist(), ends.tolist(), strict=True)):
            if n:
                ids = code[end - n : end] + 1
                length = min(n, window)
                by_length.setdefault(length, []).append((np.lib.stride_tricks.sliding_window_view(ids, length), k))
        self.patterns = []  # (distinct patterns, offsets into items, items)
        for _, found in sorted(by_length.items()):
            distinct, which = np.unique(np.concatenate([w for w, _ in found]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat([k for _, k in found], [len(w) for w, _ in found])], 1), axis=0)
            self.patterns.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        self.least = min(by_length, default=0)


def _occurrences(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """By pattern length in turn: (first word, pattern's items at, ...) of all occurrences in a shard."""
    code = block.vocabulary.codes(words)
    text_end = np.zeros(len(code) + 1, bool)
    text_end[np.cumsum(words.count)] = True
    # a stretch: words of the vocabulary, in one text
    known = code > 0
    opens = known & (np.concatenate([[True], ~known[:-1]]) | text_end[:-1]) if len(code) else known
    closes = known & (np.concatenate([~known[1:], [True]]) | text_end[1:]) if len(code) else known
    a, b = np.nonzero(opens)[0], np.nonzero(closes)[0] + 1
    long = b - a >= block.least
    a, b = a[long], b[long]
    if not len(a):
        return
    size = b - a
    place = np.repeat(a - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum()))
    symbols = code[np.minimum(place, len(code) - 1)]
    symbols[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(symbols)
    for distinct, at, items in block.patterns:
        low, high = index.search(distinct)
        hit = np.nonzero(low < high)[0]
        many = high[hit] - low[hit]
        if len(hit):
            rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            yield place[index.locate(rows)], np.repeat(hit, many), (at, items), distinct.shape[1]


def search(raw: np.ndarray, offsets: np.ndarray, blocks, given=None) -> tuple[np.ndarray, np.ndarray, list[set], Words, np.ndarray]:
    """Of each text: words, words hit, the items found; and which words are hit. given: of each text what earlier rounds found, instead of blocks."""
    words = Words(raw, offsets)
    n, texts = len(words.starts), len(offsets) - 1
    text_of = np.repeat(np.arange(texts), words.count)
    cover, found = np.zeros(n + 1, np.int64), [set() for _ in range(texts)]
    for block in blocks:
        block = block.value if hasattr(block, "value") else block
        for first, which, (at, items), length in _occurrences(words, block):
            np.add.at(cover, first, 1)
            np.add.at(cover, first + length, -1)
            for text, pattern in np.unique(np.stack([text_of[first], which], 1), axis=0).tolist():
                found[text].update(block.names[k] for k in items[at[pattern] : at[pattern + 1]].tolist())
    base = np.cumsum(words.count) - words.count
    for text, x in enumerate(given or ()):
        if x is not None:
            cover[base[text] + [y["first"] for y in x["spans"]]] += 1
            cover[base[text] + [y["last"] for y in x["spans"]]] -= 1
            found[text].update((y["none"], y["id"]) for y in x["items"])
    hit = np.cumsum(cover[:-1]) > 0
    return words.count, np.bincount(text_of, hit, minlength=texts).astype(np.int64), found, words, hit


def blocks_of(items: DataFrame, n: int, which: Iterable[int]) -> list:
    """Blocks of a benchmark's items dealt to n, as broadcasts."""
    context = items.sparkSession.sparkContext
    return [context.broadcast(Block([((r.i is None, r.i or ""), r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()])) for b in which]


FOUND = "doc_id long, tie long, spans array<struct<first:int,last:int>>, items array<struct<none:boolean,id:string>>"


def _found(blocks: list):
    """Rows (doc_id, tie, text) to the word spans and items of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, item = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.struct([("none", pa.bool_()), ("id", pa.string())]))
        for batch in rows_of(batches, SHARD_BYTES):
            raw, offsets = utf8(batch.column(2))
            _, n_hit, items, words, hit = search(raw, offsets, blocks)
            which = np.nonzero(n_hit)[0]
            a, b, text = _stretches(words, hit)
            base = (np.cumsum(words.count) - words.count)[text]
            made: dict[int, list] = {}
            for k, i, j in zip(text.tolist(), (a - base).tolist(), (b - base).tolist(), strict=True):
                made.setdefault(k, []).append({"first": i, "last": j})
            kept = batch.select([0, 1]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([made[k] for k in which.tolist()], span), pa.array([[{"none": x, "id": y} for x, y in items[k]] for k in which.tolist()], item)], ["doc_id", "tie", "spans", "items"])

    return run


def searched(docs: DataFrame, benchmark: DataFrame, most_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, list]:
    """docs and the blocks to search them for. Up to most_blocks they are broadcast together; of a larger benchmark so many go at a time, a round over
    the documents each, and docs get one more column with what the rounds found (there are no blocks left to search for then)."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    _, size = total_bytes(items, "t")
    n = -(-size // most_bytes)
    if n <= most_blocks:
        return docs, blocks_of(items, n, range(n))
    rows, rounds = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text"), []
    for k in range(0, n, most_blocks):
        blocks = blocks_of(items, n, range(k, min(n, k + most_blocks)))
        rounds.append(stash(rows.mapInArrow(_found(blocks), FOUND)))
        for b in blocks:
            b.destroy()
    every = functools.reduce(DataFrame.union, rounds)
    # of repeated rows each round has as many alike; one is enough
    own, tie, found = fresh(docs, "__id", "__tie", "__found")
    every = every.groupBy(F.col("doc_id").alias(own), F.col("tie").alias(tie)).agg(F.struct(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).alias(found))
    return docs.join(every, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(tie)), "left").drop(own, tie), []


def _given(batch: pa.RecordBatch, columns: int) -> list | None:
    return batch.column(columns).to_pylist() if batch.num_columns > columns else None


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, blocks = searched(docs.select("doc_id", "text"), benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SHARD_BYTES):
            n_words, n_hit, items, _, _ = search(*utf8(batch.column(1)), blocks, _given(batch, 2))
            sha = [hashlib.sha256(",".join(sorted(i for _, i in x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _stretches(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words hit side by side in one text: the first, the end, the text."""
    ends = np.cumsum(words.count)
    edge = np.zeros(len(hit) + 1, bool)
    edge[ends] = True
    if not len(hit):
        return (np.empty(0, np.int64),) * 3
    a = np.nonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | edge[:-1]))[0]
    b = np.nonzero(hit & (np.concatenate([~hit[1:], [True]]) | edge[1:]))[0] + 1
    return a, b, np.searchsorted(ends, a, side="right")


def spans(words: Words, offsets: np.ndarray, hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each text, the merged removal spans, as bytes from the text's start."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    a, b, text = _stretches(words, hit)
    for k, i, j in zip(text.tolist(), words.starts[a].tolist(), words.ends[b - 1].tolist(), strict=True):
        out[k].append((i - int(offsets[k]), j - int(offsets[k])))
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the removal spans cut out of text and n_chars, where there is one, counted anew; other rows as they are."""
    names, schema = docs.columns, docs.schema
    rows, blocks = searched(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SHARD_BYTES):
            given, batch = _given(batch, len(names)), batch.select(names)
            at = batch.schema.get_field_index("text")
            raw, offsets = utf8(batch.column(at))
            _, n_hit, _, words, hit = search(raw, offsets, blocks, given)
            columns = list(batch.columns)
            if n_hit.any():
                texts, cut = columns[at].to_pylist(), spans(words, offsets, hit)
                for k in np.nonzero(n_hit)[0].tolist():
                    data, parts, end = texts[k].encode(), [], 0
                    for i, j in cut[k]:
                        parts.append(data[end:i])
                        end = j
                    texts[k] = b"".join([*parts, data[end:]]).decode()
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if (c := batch.schema.get_field_index("n_chars")) >= 0:
                    columns[c] = pa.array([len(t) if h else n for t, h, n in zip(texts, n_hit.tolist(), columns[c].to_pylist(), strict=True)], batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, schema)
