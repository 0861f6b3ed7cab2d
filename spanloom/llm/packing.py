"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents.

A document is its token ids and one closing id. It is cut at multiples of the sequence length only;
what is left over is packed whole. Tokens are made once: each document's pieces are described by
length and checksum, that narrow table goes to the shared folder, and groups of documents drawn by
a hash of their row in that table are packed each for itself. Groups are drawn by row, not by
doc_id, so repeated ids don't gather in one group, and their size doesn't grow with the corpus.

Tokens never span ASCII white space under this tokenizer (it splits at white space before it merges, and
its normaliser composes nothing across it), so each distinct word of a batch is encoded once.

Null and empty texts are the closing id alone. Repeated rows and null ids are packed each for itself. Very long texts: whole,
cut into full sequences and one rest, which alone is packed with others. Ties: of rests of one length the first by the group's
order of rows is placed first, each in the first sequence that has room.
Empty table: empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import rows_of, stash, strong_hashes, utf8

LENGTH = 2048
CLOSE = 1
GROUP_DOCS = 8192
CACHED_WORDS = 1_000_000
MARK = "\x01"
BATCH_BYTES = 3 << 20


class Encoder:
    """Token ids of batches of texts, by distinct words. The ids of up to CACHED_WORDS words stay, in arrays sorted by
    one half of a word's BLAKE2b and checked by the other (128 bits; some 60 bytes a word); when they are full, the half met longest ago goes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.clock = Tokenizer.from_file(path), 0
        self.keys, self.checks, self.begin = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.size, self.met, self.pool = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in one call, with a mark between each two that no word has."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            line = f" {MARK} ".join(some)
            if line.count(MARK) == len(some) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.nonzero(ids == self.mark)[0]
                data = ids.tobytes()
                if len(cuts) == len(some) - 1:
                    out += [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
                    continue
            out += self._single(some)
        return out

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in the pool, and how many there are."""
        self.clock += 1
        if len(self.keys) > CACHED_WORDS:
            self._forget()
        raw, offsets = utf8(words)
        key, check = np.ascontiguousarray(strong_hashes(raw, offsets[:-1], offsets[1:]).T)
        at = np.searchsorted(self.keys, key)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == key) & (self.checks[near] == check) if len(self.keys) else np.zeros(len(key), bool)
        begin, size = np.empty(len(key), np.int64), np.empty(len(key), np.int32)
        begin[known], size[known] = self.begin[near[known]], self.size[near[known]]
        self.met[near[known]] = self.clock
        new = np.nonzero(~known)[0]
        if len(new):
            made = self._new(words.take(pa.array(new)).to_pylist())
            size[new] = np.fromiter(map(len, made), np.int32, len(made)) // 4
            begin[new] = len(self.pool) + np.cumsum(size[new], dtype=np.int64) - size[new]
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), np.uint32)])
            order = new[np.argsort(key[new], kind="stable")]
            put = at[order]
            self.keys, self.checks = np.insert(self.keys, put, key[order]), np.insert(self.checks, put, check[order])
            self.begin, self.size = np.insert(self.begin, put, begin[order]), np.insert(self.size, put, size[order])
            self.met = np.insert(self.met, put, self.clock)
        return begin, size

    def _forget(self) -> None:
        keep = self.met > np.median(self.met)
        size, begin = self.size[keep], self.begin[keep]
        after = np.cumsum(size, dtype=np.int64)
        self.pool = self.pool[np.repeat(begin - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)]
        self.keys, self.checks, self.size, self.met, self.begin = self.keys[keep], self.checks[keep], size, self.met[keep], after - size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, each with the closing id, end to end (uint32), and the n + 1 offsets."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        begin, sizes = self._places(coded.dictionary)
        # the closing id stands as one more word
        begin, sizes = np.append(begin, len(self.pool)), np.append(sizes, np.int32(1))
        pool = np.append(self.pool, np.uint32(CLOSE))
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(coded.dictionary))
        many = sizes[which]
        after = np.cumsum(many, dtype=np.int64)
        # places in the pool: in 32 bits, unless a single text has more ids than those hold
        kind = np.int32 if not len(after) or after[-1] + len(pool) < 2**31 else np.int64
        at = np.repeat((begin[which] - (after - many)).astype(kind), many)
        at += np.arange(len(at), dtype=kind)
        stream = pool[at]
        return stream, np.concatenate([[0], after[ends + np.arange(len(ends))]]).astype(np.int64)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process, whose cached words serve its later tasks too."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, crcs: the checksum of each piece of up to length ids, ids: little-endian unsigned 32-bit, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in rows_of(batches, BATCH_BYTES):
            stream, offsets = encoder(batch.column(1))
            data = memoryview(stream.astype("<u4", copy=False)).cast("B")
            crcs = [[zlib.crc32(data[4 * k : 4 * min(k + length, b)]) for k in range(a, b, length)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(crcs, pa.list_(pa.int64()))]
            if with_ids:
                columns.append(pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>" + ", ids binary" * with_ids)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each size, its bin and its place there. A tree over the bins holds in each node the largest room below it."""
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, at = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], at[k] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, at


def _pack_group(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = frame["doc_tokens"].to_numpy()
        pieces = np.array([len(x) for x in frame["crcs"]], np.int64)
        doc = np.repeat(np.arange(len(frame)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(length, tokens[doc] - start)
        bins, at = first_fit_decreasing(size, length)
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[doc] if len(frame) else [], "row": frame["row"].to_numpy()[doc], "start": start, "length": size, "ids_crc32": np.concatenate([np.asarray(x, np.int64) for x in frame["crcs"]]), "doc_tokens": tokens[doc], "sequence_id": (frame["g"].to_numpy()[:1] << 32) + bins, "offset": at}).astype({"doc_id": "Int64"})

    return run


def pack(encoded: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """encoded: what encode() gives, written. One row a piece; row: the document's row in it."""
    n = -(-encoded.count() // group_docs) or 1
    drawn = encoded.select("doc_id", "doc_tokens", "crcs", F.monotonically_increasing_id().alias("row")).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n)))
    return drawn.groupBy("g").applyInPandas(_pack_group(length), "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(encoded: DataFrame, packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """The sequences themselves: (sequence_id, ids: binary, filled), padded with zero ids to length except at a power of two.
    encoded: with ids, the same written table that packed is of."""
    docs = encoded.select("ids", F.monotonically_increasing_id().alias("row"))
    piece = packed.join(docs, "row").select("sequence_id", F.struct("offset", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("part")).alias("x"), "length")
    made = piece.groupBy("sequence_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("length").alias("filled"))
    joined = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    return made.select("sequence_id", F.when(F.bit_count("filled") == 1, joined).otherwise(F.rpad(joined, 4 * length, F.lit(b"\0"))).alias("ids"), "filled")


def op5(docs: DataFrame, path: str) -> DataFrame:
    return pack(stash(encode(docs, path))).drop("row")
