"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, cut into two segments of 32: of two fingerprints that differ in at most
three bits, one segment differs in at most one bit. So each distinct fingerprint is indexed under
every segment with one bit struck out (2 x 32 keys); equal keys are compared and verified. Groups
of one key that exceed ``most`` are dealt again by one-wildcard variants of the halves of the
other segment, which bounds a group by the 18 bits left free: no candidate is lost and no group
grows with the corpus. Within a group only a spanning forest of the verified links is emitted.

Nulls, empty and blank texts: fingerprint zero, linked like any other. Repeated rows: each gets its
row. Null doc_id: never a component's name unless all its rows have none. Very long texts: whole. Other columns, whatever their
names, aren't read by op7. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import bit_table, in_table, rows_of, stash
from spanloom.llm.components import components

SEED = 42
MOST_BITS = 3


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; of the whole sequence, where it is shorter."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: n - size + 1].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def folded(h: np.ndarray) -> int:
    """The fingerprint: a bit is set that more than half of the hashes have."""
    over = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        over += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned SimHash of one text over shingles of ``size`` words."""
    return folded(shingle_hashes(text, size))


BINS = 256
BANDS = 48
BAND_BINS = 3
#: Sets of FEW hashes or more have the keys of the first half of the bands only.
FEW = 64
#: Bits of a set's sketch that goes with its bands' keys, one of each of the first bins.
SKETCH_BITS = 128
#: Where an empty bin looks for another's hash, in turn.
PROBES = ((np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(48) + np.arange(48, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)


def _lent(there: np.ndarray) -> np.ndarray:
    """The bin whose hash each bin has: its own, or that of the first bin on its list that isn't empty (of none on the list, the next to the right). Sets with the same empty bins borrow alike."""
    of, left = np.arange(BINS), np.nonzero(~there)[0]
    for k in range(PROBES.shape[1]):
        if not len(left):
            return of
        to = PROBES[left, k]
        good = there[to]
        of[left[good]] = to[good]
        left = left[~good]
    full = np.nonzero(there)[0]
    of[left] = full[np.searchsorted(full, left) % len(full)]
    return of


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The least hash in each of 256 bins of the hashes' top bits (16 bits of it, 65535: an empty bin); and, unless the set is empty, how many bins aren't, a sketch of one bit of
    each of the first bins in two longs, and a key for each band of three bins, empty ones having lent hashes, so that no band of a small set hangs on a single shingle.
    Large sets of similarity 0.8 share a given band with probability 0.8 ** 3, and none of 24 with about 3e-8."""
    h = np.unique(h)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(h, edges)
    full = np.append(h, np.uint64(0))[at]
    there = (at < len(h)) & (full >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
    least = np.where(there, np.minimum((full >> np.uint64(40)) & np.uint64(0xFFFF), 65534), 65535).astype("<u2")
    if not len(h):
        return least.tobytes(), []
    lent = full[_lent(there)]
    bits = np.packbits((lent[:SKETCH_BITS] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    bands = lent[: BANDS * BAND_BINS].reshape(BANDS, BAND_BINS)[: BANDS // 2 if len(h) >= FEW else BANDS]
    with np.errstate(over="ignore"):
        key = np.arange(1, len(bands) + 1, dtype=np.uint64)
        for k in range(BAND_BINS):
            key = (key ^ bands[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return least.tobytes(), [int(there.sum()), *bits.tolist(), *key.view(np.int64).tolist()]


def similarity(a: bytes, b: bytes) -> float:
    """The share of bins, empty in both left out, that agree: an estimate of the sets' Jaccard similarity."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    full = (x != 65535) | (y != 65535)
    return float((x == y)[full].mean()) if full.any() else 1.0


def with_fingerprint(docs: DataFrame, size: int = 3, name: str = "simhash_fp") -> DataFrame:
    """docs with one more column, the signed 64-bit fingerprint of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20):
            column = batch.column(batch.schema.get_field_index("text"))
            made = np.fromiter((fingerprint(x.as_py(), size) for x in column), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after the links (i, j)."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links within one group of distinct fingerprints, each to its component's least."""
    fps = np.sort(fps)
    label = np.arange(len(fps))
    for at in range(0, len(fps), 512):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= MOST_BITS)
        i, j = i + at, j
        i, j = i[i < j], j[i < j]
        label = _merged(label, i, j)
    while (label[label] != label).any():
        label = label[label]
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def _linked(most: int | None):
    """Over rows (key, fp) sorted by key: rows (key, u, v): key null, an edge; v null, a member u of a group larger than most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v, key=None):
            n = len(u)
            return pa.RecordBatch.from_arrays([pa.array(key) if key is not None else pa.nulls(n, pa.int64()), pa.array(u.view(np.int64)), pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64))], ["key", "u", "v"])

        held_k, held_f, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in (*batches, None):
            last = batch is None
            if last:
                k, f = held_k, held_f
            else:
                k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
                f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            cuts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
            tail = len(k) if last else int(cuts[-1])  # the last group may go on
            cuts = cuts[cuts < tail]
            lengths = np.diff(np.append(cuts, tail))
            large = np.zeros(len(cuts), bool) if most is None else lengths > most
            if over is not None:
                large |= k[cuts] == over
            for at, n in zip(cuts[large].tolist(), lengths[large].tolist(), strict=True):
                yield out(f[at : at + n], None, k[at : at + n])
            held_k, held_f = k[tail:], f[tail:]
            if len(held_k) and most is not None and (len(held_k) > most or held_k[0] == over):
                over = int(held_k[0])  # its members are passed on as they come
                yield out(held_f, None, held_k)
                held_k, held_f = held_k[:0], held_f[:0]
            two = cuts[(lengths == 2) & ~large]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= MOST_BITS]
            us, vs = [np.maximum(f[two], f[two + 1])], [np.minimum(f[two], f[two + 1])]
            more = (lengths > 2) & ~large
            for at, n in zip(cuts[more].tolist(), lengths[more].tolist(), strict=True):
                u, v = _forest(f[at : at + n])
                us.append(u), vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                pair = np.unique(np.stack([u, v], 1), axis=0)
                yield out(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))

    return run


def links(fps: DataFrame, most: int = 2000) -> DataFrame:
    """fps: distinct (fp). Edges (u, v) whose components are those of all pairs that differ in at most three bits."""
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c")).select(
        F.expr("shiftleft(cast(c as bigint), 32) | (shiftrightunsigned(fp, 32 * shiftright(c, 5)) & 4294967295L & ~shiftleft(1L, c & 31))").alias("key"), "fp"
    )
    schema = "key long, u long, v long"

    def dealt(rows: DataFrame, cap: int | None) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(cap), schema)

    first = stash(dealt(keyed, most))
    again = (  # c >> 37: the segment that the key is of; the halves of the other one, 2 x 16 variants
        first.where("v is null")
        .select("key", F.col("u").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("c"))
        .withColumn("half", F.expr("shiftrightunsigned(fp, 32 * (1 - cast(shiftright(key, 37) as int)) + 16 * shiftright(c, 4)) & 65535L & ~shiftleft(1L, c & 15)"))
        .select(F.xxhash64("key", "c", "half").alias("key"), "fp")
    )
    return first.where("v is not null").select("u", "v").union(dealt(again, None).select("u", "v")).distinct()


def _sketched(size: int):
    """Rows (doc_id, r, text): c names a text's fingerprint and set of shingles, n is the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in rows_of(batches, 4 << 20):
            fps, cs, ns, bands = [], [], [], []
            for x in batch.column(2):
                h = shingle_hashes(x.as_py(), size)
                fps.append(folded(h))
                h = np.unique(h)
                cs.append(xxhash.xxh64_intdigest(h.tobytes(), fps[-1]))
                ns.append(len(h))
                bands.append(sketch(h)[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(cs, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "r", "fp", "c", "n", "bands"],
            )

    return run


#: Members of a band whose sketches are compared, all with all, in one go.
MOST_BAND = 8192


def plausible(filled: np.ndarray, bits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets whose sketches don't rule out a similarity of ``least``: at that similarity a bit agrees with probability p = (1 + least) / 2, and a pair is ruled out if it falls short
    of that by more than six standard deviations, of as few independent bits as the emptier set has (half of its full bins, since lent ones repeat)."""
    p = (1 + least) / 2
    own = np.where(filled == BINS, SKETCH_BITS, np.minimum(filled, SKETCH_BITS) / 2)
    need = p - 6 * np.sqrt(p * (1 - p) / own)
    us, vs = [], []
    for at in range(0, len(filled), 512):
        unlike = np.bitwise_count(bits[at : at + 512, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64)
        i, j = np.nonzero(1 - unlike / SKETCH_BITS >= np.minimum(need[at : at + 512, None], need[None, :]))
        i += at
        us.append(i[i < j]), vs.append(j[i < j])
    return np.concatenate(us), np.concatenate(vs)


def _stars(least: float):
    """Over rows (band, c, filled, b0, b1) in order: edges that join the members of a band whose sketches may be alike, over others of the band too. Of a band beyond MOST_BAND members
    all are joined; what isn't alike is parted when whole sets are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, first = np.empty((0, 5), np.int64), None, 0
        for batch in (*batches, None):
            last = batch is None
            rows = held if last else np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], 1)])
            if not len(rows):
                continue
            cuts = np.nonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))[0]
            tail = len(rows) if last else int(cuts[-1])  # the last band may go on
            us, vs = [], []
            if over is not None and rows[0, 0] == over:
                n = int(cuts[1]) if len(cuts) > 1 else len(rows)
                us.append(rows[:n, 1]), vs.append(np.full(n, first))
                cuts, tail = cuts[1:], max(tail, n)
            cuts = cuts[cuts < tail]
            lengths = np.diff(np.append(cuts, tail))
            two = cuts[lengths == 2]
            if len(two):
                p = (1 + least) / 2
                full = np.minimum(rows[two, 2], rows[two + 1, 2])
                own = np.where(full == BINS, SKETCH_BITS, np.minimum(full, SKETCH_BITS) / 2)
                unlike = np.bitwise_count((rows[two, 3:] ^ rows[two + 1, 3:]).view(np.uint64)).sum(1, dtype=np.int64)
                good = two[1 - unlike / SKETCH_BITS >= p - 6 * np.sqrt(p * (1 - p) / own)]
                us.append(rows[good + 1, 1]), vs.append(rows[good, 1])
            for at, n in zip(cuts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                own_rows = rows[at : at + n]
                if n > MOST_BAND:
                    us.append(own_rows[1:, 1]), vs.append(np.full(n - 1, own_rows[0, 1]))
                    continue
                i, j = plausible(own_rows[:, 2], own_rows[:, 3:].view(np.uint64), least)
                label = _merged(np.arange(n), i, j) if len(i) else np.arange(n)
                while (label[label] != label).any():
                    label = label[label]
                moved = np.nonzero(label != np.arange(n))[0]
                us.append(own_rows[moved, 1]), vs.append(own_rows[label[moved], 1])
            held = rows[tail:]
            if len(held) > MOST_BAND:  # its members are joined as they come
                over, first = int(held[0, 0]), int(held[0, 1])
                us.append(held[1:, 1]), vs.append(np.full(len(held) - 1, first))
                held = held[:0]
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
            if len(u):
                pair = np.unique(np.stack([u, v], 1)[u != v], axis=0)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in (0, 1)], ["u", "v"])

    return run


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets, each sorted and without repeats, whose Jaccard similarity is ``least`` or more."""
    m = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begins = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    having = np.diff(np.append(begins, len(flat)))
    common = np.zeros(m * m, np.int64)
    for d in np.unique(having[(having > 1) & (having <= 48)]).tolist():  # what few sets have: by pairs
        at, (x, y) = begins[having == d], np.triu_indices(d, 1)
        step = max(1, (1 << 21) // len(x))
        for k in range(0, len(at), step):
            of = row[at[k : k + step, None] + np.arange(d)]
            common += np.bincount((of[:, x] * np.int64(m) + of[:, y]).ravel(), minlength=m * m)
    common = common.reshape(m, m)
    many, lengths = begins[having > 48], having[having > 48]
    for k in range(0, len(many), 2048):  # what many have: by products of 0-1 matrices
        d = lengths[k : k + 2048]
        within = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)
        has = np.zeros((m, len(d)), np.float32)
        has[row[np.repeat(many[k : k + 2048], d) + within], np.repeat(np.arange(len(d)), d)] = 1
        common += np.rint(has @ has.T).astype(np.int64)
    linked = (common >= least * (n[:, None] + n[None, :] - common)) & (common > 0)
    return np.nonzero(np.triu(linked, 1))


def _compared(least: float):
    """Over rows (cell, c, fp, hashes) sorted by cell: edges (u, v) between fingerprints that join what links within a cell."""

    def links_of(held: dict[int, tuple[int, bytes]]) -> set[tuple[int, int]]:
        if len(held) < 2:
            return set()
        fps = [x[0] for x in held.values()]
        i, j = alike([np.frombuffer(x[1], np.uint64) for x in held.values()], least)
        label = _merged(np.arange(len(fps)), i, j) if len(i) else np.arange(len(fps))
        while (label[label] != label).any():
            label = label[label]
        return {(fps[a], fps[b]) for a, b in enumerate(label.tolist()) if fps[a] != fps[b]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            found = set()
            for at, c, fp, h in zip(*(batch.column(k) for k in range(4)), strict=True):
                if (at := at.as_py()) != cell:
                    found |= links_of(held)
                    cell, held = at, {}
                if (c := c.as_py()) not in held:
                    held[c] = fp.as_py(), h.as_py()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
        if found := links_of(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return run


SALTS = 64


def cells(members: DataFrame, least: float, most: int, most_hashes: int) -> DataFrame:
    """members: (root, c, n, ...). The same with a cell: all pairs of one root whose sizes allow a similarity of ``least`` meet in a cell.
    A root with more than ``most`` members, or hashes, is dealt by sizes first, and then by pairs of blocks. Sums are added up before they are
    shuffled, and only those of large roots meet members again, by root and a salt: no task gets all members of one."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sums = F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes")
    fits = (F.col("rows") <= most) & (F.col("hashes") <= most_hashes)
    large = members.groupBy("root").agg(*sums).where(~fits).select("root", F.lit(True).alias("large"), salts)
    own = members.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(large, ["root", "salt"], "left")
    whole = own.where("large is null").withColumn("cell", F.xxhash64("root"))
    step = -math.log(least) * 1.0001  # sizes of a ratio of least are one class apart at most
    sized = own.where("large").withColumn("s", F.floor(F.log("n") / step)).withColumn("s", F.explode(F.array("s", F.col("s") + 1)))
    blocks = F.ceil(F.greatest(2 * F.col("rows") / most, 2 * F.col("hashes") / most_hashes)).cast("int")
    dealt = sized.join(sized.groupBy("root", "s").agg(*sums).select("*", salts), ["root", "s", "salt"])
    dealt = dealt.withColumn("blocks", F.when(fits, 1).otherwise(blocks)).withColumn("a", F.pmod(F.xxhash64("c", F.lit(1)), "blocks"))
    dealt = dealt.withColumn("b", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("cell", F.xxhash64("root", "s", F.least("a", "b"), F.greatest("a", "b")))
    names = [*members.columns, "cell"]
    return whole.select(*names).union(dealt.select(*names))


TABLE_BITS = 1 << 24


def _wanted_sets(size: int, table: np.ndarray):
    """Over rows (r, text): r and the set of shingles, of those that the bit table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows repeated whole
        for batch in rows_of(batches, 4 << 20):
            r = batch.column(0).to_numpy(zero_copy_only=False)
            keep = []
            for k in np.nonzero(in_table(table, r))[0].tolist():
                if (x := int(r[k])) not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(x)
                    keep.append(k)
            made = [np.unique(shingle_hashes(batch.column(1)[k].as_py(), size)).tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array(r[keep]), pa.array(made, pa.binary())], ["r", "hashes"])

    return run


def similar_links(docs: DataFrame, marked: DataFrame, size: int, least: float, most: int = 2048, most_hashes: int = 2 << 20) -> DataFrame:
    """docs: (doc_id, r, text); marked: (r, fp, c, n, bands). Edges (u, v) between fingerprints whose components are those of all pairs of
    texts that share a band and whose sets of shingles have a Jaccard similarity of ``least`` or more. Bands, and the sketches of those that share one, only say what is compared:
    texts that they join, over others too, are compared by their whole sets, all with all that their sizes allow."""
    once = marked.where("n > 0").select("c", "bands").dropDuplicates(["c"])
    rows = once.select(F.explode(F.slice("bands", 4, BANDS)).alias("band"), "c", *(F.get("bands", F.lit(k)).alias(x) for k, x in enumerate(("filled", "b0", "b1"))))
    edges = rows.repartition("band").sortWithinPartitions("band", "c").mapInArrow(_stars(least), "u long, v long")
    roots = components(edges)
    members = roots.select(F.col("u").alias("c"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct())
    classes = marked.groupBy("c", "fp", "n").agg(F.min("r").alias("r"))
    members = stash(members.join(classes, "c"))
    table = bit_table(members, F.col("r"), TABLE_BITS)
    sets = docs.select("r", "text").mapInArrow(_wanted_sets(size, table), "r long, hashes binary")
    dealt = cells(members, least, most, most_hashes).join(sets, "r").select("cell", "c", "fp", "hashes")
    return stash(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compared(least), "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = 3, similar: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, r, fp) of each row (r: a hash of doc_id and text), and (fp, root, component_id) of each distinct fingerprint; both in the shared folder.
    similar: texts also link if their sets of shingles have so large a Jaccard similarity."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r"), "text")
    if similar is None:
        marked = stash(with_fingerprint(docs, size, "fp").select("doc_id", "r", "fp"))
    else:
        marked = stash(docs.mapInArrow(_sketched(size), "doc_id long, r long, fp long, c long, n long, bands array<long>"))
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(classes.select("fp"))
    if similar is not None:
        edges = edges.union(similar_links(docs, marked, size, similar))
        marked = marked.select("doc_id", "r", "fp")
    roots = components(edges)
    rooted = stash(classes.join(roots, classes.fp == roots.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root")), [classes, roots])
    names = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return marked, stash(rooted.join(names, "root").select("fp", "root", "component_id"), [rooted, names])


def op7(docs: DataFrame) -> DataFrame:
    marked, classes = near_duplicates(docs)
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, similar: float = 0.8) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays (null ids come last; of unlike texts with one doc_id
    the one with the least hash, of repeated rows the one whose columns have the least hash). Shingles have five words here, and beside fingerprints
    within three bits texts link from a similarity of 0.8: a few changed words move a fingerprint further than three bits. Null and blank texts
    are copies of each other. Shingles are hashed once for all rows, and once more for those that have something to be compared with."""
    marked, classes = near_duplicates(docs, size, similar)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r"))
    # one row a fingerprint before the join, so no fingerprint's many rows meet there
    least = marked.groupBy("fp").agg(first.alias("x")).join(classes, "fp").groupBy("root").agg(F.min("x").alias("x"))
    stays = stash(least.select(F.col("x.r").alias("__simhash_r"), F.col("x.doc_id").alias("__simhash_id")), [classes])
    rows = docs.select(F.xxhash64("doc_id", "text").alias("__simhash_r"), F.struct(*docs.columns).alias("__simhash_row"), F.xxhash64(*docs.columns).alias("__simhash_h"))
    kept = rows.join(stays, "__simhash_r").where(F.col("__simhash_row.doc_id").eqNullSafe(F.col("__simhash_id")))
    return kept.groupBy("__simhash_r").agg(F.min_by("__simhash_row", "__simhash_h").alias("row")).select("row.*")
