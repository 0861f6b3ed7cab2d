import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import suffix_dedup


def brute(rows):
    """By all windows of the documents in order; rows that repeat are one document."""
    import xxhash

    def key(r):
        tie = xxhash.xxh64_intdigest(r[1], 42)
        return (r[0] is None, r[0] or 0, tie - 2**64 if tie >= 2**63 else tie)

    first, out = {}, []
    rows = [(d, (t or "").encode()) for d, t in rows]
    for r in sorted(rows, key=key):
        for a in range(len(r[1]) - 99):
            first.setdefault(r[1][a : a + 100], (key(r), a))
    for r in rows:
        gone = bytearray(len(r[1]))
        for a in range(len(r[1]) - 99):
            if first[r[1][a : a + 100]] != (key(r), a):
                gone[a : a + 100] = b"\1" * 100
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(r[1], gone) if not g)
        out.append((r[0] is None, r[0] or 0, len(r[1]), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture(seed, n=60):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdé 日") for _ in range(n))
    passages = [say(r.choice([60, 99, 100, 130, 400])) for _ in range(8)]
    rows = []
    for k in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            text = r.choice(rows)[1] or ""
        elif kind < 0.5 and rows:
            text = r.choice(rows)[1] or "x"
            a = r.randrange(len(text) + 1)
            text = text[:a] + say(1) + text[a + 1 :]
        else:
            text = "".join(say(r.choice([0, 1, 30, 200])) + r.choice([*passages, ""]) for _ in range(r.choice([0, 1, 2, 4])))
        rows.append((k, text))
    r.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    return rows + [(None, passages[4] + "q"), (None, None), (3, rows[3][1]), (3, rows[9][1]), (n, None), (n + 1, ""), (n + 2, "the " * 400), (n + 3, "ab" * 300 + "the " * 60), (n + 4, "z" * 500)]


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3), (3, 256), (4, 0)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PARTITION_BYTES", 8000)
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, tie string, start int")
    got = sorted((x.doc_id is None, x.doc_id or 0, *x[1:]) for x in suffix_dedup.op10(docs, hot).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(12))
def test_without_spark(seed, monkeypatch):
    """The steps alone, on many more documents; each blob looked at as it comes for half of the seeds."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 0 if seed % 2 else 1 << 20)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 5000)
    cold = np.zeros(16, np.uint64)
    rows = [(d, t) for d, t in fixture(seed + 10, 150)]
    table = pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    blobs = pa.concat_tables(pa.Table.from_batches([b]) for b in suffix_dedup._cut(3, cold)([table])).sort_by("p")
    found = [x for b in suffix_dedup._compare(cold)(blobs.to_batches()) for x in b.to_pylist()]
    import xxhash

    texts = {}
    for d, t in rows:
        tie = xxhash.xxh64_intdigest(t or "", 42)
        texts[d, tie - 2**64 if tie >= 2**63 else tie] = t or ""
    runs = sorted((x for x in found if x["kind"] == 1), key=lambda x: x["m"])
    spans = {}
    for x in found:
        if x["kind"] == 0:
            spans.setdefault((x["doc_id"], x["tie"]), []).append(x)
    if runs:
        data = [texts[x["doc_id"], x["tie"]].encode()[x["start"] : x["stop"]] for x in runs]
        batch = pa.record_batch([pa.array([x[c] for x in runs], t) for c, t in (("kind", pa.int32()), ("m", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()))] + [pa.array(data, pa.binary())], ["kind", "m", "doc_id", "tie", "start", "lead", "data"])
        for b in suffix_dedup._buckets([batch]):
            for x in b.to_pylist():
                spans.setdefault((x["doc_id"], x["tie"]), []).append(x)
    out = []
    for d, t in rows:
        tie = xxhash.xxh64_intdigest(t or "", 42)
        data, gone = (t or "").encode(), suffix_dedup._union(spans.get((d, tie - 2**64 if tie >= 2**63 else tie)))
        kept, end = b"", 0
        for a, b in gone:
            kept, end = kept + data[end:a], b
        kept += data[end:]
        out.append((d is None, d or 0, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(out) == brute(rows)


def common_passage(n):
    r = random.Random(8)
    say = lambda k: "".join(r.choices("abcdefghij ", k=k))
    passage = say(170)
    return [(k, say(120) + passage + say(120)) for k in range(n)]


def test_one_passage_in_all_documents(spark, monkeypatch):
    """Its anchors are found hot, none of their runs is dealt by bucket, and no task gets more than a part of them."""
    monkeypatch.setattr(suffix_dedup, "PARTITION_BYTES", 20_000)
    rows = common_passage(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    census = docs.select("text").mapInArrow(suffix_dedup._census, "m long, n long, bytes long").groupBy("m").sum("n").where("sum(n) >= 256").collect()
    assert len(census) >= 2
    hot = suffix_dedup.bit_table(spark.createDataFrame([(x.m,) for x in census], "m long"), suffix_dedup.F.col("m"), 1 << 24)
    blobs = docs.mapInArrow(suffix_dedup._cut(32, hot), "p long, blob binary").groupBy("p").agg(suffix_dedup.F.sum(suffix_dedup.F.length("blob")).alias("size")).collect()
    sizes = sorted(x["size"] for x in blobs)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    found = docs.mapInArrow(suffix_dedup._cut(32, hot), "p long, blob binary").repartition(8, "p").sortWithinPartitions("p").mapInArrow(suffix_dedup._compare(hot), suffix_dedup.SPANS)
    assert max((x["count"] for x in found.where("kind = 1").groupBy("m").count().collect()), default=0) < 256 + 4
    got = sorted((x.doc_id is None, x.doc_id or 0, *x[1:]) for x in suffix_dedup.op10(docs).collect())
    assert got == brute(rows)


def test_texts_are_dealt_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = suffix_dedup.op10(docs)
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan


def test_empty(spark):
    assert suffix_dedup.op10(spark.createDataFrame([], "doc_id long, text string")).collect() == []
