import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import packing
from spanloom.llm.common import stash

PATH = public_tokenizers.path("word_bpe_49k.json")


def fixture():
    r = random.Random(4)
    words = ["The", "a\x01b", "\x01", "\x01x", "hérè", "ñandú's", "x", "12", "a-b", "don't", "Ω", "ΣΑΣ", "é", "́x", " ", "日本語", "🙂", "q" * 40]
    rows = [(k, r.choice([" ", "\n", " \t "]).join(r.choices(words, k=r.choice([0, 1, 5, 300, 700])))) for k in range(60)]
    return rows + [(None, "x y"), (3, rows[3][1]), (3, rows[3][1]), (70, None), (71, ""), (72, " \n"), (73, "word " * 9000)]


def test_round_trip(spark):
    rows = fixture()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted([(d is None, d or 0), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]] for d, t in rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    encoded = stash(packing.encode(docs, PATH, with_ids=True))
    packed = packing.pack(encoded, group_docs=20)
    bins, got = defaultdict(list), defaultdict(list)
    for x in packed.collect():
        bins[x.sequence_id].append((x.offset, x.length))
        got[x.doc_id, x.row, x.doc_tokens].append((x.start, x.length, x.ids_crc32))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    made = sorted(str([(d is None, d or 0), n, sorted(p)]) for (d, _, n), p in got.items())
    pieces = lambda ids: [(k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert made == sorted(str([d, len(ids), pieces(ids)]) for d, ids in want)
    total = sum(len(ids) for _, ids in want)
    flat = packing.sequences(encoded, packed).collect()
    assert sum(x.filled for x in flat) == total
    assert all(len(x.ids) == 4 * (x.filled if x.filled & (x.filled - 1) == 0 else 2048) for x in flat)
    assert {c for x in packed.collect() for c in [x.ids_crc32]} == {zlib.crc32(bytes(x.ids)[4 * o : 4 * (o + n)]) for x in flat for o, n in bins[x.sequence_id]}


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 300)
    bins, at = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for k in sorted(range(300), key=lambda k: -sizes[k]):
        b = next((b for b, x in enumerate(room) if x >= sizes[k]), None)
        if b is None:
            b = len(room)
            room.append(100)
        want[k] = (b, 100 - room[b])
        room[b] -= sizes[k]
    assert [want[k] for k in range(300)] == list(zip(bins.tolist(), at.tolist()))


def test_ties_of_sizes():
    """Rests of one length are placed in their order, each in the first sequence with room."""
    bins, at = packing.first_fit_decreasing(np.array([40, 60, 40, 60, 40, 20, 20]), 100)
    assert list(zip(bins.tolist(), at.tolist())) == [(0, 60), (0, 0), (1, 60), (1, 0), (2, 0), (2, 40), (2, 60)]


def test_forgotten_words(monkeypatch):
    """A cache that overflows all the time gives the same ids."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED_WORDS", 30)
    encoder, tokenizer, r = packing.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(9)
    for _ in range(60):
        texts = [" ".join("".join(r.choices("abcé1.'", k=r.choice([1, 2, 3]))) for _ in range(r.randrange(30))) for _ in range(4)] + [None]
        stream, offsets = encoder(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
            assert stream[a:b].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def thue_morse(n, swap=False):
    """Words on which polynomial hashes modulo 2 ** 64 collide with those of their complements, whatever the factor."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_made_to_collide(n):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    one, other = thue_morse(n), thue_morse(n, True)
    for batches in ([[one, other]], [[one], [other]], [[f"{other} {one}"], [f"x {one}"]]):
        encoder = packing.Encoder(PATH)
        for texts in batches:
            stream, offsets = encoder(pa.array(texts, pa.string()))
            for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
                assert stream[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = packing.op5(docs, PATH).groupBy("sequence_id").sum("length").collect()
    used = sum(x[1] for x in packed)
    size = sum(x[1] if x[1] & (x[1] - 1) == 0 else 2048 for x in packed)
    assert used > 0.98 * size


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.op5(docs, PATH).collect() == []
