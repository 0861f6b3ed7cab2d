import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import pii, simhash
from tests.llm import test_decontam, test_pii, test_quality

DIR = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    """run() over the smallest tables: no cutoff can be certified and no term disclosed there, so each stage is plain."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t) for d, t in docs if not test_quality.brute(t)[-1]]
    fps = {d: simhash.fingerprint(t, 5) for d, t in docs}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in docs}
    alike = lambda d, e: len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in fps:
        for e in fps:
            if e < d and ((fps[d] ^ fps[e]).bit_count() <= 3 or alike(d, e)):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    docs = [(d, t) for d, t in docs if find(d) == d]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for i, t in items:
        w = test_decontam.words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] = i
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        found = list(test_decontam.WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), t)))
        w, hit = test_decontam.words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        for k in sorted(hit, reverse=True):
            end = found[k].end() if k + 1 not in hit else found[k + 1].start()
            t = t[: found[k].start()] + t[end:]
        t = pii.cleaned(t, test_pii.brute(t))
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((d, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, DIR).collect()
    unlike = sorted({tuple(x)[:5] for x in got} ^ set(want))
    assert not unlike[:5] and len(got) == len(want)
    fill = {}
    for x in got:
        fill[x.sequence_id] = fill.get(x.sequence_id, 0) + x.length
    assert max(fill.values()) <= 2048


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "personal_data", "sequence_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing_and_of_nulls(spark, k):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, DIR).collect() == []
    none = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, "x " * 60, None, None, None)], docs.schema)
    assert len(corpus_pipeline.STAGES[k][1](spark, none, DIR).collect()) == (0, 2, 3, 3, 3)[k]


def test_methods_take_effect(spark, tmp_path):
    """A planted corpus on which cutoffs certify and a term discloses: what the two stages do is seen in what the whole run keeps and packs."""
    rows, labels = test_quality.planted(4000, 9)
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    rows = [(d, t + (f"\n{word()} Quillfeather {word()} joe.q@example.org {word()}" if d % 40 == 0 else ""), lang, "web", len(t)) for d, t, lang in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cut = test_quality.brute_cutoffs([r[:3] for r in rows], labels)
    assert cut
    want = {}
    for d, t, lang, *_ in rows:
        n, chars, symbols, dups, repeats, failed = test_quality.brute(t)
        lines, capitals = len(t.split("\n")), len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
        beyond = {"symbols": 1000 * symbols // chars, "dup_lines": 1000 * dups // lines, "repeats": 1000 * repeats // n, "capitals": 1000 * capitals // chars}
        if not failed and not any(v > cut.get((lang, rule), 10**9) for rule, v in beyond.items()):
            want[d] = re.sub("Quillfeather", "", pii.cleaned(t, test_pii.brute(t)))
    fps = {d: simhash.fingerprint(t, 5) for d, t, *_ in rows if d in want}
    assert len(set(fps.values())) == len(fps)  # no copies here
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = {d: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in want.items()}
    assert {x.doc_id: x.ids_crc32 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == crc
    assert len(want) < 0.97 * sum(not test_quality.brute(t)[-1] for _, t, *_ in rows)
