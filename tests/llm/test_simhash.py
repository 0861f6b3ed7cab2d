import itertools
import random

import numpy as np
import pytest

from spanloom.llm import simhash


def brute(rows):
    """rows: (doc_id, text). By all pairs of rows."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0), f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def fixture():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        base = r.choices(words, k=r.choice([0, 1, 2, 3, 30, 200, 900]))
        for _ in range(r.choice([1, 2, 5])):
            copy = list(base)
            if copy and r.random() < 0.6:
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(None, None), (None, "only this"), (7, rows[7][1]), (n, None), (n + 1, ""), (n + 2, " \n\t ")]
    return rows


def test_against_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.fingerprint, x.component_id) for x in simhash.op7(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("most", [2, 5, 2000])
def test_large_groups_lose_no_link(spark, most):
    r = np.random.default_rng(5)
    base = int(r.integers(0, 2**63))
    fps = {base}
    for _ in range(150):
        x = base
        for b in r.integers(0, 64, r.integers(0, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in r.integers(0, 2**63, 50)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    from spanloom.llm.components import components

    got = {x.u: x.v for x in components(simhash.links(spark.createDataFrame(signed, "fp long"), most)).collect()}
    flat = sorted(x for (x,) in signed)
    root = {x: x for x in flat}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(flat):
        for y in flat[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert {x: find(x) for x in flat if find(x) != x} == got


def test_keep_one(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, simhash int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [x.text for x in kept.collect()]
    assert len(texts) == len(set(texts)) and len(texts) < len(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.op7(docs).collect() == [] and simhash.keep_one(docs).collect() == []


def test_keep_one_catches_copies_with_changed_words(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rows, groups = [], 60
    for g in range(groups):
        base = r.choices(words, k=r.choice([60, 150, 400]))
        for c in range(1 + g % 4):
            copy = list(base)
            for _ in range(len(copy) // 60 if c else 0):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int")
    kept = simhash.keep_one(docs).collect()
    assert {x.g for x in kept} == set(range(groups))  # none is lost whole
    assert len(kept) <= groups + 3


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    for n in (50, 300, 5000):
        a = r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n * 8 // 9], r.integers(0, 2**63, n - n * 8 // 9).astype(np.uint64) * np.uint64(2)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(simhash.similarity(simhash.sketch(a)[0], simhash.sketch(b)[0]) - j) < 0.12


def edited(r, base, share, fresh):
    """base with about so large a share of its five-word shingles broken by words that no other text has."""
    copy = list(base)
    for k in r.sample(range(len(base)), round(len(base) * share / 5)):
        copy[k] = f"n{next(fresh)}"
    return copy


def test_keep_one_links_by_exact_similarity(spark):
    """Templated texts of a similarity below 0.8 all stay; of pairs above 0.8 within a family, whose members are less alike, one goes each."""
    r, fresh = random.Random(4), itertools.count()
    rows = []
    near = [r.choice([f"w{i}" for i in range(3000)]) for _ in range(400)]
    for _ in range(150):  # pairwise 0.7 to 0.8
        rows.append((len(rows), " ".join(edited(r, near, 0.125, fresh))))
    far = [r.choice([f"v{i}" for i in range(3000)]) for _ in range(300)]
    for _ in range(100):  # pairs of 0.8 and a little more within a family of about 0.65
        base = edited(r, far, 0.2, fresh)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited(r, base, 0.1, fresh)))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(rows)) if find(i) == i}
    got = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) < len(rows) - 40


@pytest.mark.parametrize("most", [8, 2048])
def test_large_bands_lose_no_pair(spark, most):
    """Pairs of 0.85 in a family of about 0.68, whole or dealt by sizes and blocks: each is found."""
    r, fresh = random.Random(6), itertools.count()
    far = [r.choice([f"v{i}" for i in range(3000)]) for _ in range(400)]
    texts = []
    for _ in range(120):
        base = edited(r, far, 0.18, fresh)
        texts += [" ".join(base), " ".join(edited(r, base, 0.08, fresh))]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id, text) r", "text")
    marked = docs.mapInArrow(simhash._sketched(5), "doc_id long, r long, fp long, c long, n long, bands array<long>")
    got = {frozenset((x.u, x.v)) for x in simhash.similar_links(docs, marked, 5, 0.8, most).collect()}
    i, j = simhash.alike(sets, 0.8)
    brute = {(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == brute and len(brute) >= 100
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    assert got == {frozenset((signed[a], signed[b])) for a, b in brute}


def test_each_set_of_one_fingerprint_links(spark):
    """A run of one word decides two texts' fingerprint; each has its own near copy, which has another fingerprint."""
    parts = [" ".join(f"{x}{i}" for i in range(70)) for x in "pq"]
    texts = [f"{'run ' * 300}{x}" for x in parts] + parts
    assert len({simhash.fingerprint(t, 5) for t in texts}) == 3
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [x.doc_id for x in got] == [0]
