"""Language proportions of a text by expectation-maximisation over byte trigrams.

Each language learned is a distribution over TABLE hashed byte trigrams, with additive smoothing, fitted
on a sample of about PER_LANGUAGE documents of it (all, where there are fewer): those whose hash of doc_id is
below a bound that the language's count sets. A text is cut into pieces of PIECE bytes; under proportions pi
a piece has the likelihood sum_k pi_k p_k(piece). Expectation-maximisation gives pi, for all languages where there are KEPT at
most; else for the text's KEPT strongest by its pieces' posteriors, doubled as long as the penalised likelihood gains by it, up to all. Only a text's posteriors are computed for all
languages, in tiles of TILE entries, so cost and memory grow in proportion to the languages learned. Then the weakest language is struck out as long as the likelihood falls by less than the penalty that the
language costs (half the logarithm of the number of pieces, and PENALTY). The largest proportion is the prediction.

The table of all languages has MOST_ENTRIES at most (16 MB, broadcast): where there are more languages than that allows at full width,
it has fewer entries a language, half each time; more than MOST_LANGUAGES values of lang are an error.

Null text or no letter: und, score 0. No language learned: und. Ties: the language first by name. Empty table: an empty result. Repeated
rows: learned from each, the same result each; several texts of one doc_id are learned from or held out together. Null doc_id: not
learned from, not held out. Very long texts: whole, all their pieces in one fit. Columns with the names made here aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import rows_of, utf8

TABLE = 1 << 16
MOST_ENTRIES = 1 << 22
MOST_LANGUAGES = 4096
PER_LANGUAGE = 2000
PIECE = 64
ROUNDS = 10
PENALTY = 2.0
KEPT = 8
TILE = 1 << 21
SLICE_BYTES = 2 << 20

_lower = np.arange(256, dtype=np.uint32)
_lower[0x41:0x5B] += 32
_lower[[9, 10, 11, 12, 13]] = 32
_letter = np.zeros(256, bool)
_letter[0x41:0x5B] = _letter[0x61:0x7B] = True


def trigrams(raw: np.ndarray, offsets: np.ndarray, width: int = TABLE) -> np.ndarray:
    """Below width, at each byte the hash of it, the one before and the one after; spaces beyond a text's ends."""
    low = _lower[raw]
    before, after = np.roll(low, 1), np.roll(low, -1)
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = 32
    after[offsets[1:][full] - 1] = 32
    return ((before << 16 | low << 8 | after) * np.uint32(2654435761)) >> np.uint32(33 - width.bit_length())


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_letter[raw])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.nonzero(~out & (offsets[1:] > offsets[:-1]))[0].tolist():
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode())
    return out


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithms of their trigrams' probabilities."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).select("doc_id", "lang", "text")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.limit(MOST_LANGUAGES + 1).collect()}
    names = sorted(counts)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not names:
        return [], np.zeros((0, TABLE), np.float32)
    width = TABLE
    while width * len(names) > MOST_ENTRIES:
        width //= 2
    bounds = known.sparkSession.createDataFrame([(k, min(1 << 20, -(-(per_language << 20) // n))) for k, n in counts.items()], "lang string, bound long")  # a row a language
    sample = known.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), width), np.int64)
        for batch in rows_of(batches, SLICE_BYTES):
            raw, offsets = utf8(batch.column(1))
            grams = trigrams(raw, offsets, width)
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                which = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                total[names.index(lang)] += np.bincount(grams[which], minlength=width)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(total[lang, gram])], ["k", "gram", "n"])

    rows = sample.select("lang", "text").mapInArrow(run, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(names), width), 0.5)
    table[rows["k"].to_numpy(int), rows["gram"].to_numpy(int)] += rows["n"].to_numpy(float)
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, begin: np.ndarray, of: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """p: pieces x languages. Proportions of each text from those given, and the logarithm of its likelihood."""
    many = np.diff(np.append(begin, len(p)))[:, None]
    for _ in range(rounds):
        part = pi[of] * p
        part /= part.sum(1, keepdims=True)
        pi = np.add.reduceat(part, begin) / many
    return pi, np.add.reduceat(np.log((pi[of] * p).sum(1)), begin)


def _struck(p: np.ndarray, begin: np.ndarray, of: np.ndarray, pieces: np.ndarray, pi: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Each text's weakest language, of several the last by name, goes, one after the other, as long as the penalised likelihood gains by it."""
    going = np.ones(len(pi), bool)
    for _ in range(p.shape[1] - 1):
        weakest = pi.shape[1] - 1 - np.where(pi > 0, pi, np.inf)[:, ::-1].argmin(1)
        fewer = pi.copy()
        fewer[np.arange(len(pi)), weakest] = 0
        rest = fewer.sum(1)
        going &= rest > 1e-12
        fewer[going] /= rest[going, None]
        fewer[~going] = pi[~going]
        fewer, less = _fit(np.maximum(p, 1e-300), begin, of, fewer, ROUNDS // 2)
        going &= likely - less < _cost(pieces)
        pi[going], likely[going] = fewer[going], less[going]
    return pi


def _cost(pieces: np.ndarray) -> np.ndarray:
    return 0.5 * np.log(pieces) + PENALTY


def _strongest(grams: np.ndarray, at: np.ndarray, of: np.ndarray, texts: int, table: np.ndarray) -> np.ndarray:
    """Texts x languages: each text's languages from the strongest on, by its pieces' posteriors under equal proportions; ties by name. Pieces come in tiles of TILE entries."""
    share, step = np.zeros((texts, len(table))), max(1, TILE // len(table))
    for a in range(0, len(at), step):
        own = at[a : a + step]
        low, high = own[0], at[a + step] if a + step < len(at) else len(grams)
        logs = np.stack([np.add.reduceat(row[grams[low:high]], own - low) for row in table], 1)
        part = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -80))
        part /= part.sum(1, keepdims=True)
        text = of[a : a + step]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        share[text[first]] += np.add.reduceat(part, first)
    return np.argsort(-share, axis=1, kind="stable")


def _mixtures(grams: np.ndarray, size: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their languages, proportions) of texts of so many grams, in groups of one width. Where there are more than KEPT languages, a text starts with its KEPT strongest;
    they are doubled as long as the penalised likelihood gains by it, up to all."""
    pieces = -(-size // PIECE)
    which, k = np.arange(len(size)), len(table)
    of = np.repeat(which, pieces)
    at = np.repeat(np.cumsum(size) - size, pieces) + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    order = _strongest(grams, at, of, len(size), table) if k > KEPT else None
    length = np.diff(np.append(at, len(grams)))

    def fitted(which: np.ndarray, width: int):
        begin = np.cumsum(pieces[which]) - pieces[which]
        own = np.repeat(np.arange(len(which)), pieces[which])
        if width == k:
            kept = np.broadcast_to(np.arange(k), (len(which), k))
        else:
            kept = np.sort(order[which, :width], 1)
        mine = np.isin(of, which)
        here = grams if mine.all() else grams[np.repeat(mine, length)]
        start = np.cumsum(length[mine]) - length[mine]
        if width == k:
            logs = np.stack([np.add.reduceat(row[here], start) for row in table], 1).astype(np.float64)
        else:
            text = np.repeat(own, length[mine])
            logs = np.stack([np.add.reduceat(table[kept[text, j], here], start) for j in range(width)], 1).astype(np.float64)
        top = logs.max(1, keepdims=True)
        p = np.exp(np.maximum(logs - top, -500))
        pi, likely = _fit(p, begin, own, np.full((len(which), width), 1 / width), ROUNDS)
        return kept, p, begin, own, pi, likely, np.add.reduceat(top[:, 0], begin)

    width = min(KEPT, k)
    kept, p, begin, own, pi, likely, base = fitted(which, width)
    while True:
        wide = fitted(which, min(2 * width, k)) if width < k else None
        gain = wide is not None and wide[5] + wide[6] - likely - base >= (min(2 * width, k) - width) * _cost(pieces[which])
        done = np.flatnonzero(~np.broadcast_to(gain, len(which)))
        if len(done):
            rows = np.isin(own, done)
            many = pieces[which[done]]
            yield which[done], kept[done], _struck(p[rows], np.cumsum(many) - many, np.repeat(np.arange(len(done)), many), many, pi[done], likely[done])
        if len(done) == len(which):
            return
        which, width = which[gain], min(2 * width, k)
        kept, p, begin, own, pi, likely, base = fitted(which, width) if len(done) else wide


def mixtures(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their languages, proportions) of texts, none empty, in groups; languages that aren't there are 0. Texts go in blocks of TILE entries of pieces and languages, a text that alone has more by itself."""
    grams, size = trigrams(raw, offsets, table.shape[1]), np.diff(offsets)
    reached = np.cumsum(-(-size // PIECE))
    a, most = 0, max(1, TILE // len(table))
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(reached, (reached[a - 1] if a else 0) + most, "right")))
        for which, kept, pi in _mixtures(grams[offsets[a] - offsets[0] : offsets[b] - offsets[0]], size[a:b], table):
            yield which + a, kept, pi
        a = b


def proportions(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts (none empty) x languages; 0: not in the set selected."""
    every = np.zeros((len(offsets) - 1, len(table)))
    for which, kept, pi in mixtures(raw, offsets, table):
        every[which[:, None], kept] = pi
    return every


def op9(docs: DataFrame) -> DataFrame:
    names, table = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    known = np.array(names, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SLICE_BYTES):
            raw, offsets = utf8(batch.column(2))
            which = np.nonzero(has_letter(raw, offsets))[0] if names else np.empty(0, int)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if len(which):
                own = np.repeat(np.isin(np.arange(batch.num_rows), which), np.diff(offsets))
                for at, kept, pi in mixtures(raw[own], np.concatenate([[0], np.cumsum(np.diff(offsets)[which])]), shared.value):
                    best = pi.argmax(1)  # languages stand in order of their names
                    lang[which[at]], score[which[at]] = known[kept[np.arange(len(at)), best]], np.minimum(pi.max(1), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
