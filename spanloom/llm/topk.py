"""Exact top-k search by inner product, over segment statistics from coarse to fine.

Each vector is cut into segments, and a segment of length L with mean m and deviation s is held as sqrt(L) (m, s). The squared distance
of two such summaries is at most that of the vectors, and a summary has its vector's norm, so the product of two summaries is at least
that of the vectors (score = (|q|^2 + |x|^2 - distance^2) / 2). A few candidates with the greatest coarse bounds are scored
first; whose bound is below the k-th score found so far, by four segments and then by sixteen, can't be among the best, and what is left is scored exactly.

Queries in blocks against candidates in blocks: a cell holds a block of queries and sees a block of candidates as slices that go by, so
memory is bounded at any size; each cell gives at most k rows a query, which are merged by query. Blocks are drawn by a row number written with
the rows, so equal vectors, equal ids and null ids are spread like all others.

Vectors that are null, or hold a null or non-finite component, take no part. Shorter vectors count as ending in zeros; an empty one
scores 0. Rows with the query's own id aren't its candidates. Ties: smaller id first, null ids last. A query given twice is answered twice.
Scores are exact: in doubles where all sums fit in 53 bits, by whole numbers of any size elsewhere, held at the ends of a long's range. Other columns aren't
read. Empty table, or no queries: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import stash

SEGMENTS = (4, 16)
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Queries that meet a slice of candidates at once: a few matrices of TILE x CANDIDATE_BLOCK doubles are held.
TILE = 256
#: Candidates that are scored first, as a multiple of k.
FIRST = 4
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
NO_ID = np.iinfo(np.int64).max


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(L) (mean, deviation) of each segment."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(np.int64)
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    off = x - np.repeat(mean, lengths, axis=1)
    deviation = np.sqrt(np.add.reduceat(off * off, edges[:-1], axis=1) / lengths)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([lengths, lengths]))


def products(q: np.ndarray, x: np.ndarray, reach: float) -> np.ndarray:
    """The exact inner products of rows of whole numbers, as longs; reach: no sum is greater."""
    if reach < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True))
    return np.array([max(-LONG, min(LONG, s)) for s in sums], np.int64)


class Best:
    """The k best of each of some queries so far, and how many pairs came to be scored."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k, self.scored = q, ids, k, 0
        self.levels = [summaries(q, s) for s in SEGMENTS]
        self.norm = np.sqrt((q * q).sum(1))
        self.found = np.empty((0, 4), np.int64)  # query, score, candidate's id, whether the id is null
        self.least = np.full(len(q), -np.inf)  # the k-th score

    def _keep(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, lo: int, hi: int) -> None:
        own = (self.found[:, 0] >= lo) & (self.found[:, 0] < hi)
        rows = np.concatenate([self.found[own], np.stack([i, score, ids, none], 1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 3], -rows[:, 1].astype(object) if (rows[:, 1] == -LONG).any() else -rows[:, 1], rows[:, 0]))]
        begins = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - begins
        self.found = np.concatenate([self.found[~own], rows[place < self.k]])
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]

    def meet(self, x: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """A slice of candidates goes by."""
        levels, norm = [summaries(x, s) for s in SEGMENTS], np.sqrt((x * x).sum(1))
        for lo in range(0, len(self.q), TILE):
            hi = min(lo + TILE, len(self.q))
            other = (self.ids[lo:hi, None] != ids[None, :]) | none[None, :]
            slack = 1e-9 * self.norm[lo:hi, None] * norm[None, :]
            bound = self.levels[0][lo:hi] @ levels[0].T + slack
            bound[~other] = -np.inf
            reach = float(self.norm[lo:hi].max() * norm.max()) if len(norm) else 0.0
            reach = reach if reach == reach else np.inf
            first = min(FIRST * self.k, len(x))
            ahead = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            i, j = np.repeat(np.arange(lo, hi), first), ahead.ravel()
            real = other[i - lo, j]
            i, j = i[real], j[real]
            self._score(x, ids, none, i, j, reach, lo, hi)
            bound[i - lo, j] = -np.inf  # scored
            i, j = np.nonzero((bound > -np.inf) & ~(bound < self.least[lo:hi, None]))
            i += lo
            for at in range(0, len(i), 1 << 16):  # finer bounds for those left, a part at a time
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                fine = np.einsum("ij,ij->i", self.levels[1][a], levels[1][b]) + 1e-9 * self.norm[a] * norm[b]
                left = ~(fine < self.least[a])
                self._score(x, ids, none, a[left], b[left], reach, lo, hi)

    def _score(self, x, ids, none, i, j, reach, lo, hi) -> None:
        if len(i):
            self.scored += len(i)
            score = products(self.q[i], x[j], reach)
            good = ~(score < self.least[i])
            self._keep(i[good], score[good], ids[j[good]], none[j[good]].astype(np.int64), lo, hi)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    at = np.repeat(np.arange(len(column)), lengths)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at, within] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _cells(k: int, width: int):
    """Over rows (cell, kind, n, id, vector) sorted by cell, queries (kind 0) before candidates: (the query's n and id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None

        def found() -> pa.RecordBatch:
            n = np.concatenate([h[0] for h in held])
            f = best.found
            asks = best.ids[f[:, 0]]
            ids = [pa.array(asks, mask=asks == NO_ID), pa.array(f[:, 2], mask=f[:, 3] == 1)]
            return pa.RecordBatch.from_arrays([pa.array(n[f[:, 0]]), *ids, pa.array(np.ascontiguousarray(f[:, 1]))], ["n", "query_id", "vec_id", "score"])

        for batch in batches:
            cells, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            marks = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])) if len(cells) else []
            for a, b in zip(marks, [*marks[1:], len(cells)], strict=True):
                if cells[a] != cell:
                    if best is not None:
                        yield found()
                    cell, held, best = cells[a], [], None
                for at in range(a, b, CANDIDATE_BLOCK):
                    part = batch.slice(at, min(b - at, CANDIDATE_BLOCK))
                    none = np.asarray(part.column(3).is_null())
                    ids = part.column(3).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    vectors = _matrix(part.column(4), width)
                    if kinds[a] == 0:
                        held.append((part.column(2).to_numpy(zero_copy_only=False), ids, vectors))
                    elif held:
                        if best is None:
                            best = Best(np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held]), k)
                        best.meet(vectors, ids, none)
        if best is not None:
            yield found()

    return run


def whole_numbers(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, their components scaled and rounded down."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # floor() gives a long, which holds no more than 2 ** 63; what is beyond 2 ** 53 is whole already
    down = F.transform("x", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return kept.where(fine).select("vec_id", down.alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors: (vec_id, vector), of whole numbers held as doubles. (query_id, rank, vec_id, score) of the k best other rows for each row that is_query picks."""
    rows = stash(vectors.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("n")))
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector"))).first()
    over_q, over_c = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    drawn = F.xxhash64("n")
    copies = lambda most, step: F.explode(F.sequence(F.lit(0), F.lit((most - 1) * step), F.lit(step)))
    queries = rows.where("asks").select((F.pmod(drawn, F.lit(over_q)) * over_c).alias("row"), copies(over_c, 1).alias("other"), F.lit(0).alias("kind"), "n", "vec_id", "vector")
    others = rows.select(F.pmod(drawn, F.lit(over_c)).alias("row"), copies(over_q, over_c).alias("other"), F.lit(1).alias("kind"), "n", "vec_id", "vector")
    dealt = queries.union(others).select((F.col("row") + F.col("other")).alias("cell"), "kind", "n", "vec_id", "vector").repartition("cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(_cells(k, max(1, width or 0)), "n long, query_id long, vec_id long, score long")
    order = Window.partitionBy("n").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13(embeddings: DataFrame) -> DataFrame:
    return top_k(whole_numbers(embeddings), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id
WHERE q.vec_id % 50 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 5
"""
