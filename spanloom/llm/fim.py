"""Fill-in-middle transformation over class runs.

A text is held as its maximal runs of characters of one class (and, for units of single characters, of one UTF-8 width), with the
units and code points that end by each run's end, added up. A cut after so many units is found by a binary search for its
run, and its place in the run by arithmetic; nothing is cut into units. What closes a unit: ``lines`` each newline, ``words`` each run of white space as
a whole, ``chars`` each character; what is left at the end is one more unit.

The cuts come of the doc_id's digest, so a document is cut alike wherever it runs. A text that is empty or holds a mark stays plain.

Null text: empty. Null doc_id: its digits are empty. Repeated rows are cut alike, each for itself; there are no ties. Very long texts: whole, a
slice of rows at a time. Columns of any name are passed on by ``transform``. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fresh, rows_of, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A class for each byte (continuation bytes have none of their own), and how each class closes units: 0 not, 1 by each character, 2 once a run."""
    of = np.zeros(256, np.uint8)
    if kind == "lines":
        of[ord("\n")] = 1
        return of, np.array([0, 1], np.uint8)
    if kind == "words":
        of[[32, *range(9, 14)]] = 1
        return of, np.array([0, 2], np.uint8)
    if kind == "chars":
        of[0xC0:], of[0xE0:], of[0xF0:] = 1, 2, 3
        return of, np.ones(4, np.uint8)
    raise ValueError(f"no such unit: {kind}")


class Runs(NamedTuple):
    """Maximal runs of one class: where each begins (bytes), bytes a character if it closes units one by one, units and code points up to its end."""

    begins: np.ndarray
    closes: np.ndarray
    width: np.ndarray
    units: np.ndarray
    chars: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0


def encode(raw: np.ndarray, kind: str = "lines") -> Runs:
    """The runs of a text's UTF-8 bytes."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none, none)
    of, how = _classes(kind)
    leads = (raw & 0xC0) != 0x80
    cls = of[raw]
    if leads.all():
        begins = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        chars = np.append(begins[1:], len(raw))
    else:
        at = np.flatnonzero(leads)
        own = cls[at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        begins, chars = at[first], np.append(first[1:], len(at))
    cls, ends = cls[begins], np.append(begins[1:], len(raw))
    closes = how[cls]
    each = np.diff(chars, prepend=0)
    closed = np.where(closes == 1, each, np.where(closes == 2, 1, 0))
    if closes[-1] == 0:
        closed[-1] = 1  # the last unit has no closing character
    return Runs(begins, closes, (ends - begins) // each, np.cumsum(closed), chars)


def cut(runs: Runs, size: int, units: int) -> tuple[int, int]:
    """The place, in bytes and in code points, behind the first ``units`` units of a text of ``size`` bytes."""
    if units == 0:
        return 0, 0
    r = int(np.searchsorted(runs.units, units))
    if runs.closes[r] == 1:
        within = units - (int(runs.units[r - 1]) if r else 0)
        return int(runs.begins[r]) + within * int(runs.width[r]), (int(runs.chars[r - 1]) if r else 0) + within
    return int(runs.begins[r + 1]) if r + 1 < len(runs.begins) else size, int(runs.chars[r])


def draws(doc_id: int | None, seed: int = 7) -> list[int]:
    """Four unsigned numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


FIELDS = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.large_string())]


def transform(docs: DataFrame, kind: str = "lines", seed: int = 7, share: int = 100, spm: int = 50, name: str = "fim") -> tuple[DataFrame, str]:
    """docs with one more column, a struct (n, form, prefix_chars, middle_chars, output), and that column's name. share: of a hundred documents so many
    are transformed; of a hundred transformed ones ``spm`` have the suffix first."""
    (name,) = fresh(docs, name)
    marks = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())

    def one(doc_id: int | None, raw: np.ndarray) -> tuple[int, str, int | None, int | None, bytes]:
        text = raw.tobytes()
        runs = encode(raw, kind)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or any(m in text for m in marks) or h3 % 100 >= share:
            return runs.n, PLAIN, None, None, text
        low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
        (a, a_chars), (b, b_chars) = cut(runs, len(raw), low), cut(runs, len(raw), high)
        p, s, m = marks[0] + text[:a], marks[1] + text[b:], marks[2] + text[a:b]
        form = SPM if h4 % 100 < spm else PSM
        return runs.n, form, a_chars, b_chars - a_chars, (s + p if form == SPM else p + s) + m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
            made = [one(i, raw[a:b]) for i, a, b in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [pa.array(c, pa.large_binary()).cast(t) if t == pa.large_string() else pa.array(c, t) for c, (_, _, t) in zip(zip(*made, strict=True), FIELDS, strict=True)]
            columns = [c.cast(pa.string()) if c.type == pa.large_string() else c for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, [f for f, _, _ in FIELDS])], [*batch.schema.names, name])

    kinds = T.StructType([T.StructField(f, t) for f, t, _ in FIELDS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kinds)])), name


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from output and form alone: the marks stand nowhere else in a transformed output."""
    part = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    a, b, c = (F.get(part, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == PSM, F.concat(a, c, b)).when(form == SPM, F.concat(b, c, a)).otherwise(output)


def op12(docs: DataFrame) -> DataFrame:
    made, name = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    x = F.col(name)
    return made.select(
        "doc_id", x["n"].alias("n"), x["form"].alias("form"), x["prefix_chars"].alias("prefix_chars"), x["middle_chars"].alias("middle_chars"),
        F.sha2(x["output"], 256).alias("output_sha256"), F.sha2(restore(x["output"], x["form"]), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT doc_id, text, l, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(l[1:least(x, y)], '') AS prefix, array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(l[greatest(x, y) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
