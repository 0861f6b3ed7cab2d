"""What the operators of this subpackage share: tables, cutting of lineage, Arrow helpers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local master gets one of its own (tests); a cluster gets an error."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        to = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", to)
    return to


def stash(df: DataFrame, after: Sequence[DataFrame] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, so a lost
    executor costs no recomputation, and the table can be read twice. checkpoint() would compute the
    last stage of df two times. after: tables stashed before that nothing reads from here on; they are deleted."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(to)
    for old in after:
        at = spark._jvm.org.apache.hadoop.fs.Path(old._stash)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made = spark.read.schema(df.schema).parquet(to)
    made._stash = to
    return made


#: Bits of the tables below; their size doesn't grow with the corpus.
TABLE_BITS = 1 << 22


def bit_table(rows: DataFrame, hashed: Column, bits: int = TABLE_BITS) -> np.ndarray:
    """A bit for each value of a hash, by its low bits: at most bits / 64 rows come to the driver. What a table lets through is checked by a join after it."""
    at = rows.select(hashed.bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = np.zeros(bits >> 6, np.int64)
    for r in words.collect():
        table[r.word] = r.bits
    return table.view(np.uint64)


def in_table(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether a bit table may have each of some hashes (64 bits, signed or not)."""
    at = hashed.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def total_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a text column."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return n, size or 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have at most most_bytes together (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def strong_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each string raw[begin:end], as two columns of 64. Polynomial hashes wouldn't do: unlike strings
    that collide in one modulo 2 ** 64 can be written down, whatever its factor."""
    data, digest = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    made = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, 2)
