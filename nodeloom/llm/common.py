"""Shared pieces of the training-data operators: materialisation, column checks and NumPy text kernels."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources.shared import shared_dir

#: The six whitespace characters that separate words and that exact dedup ignores: space, TAB, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job: written to the shared folder like :func:`materialize`, deleted by :meth:`drop`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the folders of these tables; of all of them if none are named. No later plan may read them."""
        for path in [p for p, t in self.paths.items() if not tables or any(t is x for x in tables)]:
            del self.paths[path]
            delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slot(key: F.Column, bits: int) -> F.Column:
    """The bit that a well-mixed 64-bit key has in :func:`key_bitmap`: its highest ``bits`` bits."""
    return F.shiftrightunsigned(key, 64 - bits)


def key_bitmap(keys: DataFrame, count: int, most: int = 26) -> tuple[np.ndarray, int]:
    """A bitmap of the well-mixed 64-bit keys in the only column, about 16 bits a key, and the logarithm of its length.

    It is never longer than 2**most bits (8 MB), however many keys there are: beyond that it lets more rows through that
    a join behind it has to refuse, and it never refuses a key that is there.
    """
    bits = min(most, max(16, (16 * count).bit_length()))
    at = slot(F.col(keys.columns[0]), bits)
    parts = keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("data"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["data"], np.uint8)[: len(out)]
    return out, bits


def in_bitmap(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these slots are set."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Where an Arrow batch ends. Spark's 64 MB are held several times over: in the JVM's buffers, in the worker, and in what it returns.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on an Arrow batch of this session ends once it has ``most`` bytes, unless a lower bound is set already.

    The bound is read when a plan runs, so it stays set for frames that run later. It changes how rows travel, not which.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def no_nulls(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# --------------------------------------------------------------------------- NumPy kernels

U64 = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
#: Odd multiplier of the prefix hashes; arithmetic is modulo 2**64, where it has an inverse.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; the tables are as long as the longest run of text asks for, 4 MB at least."""
    if len(_powers[0]) < n:
        size = max(n + n // 4, (1 << 18) + 1)
        for k, b in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, b, U64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLDED_VALUES = _BYTE_VALUES[_FOLD]


def prefix_hashes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """P with P[j] = sum of value(data[i]) * base**i for i < j, so any substring's hash takes two lookups."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED_VALUES if fold else _BYTE_VALUES)[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], free of its position."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row begins (one more at the end); null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) in runs of about ``most`` bytes; temporaries are many times as large."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


#: Bytes of letters and digits; all bytes of multi-byte characters count as letters.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, at: np.ndarray, part_of_word: np.ndarray = ~_IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash (A-Z folded) of each word; words never cross rows."""
    inside = part_of_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, start, "right") - 1
    hashed = mix(substring_hashes(prefix_hashes(data, fold=True), start, end) ^ (end - start).astype(U64))
    return start, end, row, hashed


def shingles(hashed: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and, for shorter rows, of the whole row; with where each row's begin."""
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(rows), n)
    pos = begin[owner] + np.arange(at[-1]) - at[owner]
    acc, width = np.zeros(at[-1], U64), np.minimum(count[owner], size)
    for k in range(size):
        use = k < width
        nxt = hashed[np.minimum(pos + k, max(len(hashed) - 1, 0))] if len(hashed) else acc
        acc = np.where(use, acc * U64(_BASE) + nxt + U64(k + 1), acc)
    return mix(acc ^ (width.astype(U64) << U64(56))), at


def codepoints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text as code points, and where each row begins."""
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), heads[at]
