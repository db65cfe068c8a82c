"""Shared helpers of the training-data operators: table scans, written cuts of lineage, Arrow batches, output files."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, written  # noqa: F401  (used by the operators)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one given table; the path may belong to any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Arrow batches of few rows and bytes, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """(pyarrow file system, path in it) of a shared folder; usable inside tasks."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets into them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``utf8`` of a column in row ranges of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    data, off = utf8(column)
    for i, j in slices(off, most):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]


def hash_bucket(col, modulus: int):
    """crc32 of an id as text, modulo ``modulus``: the held-out folds of the contracts (null id: fold 0)."""
    return F.coalesce(F.crc32(col.cast("string")) % modulus, F.lit(0))


def tidy(run):
    """A function over the batches of a task that gives the memory it has freed back to the system when it ends: idle
    Python workers stay, and the next stage needs the room."""
    def wrapped(parts):
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):            # another C library
            pass
    return wrapped


def map_text(df: DataFrame, text_col: str, fields: list[tuple[str, str]], make, keep: list[str] | None = None,
             most: int = 4 << 20) -> DataFrame:
    """``keep`` columns (default: all) plus ``fields`` computed from the text column in Arrow batches.

    ``make()`` runs once a task and gives ``f(column of texts) -> list of arrays``, called on slices of about
    ``most`` bytes. A kept column whose name clashes with a new one (in any case of letters) is replaced.
    """
    from pyspark.sql.types import StructType
    new = [n.lower() for n, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = StructType(src.schema.fields[:-1] + StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields)).fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema = to_arrow_schema(schema)

    def run(parts):
        f = make()
        for b in parts:
            if not b.num_rows:
                continue
            texts = b.column(b.num_columns - 1)
            for i, j in slices(utf8(texts)[1], most):
                got = f(texts.slice(i, j - i))
                cols = [b.column(k).slice(i, j - i) for k in range(len(keep))] + list(got)
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, out_schema.types)], schema=out_schema)

    return src.mapInArrow(tidy(run), schema)


# Random odd multipliers of the byte and word hashes (drawn once from a fixed seed, the same on every machine).
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in text order, number of words of each text); words stand between white space."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    solid = data > 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = solid[heads]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else \
        np.arange(len(data)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data))))])
    value = BYTE_VALUE[data] * PLACE[place & 63]
    value ^= value >> np.uint64(29)                     # not linear in the bytes: swapped places differ
    value *= _M1
    value[~solid] = 0
    h = mix(np.add.reduceat(value, start))
    return h, np.diff(np.searchsorted(start, off))


def forget(df: DataFrame) -> None:
    """Removes the folder of a written table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name
