"""What the text operators share: shared-folder tables, numpy word spans and hashes over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.getCheckpointDir() or spark.sparkContext.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='spark-ckpt-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back, so that lost executors don't recompute it.

    The shuffle files behind it are then of no use; Spark removes them when the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once all that reads it is written itself."""
    jvm = table.sparkSession._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def hash_unit(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(16**13))


# --- numpy over Arrow text -------------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, np.uint64(base % 2**64))
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); changes a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Hashes of any byte ranges of one buffer, from prefix sums of byte * base**position modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.inv = _power(pow(base, -1, 2**64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(base, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of `width` bytes, by their starts."""
        n = max(0, len(self.sums) - width)
        return mix64((self.sums[width:] - self.sums[:n]) * self.inv[:n] + np.uint64(width))


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, one after the other, and the documents' offsets; nulls are empty."""
    import pyarrow as pa

    arr = arr.fill_null("").cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs_of_docs(offsets: np.ndarray, most: int = 2 << 20):
    """Index ranges of documents with about `most` bytes together: numpy's temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def list_fields(arr, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of an Arrow array of lists of structs: each list's first item and the last one's end (len(arr) + 1 entries), and fields of all items. A null list is empty."""
    import pyarrow.compute as pc

    items = arr.flatten()
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return first, [items.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (len(offsets) entries)."""
    word = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _TO_LOWER[data]
