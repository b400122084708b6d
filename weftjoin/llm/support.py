"""Helpers shared by the corpus operators: tables, durable cuts in lineage, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of a batch that goes to a Python worker, and Spark's setting for it.
BATCH_BYTES, _BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; on one machine a local one where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftjoin-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, which is deleted when the driver's program ends."""
    if not _scratch:
        atexit.register(_delete_scratch, spark)
    _scratch.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _scratch[-1]


_scratch: list[str] = []


def _delete_scratch(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # Spark may have ended before
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for path in _scratch:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    _scratch.clear()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``durable`` as a table of columns, for rows that are read in part or joined more than once."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with (bigint) keys of the same values that Spark doesn't take for the ones its rows lie by.

    A join with a grouped or joined side otherwise uses that side's places, and then adaptive execution can't split the other
    side's rows of a hot key; with this both sides are shuffled for the join alone, and it can.
    """
    return df.select(*[F.col(c).bitwiseXOR(F.lit(0).cast("bigint")).alias(c) if c in keys else F.col(c) for c in df.columns])


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; Spark serves the archive to them."""
    sc = spark.sparkContext
    if getattr(sc, "_weftjoin_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        handle, archive = tempfile.mkstemp(prefix="weftjoin-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(archive)
    now = str(spark.conf.get(_BATCH_CONF, None) or "").rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # long texts make batches of rows large
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc._weftjoin_shipped = True


def give_back() -> None:
    """Hand memory that isn't used any more back to the system: workers live on, one for each core."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _tidy(function):
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def python_rows(df: DataFrame, function, schema) -> DataFrame:
    """``mapInPandas`` with this package at hand on the executors."""
    _ship(df.sparkSession)
    return df.mapInPandas(_tidy(function), schema)


def rows_by_text(df: DataFrame, keep) -> DataFrame:
    """The rows whose text ``keep`` (list of texts -> list of bool) wants, all columns as they are."""
    _ship(df.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(keep(b.column("text").to_pylist()), type=pa.bool_()))

    return df.mapInArrow(_tidy(run), df.schema)


def crc_mod(column: str, divisor: int):
    """crc32 of a column as text, modulo ``divisor``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise and invertible."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    lowered = np.arange(256)
    lowered[65:91] += 32
    is_space = np.zeros(256, dtype=bool)
    is_space[list(SPACE_BYTES)] = True
    return values[lowered], lowered.astype(np.uint8), is_space


BYTE_VALUES, LOWER_BYTES, IS_SPACE = _byte_tables()
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_STEPS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        step = _BASE if kind == "up" else _INVERSE
        have = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, step, dtype=np.uint64))), dtype=np.uint64)
        if n <= 1 << 22:
            _powers[kind] = have
    return have[:n]


def words_of(raw: bytes, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (bytes) and a 64-bit hash of each word, A-Z lower-cased; ``is_space`` tells which bytes part words.

    The hash is a polynomial over the bytes, found for all words at once from running sums and
    then finalised, so no Python code runs per word.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~is_space[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power_table("up", len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table("down", len(data))[starts]
    return starts, ends, mix64(hashes + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words; with fewer words, of the whole run; without words, none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = words[:n] * _STEPS[0]
    for i in range(1, k):
        total += words[i : i + n] * _STEPS[i]
    return mix64(total + np.uint64(k))


def utf8(text) -> bytes:
    """Bytes of a text; null counts as empty, and lone surrogates, which Spark can't hold, don't raise."""
    return b"" if text is None else text.encode("utf-8", "replace")
