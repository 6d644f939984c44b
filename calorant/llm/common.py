"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id counts as the empty text."""
    id_text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(id_text, F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or setCheckpointDir. Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="calorant-checkpoint-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read from there: smaller than a checkpoint, where columns are narrow."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_slices(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs [i, j) of about `most` bytes, one text at least, to bound array sizes."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for further tasks, and would keep it beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches for mapInPandas, with give_back() at its end."""

    def of(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return of


def encoded(column) -> list[bytes]:
    """UTF-8 of a pandas column of texts; a null becomes the empty text."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads polynomial hashes over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _shifted(c: int, bits: int) -> int:
    """A CRC-32 register after so many zero bits."""
    for _ in range(bits):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned CRC-32 of a text's UTF-8, nibble by nibble, the low one of a byte first."""
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(0, length({digits})), lambda i: cast(instr('0123456789ABCDEF', {digits}[(i // 2) * 2 + 2 - i % 2]) - 1 as bigint))"
    step = f"xor(c >> 4, cast({[_shifted(c, 4) for c in range(16)]}[(xor(c, b) & 15) + 1] as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {nibbles}), lambda c, b: {step}), cast(4294967295 as bigint))"
