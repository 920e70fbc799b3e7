"""Shared pieces of the training-data operators: sessions, scratch tables, blocks of whole texts, byte packing.

A *block* is a set of whole documents chosen by a hash of ``doc_id`` and text; its size in bytes is bounded (one document is
never split, so a block holds at least one).  Operators that look at windows of a text reduce inside a block first, so
that a window shared by a third of all documents costs one entry a block and not one entry a document.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ready

#: bytes of text in a block
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset on one machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_nearfield_dir", None)
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = sc._nearfield_dir = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/nearfield-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_nearfield_path", None)) is not None:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from one pass over the text column."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def n_blocks(spark: SparkSession, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(shuffle_partitions(spark), total_bytes // block_bytes + 1)


def block_of(n: int) -> Column:
    """By id and text, so that rows without an id, or with one id, don't share a block."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted uint64 array as byte planes of its differences; the upper planes are almost all zero and compress."""
    d = x.astype(np.uint64, copy=True)
    d[1:] -= x[:-1]
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending hashes: the buckets that have any, and the n + 1 bounds; bucket = upper 32 bits scaled to n."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    found, first = np.unique(bucket, return_index=True)
    return found.astype(np.int64), np.append(first, len(hashes))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask of the n cells covered by [s, s + width) for any s."""
    if not len(starts):
        return np.zeros(n, bool)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0
