"""Readers of vector files: fvecs and ivecs records, the binary change log, and generated mixtures."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ready

ROWS = 50_000


class _Records(DataSourceReader):
    """Records of <int32 width><width numbers of 4 bytes>, read in ranges of rows."""

    def __init__(self, options: dict, kind: str):
        self.path, self.kind, self.most = options["path"].removeprefix("file://"), kind, int(options.get("maxCount", -1))

    def partitions(self):
        import os

        size = os.path.getsize(self.path)
        if not size:
            return [InputPartition((0, 0, 0))]
        with open(self.path, "rb") as f:
            width = struct.unpack("<i", f.read(4))[0]
        rows = size // (4 * width + 4)
        rows = min(rows, self.most) if self.most >= 0 else rows
        return [InputPartition((width, a, min(a + ROWS, rows))) for a in range(0, rows, ROWS)] or [InputPartition((0, 0, 0))]

    def read(self, partition):
        width, a, b = partition.value
        if not width:
            return
        raw = np.fromfile(self.path, "<i4", (b - a) * (width + 1), offset=a * (width + 1) * 4).reshape(-1, width + 1)
        if (raw[:, 0] != width).any():
            raise ValueError("records differ in width")
        body = np.ascontiguousarray(raw[:, 1:])
        for i, row in enumerate((body.view("<f4") if self.kind == "fvecs" else body).tolist()):
            yield (a + i, row)


class FvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "node_id long, embedding array<float>"

    def reader(self, schema):
        return _Records(self.options, "fvecs")


class IvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "ivecs"

    def schema(self):
        return "query_id long, node_ids array<int>"

    def reader(self, schema):
        return _Records(self.options, "ivecs")


def register(spark: SparkSession) -> None:
    """Formats ``fvecs`` and ``ivecs`` for spark.read (files of one width, on storage that every executor mounts)."""
    ready(spark)
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def parse_log(raw: bytes, dim: int) -> list[tuple]:
    """Changes of a binary log: 1 insert, 2 delete, 3 insert with metadata.  A torn last record is dropped; an unknown op fails."""
    out, at = [], 0
    try:
        while at < len(raw):
            op, node = struct.unpack_from("<BI", raw, at)
            if op not in (1, 2, 3):
                raise ValueError(f"corrupt log: op {op} at byte {at}")
            to, vector, meta = at + 5, None, None
            if op != 2:
                vector = list(struct.unpack_from(f"<{dim}f", raw, to))
                to += 4 * dim
            if op == 3:
                (n,) = struct.unpack_from("<I", raw, to)
                if to + 4 + n > len(raw):
                    break
                meta = json.loads(raw[to + 4 : to + 4 + n].decode())
                to += 4 + n
            out.append(("D" if op == 2 else "I", node, vector, meta))
            at = to
    except struct.error:
        pass
    return out


def read_log(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Changes (seq, op, node_id, embedding, metadata) of one binary log file; records have no index, so a file is one task."""
    from ..model import tagged

    ready(spark)

    def rows(batches):
        import pyarrow as pa

        kind = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("node_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("metadata", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for raw in b.column(0).to_pylist():
                got = parse_log(raw, dim)
                meta = [None if m is None else [(k, t) for k, v in m.items() if (t := tagged(v)) is not None] for *_, m in got]
                yield pa.record_batch([pa.array(range(len(got)), pa.int64()), *(pa.array([g[i] for g in got], kind.field(i + 1).type) for i in range(3)), pa.array(meta, kind.field(4).type)], schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "seq long, op string, node_id long, embedding array<float>, metadata map<string,string>")


def gaussian_mixture(spark: SparkSession, n: int, dim: int, clusters: int = 50, std: float = 0.3, seed: int = 42) -> DataFrame:
    """node_id, embedding, label: centres of length 10 with normal noise, the same for the same seed at any partitioning."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    centres = 10 * centres / np.linalg.norm(centres, axis=1, keepdims=True)
    held = ready(spark).sparkContext.broadcast(centres)  # clusters * dim numbers

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            label = [i * 2654435761 % 2**32 % clusters for i in ids]
            x = [(held.value[c] + std * np.random.default_rng([seed, i]).standard_normal(dim)).astype(np.float32) for i, c in zip(ids, label)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float32())), pa.array(label, pa.int32())], ["node_id", "embedding", "label"])

    return spark.range(n).select(F.col("id").alias("node_id")).mapInArrow(rows, "node_id long, embedding array<float>, label int")
