"""A self-describing container: a folder with chunks of binary data and a row of metadata, both Parquet.

Appending writes new chunk files and a new metadata version; a reader takes the latest version and holds each chunk
against its digest and the metadata against theirs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAJOR = 1
MAX_STAGES = 8
MAX_FIELDS = 256
#: Block sizes by kind of data.
BLOCKS = {"image": 1 << 20, "video": 1 << 20, "text": 16384, "log": 16384}

_META = "version int, major int, magic string, size long, stored long, chunks long, stages array<string>, fields map<string,string>, chunk_size int, digest string"


def block_size(kind: str, size: int) -> int:
    return BLOCKS.get(kind, 8192 if size < 1 << 20 else 65536)


def _digest() -> Column:
    """Of everything in the metadata but itself."""
    return F.sha2(F.to_json(F.struct("version", "major", "magic", "size", "stored", "chunks", "stages", F.map_entries("fields").alias("fields"), "chunk_size")), 256)


@dataclass
class Container:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, chunk_size: int = 65536) -> Container:
        c = cls(spark, path)
        c._write_meta([(0, MAJOR, "SCNT", 0, 0, 0, [], {}, chunk_size, "")])
        return c

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Container:
        """Magic, version and metadata digest are checked."""
        c = cls(spark, path)
        m = c.metadata().withColumn("ok", _digest() == F.col("digest")).first()
        if m is None or m["magic"] != "SCNT" or not m["ok"]:
            raise ValueError("not a container, or its metadata is damaged")
        if m["major"] > MAJOR:
            raise ValueError(f"container of a newer version: {m['major']}")
        return c

    def _write_meta(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _META).withColumn("digest", _digest()).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def metadata(self) -> DataFrame:
        """The row of the latest version."""
        return self.spark.read.parquet(f"{self.path}/meta").orderBy(F.desc("version")).limit(1)

    def _update(self, **changes) -> None:
        m = self.metadata().first().asDict()
        m |= changes | {"version": m["version"] + 1}
        self._write_meta([tuple(m[k.split()[0]] for k in _META.split(", "))])

    def append(self, data: DataFrame, column: str = "content", order: str = "position", stage: str = "raw") -> None:
        """Write the rows' binaries as chunks after what is there; sizes, stages and digests follow."""
        m = self.metadata().first()
        if len(m["stages"]) >= MAX_STAGES:
            raise ValueError(f"more than {MAX_STAGES} stages")
        rows = data.select((F.col(order) + m["chunks"]).cast("long").alias("chunk"), F.col(column).alias("content"), F.lit(m["version"] + 1).alias("version"))
        rows.withColumns({"size": F.length("content").cast("long"), "digest": F.sha2("content", 256)}).write.mode("append").parquet(f"{self.path}/data")
        added = self.chunks().where(F.col("version") == m["version"] + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        self._update(size=m["size"] + added["s"], stored=m["stored"] + added["s"], chunks=m["chunks"] + added["n"], stages=[*m["stages"], stage])

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def read(self, offset: int = 0, length: int | None = None) -> DataFrame:
        """chunk, content: the parts of chunks that fall in [offset, offset + length). Offsets come from the small table of sizes."""
        sizes = self.chunks().select("chunk", "size").orderBy("chunk").collect()
        spans, at = [], 0
        end = None if length is None else offset + length
        for r in sizes:
            lo, hi = max(offset, at), at + r["size"] if end is None else min(end, at + r["size"])
            if lo < hi:
                spans.append((r["chunk"], lo - at + 1, hi - lo))
            at += r["size"]
        want = F.broadcast(self.spark.createDataFrame(spans, "chunk long, first int, n int"))
        return self.chunks().join(want, "chunk").select("chunk", F.substring("content", F.col("first"), F.col("n")).alias("content"))

    def validate(self) -> DataFrame:
        """level, ok: metadata digest, sizes, data digests."""
        meta = self.metadata().select((_digest() == F.col("digest")).alias("m"), "size", "chunks")
        data = self.chunks().agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("c"), F.coalesce(F.bool_and(F.sha2("content", 256) == F.col("digest")), F.lit(True)).alias("d"))
        both = meta.join(F.broadcast(data))
        levels = {"metadata": F.col("m"), "sizes": (F.col("size") == F.col("s")) & (F.col("chunks") == F.col("c")), "data": F.col("d")}
        return both.select(F.inline(F.array(*(F.struct(F.lit(k).alias("level"), v.alias("ok")) for k, v in levels.items()))))

    def set_field(self, key: str, value: str) -> None:
        fields = self.metadata().first()["fields"] or {}
        if key not in fields and len(fields) >= MAX_FIELDS:
            raise ValueError(f"more than {MAX_FIELDS} fields")
        self._update(fields=fields | {key: value})

    def get_field(self, key: str) -> str:
        return (self.metadata().first()["fields"] or {})[key]

    def remove_field(self, key: str) -> None:
        fields = dict(self.metadata().first()["fields"] or {})
        del fields[key]
        self._update(fields=fields)

    def field_names(self, most: int = MAX_FIELDS) -> list[str]:
        return list(self.metadata().first()["fields"] or {})[:most]
