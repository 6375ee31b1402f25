"""Symbol files (8 or 16 bits), vocabulary and dictionary files, and streams as a data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_symbols(spark: SparkSession, path: str, *, bits: int = 8, block: int = 4096, limit: int | None = None) -> DataFrame:
    """path, block, symbols: blocks of symbols of each file; 16-bit ones are big-endian. A symbol of `limit` or more is an error."""
    width = bits // 4
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    step = block * bits // 8
    rows = files.where("length > 0").select("path", "content", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("block", "start"))
    part = F.hex(F.substring("content", (F.col("start") + 1).cast("int"), F.lit(step)))
    symbols = F.transform(F.regexp_extract_all(part, F.lit(f"(.{{{width}}})"), 1), lambda h: F.conv(h, 16, 10).cast("int"))
    out = rows.select("path", "block", symbols.alias("symbols"))
    if limit is not None:
        bad = F.exists("symbols", lambda s: s >= limit)
        out = out.withColumn("symbols", F.when(bad, F.raise_error(F.lit(f"symbol of {limit} or more"))).otherwise(F.col("symbols")))
    return out


def to_bytes(symbols: Column, *, bits: int = 8) -> Column:
    """The binary form of an array of symbols."""
    return F.unhex(F.array_join(F.transform(symbols, lambda s: F.lpad(F.hex(s), bits // 4, "0")), ""))


def parse_vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """token, freq of lines `token<TAB>freq` (a leading `n→` is dropped); blank lines and comments are skipped."""
    line = F.regexp_replace(F.col(column), "^[0-9]+→", "")
    parts = F.split(line, "\t")
    return lines.where((F.trim(line) != "") & ~F.startswith(line, F.lit("#"))).select(F.get(parts, F.lit(0)).alias("token"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999")).cast("long").alias("freq")).where("freq is not null")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocabulary(spark.read.text(path))


def parse_vocabulary_text(df: DataFrame, text: str) -> DataFrame:
    """The same from a column that holds whole files."""
    return parse_vocabulary(df.select(F.explode(F.split(text, "\n")).alias("value")))


def escape(word: Column) -> Column:
    return F.replace(F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(line: Column) -> Column:
    """Undoes `escape`: a backslash pair first becomes a mark, so that it is not read twice."""
    mark = F.replace(line, F.lit("\\\\"), F.lit("\u0001"))
    return F.replace(F.replace(mark, F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))


def write_dictionary(words: DataFrame, path: str, column: str = "word") -> None:
    words.select(escape(F.col(column)).alias("value")).write.text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(unescape(F.col("value")).alias("word"))


class StreamSource(DataSource):
    """Format `stratalyte_stream`: coded streams in local or mounted files named by the option `paths` (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "stratalyte_stream"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return StreamReader(self.options["paths"].split(","))


class StreamReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        from stratalyte.operators.codec import unpack_stream

        with open(partition.value, "rb") as f:
            yield partition.value, unpack_stream(f.read())
