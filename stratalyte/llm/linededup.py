"""Line dedup over content-defined chunks, with DataFrame functions only.

A text is cut into units: its lines, and in lines of 50 words or more the sentences (pieces that end in `.`, `!` or
`?` and a space). Both ends of a long line are chunk boundaries. Elsewhere a boundary stands where the rolling hash
of the two units before it hits one residue in four, so what stands far before or after does not move it. No
chosen boundary stands next to another boundary, so chunks have two units or more, but for what stands between
two fixed ones. Chunks of two units or more, or of 50 words or more, are compared over the whole corpus, byte by
byte; of each the first document (smallest doc_id) keeps its first copy, and all other copies go.

Defined results: null texts stay null and empty texts empty; rows with a null doc_id are passed on as they are and
make no chunk repeated; rows with the same doc_id count as one document; equal rows stay equal; other columns are
passed on (no column is named by the caller's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialise

LONG_WORDS = 50
RESIDUES = 4
#: The marks of removed chunks are broadcast if they are no more documents (and four times as many chunks), else joined.
BROADCAST_ROWS = 250_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _n_words(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def _full(parts: Column) -> Column:
    return F.filter(parts, lambda u: u != "")


def _units(text: Column, long_words: int) -> Column:
    """array<struct<u, h, hard>>: hard if a boundary stands before the unit."""
    lines = _full(F.split(text, r"(?<=\n)", -1))

    def of_line(line: Column) -> Column:
        def pieces(is_long: Column) -> Column:
            return F.transform(
                F.when(is_long, _full(F.split(line, r"(?<=[.!?] )", -1))).otherwise(F.array(line)),
                lambda u, i: F.struct(
                    u.alias("u"),
                    F.conv(F.substring(F.md5(u.cast("binary")), 1, 8), 16, 10).cast("long").alias("h"),
                    is_long.alias("long"),
                    (i == 0).alias("first"),
                ),
            )

        return let(_n_words(line) >= long_words, pieces)

    marked = F.flatten(F.transform(lines, of_line))

    def harden(a: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(a, i - 1)
            hard = (i == 0) | (x["first"] & (x["long"] | before["long"]))
            return F.struct(x["u"].alias("u"), x["h"].alias("h"), F.coalesce(hard, F.lit(True)).alias("hard"))

        return F.transform(a, one)

    return let(marked, harden)


def chunks_of(text: Column, *, long_words: int = LONG_WORDS, residues: int = RESIDUES) -> Column:
    """array<struct<text, eligible>> of the chunks, in order; together they are the whole text."""

    def candidates(a: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            rolled = (F.get(a, i - 1)["h"] * 31 + F.get(a, i - 2)["h"] * 7) % residues == 0
            clear = ~x["hard"] & ~F.get(a, i - 1)["hard"] & ~F.get(a, i + 1)["hard"]
            return F.struct(x["u"].alias("u"), x["hard"].alias("hard"), F.coalesce(rolled & clear, F.lit(False)).alias("cand"))

        return F.transform(a, one)

    def cut(a: Column) -> Column:
        starts = F.filter(
            F.transform(a, lambda x, i: F.when(x["hard"] | (x["cand"] & ~F.coalesce(F.get(a, i - 1)["cand"], F.lit(False))), i)),
            lambda i: i.isNotNull(),
        )

        def slices(s: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                n = F.coalesce(F.get(s, k + 1), F.size(a)) - i
                return let(
                    F.array_join(F.transform(F.slice(a, i + 1, n), lambda x: x["u"]), ""),
                    lambda t: F.struct(t.alias("text"), ((n >= 2) | (_n_words(t) >= long_words)).alias("eligible")),
                )

            return F.transform(s, one)

        return let(starts, slices)

    return let(let(_units(text, long_words), candidates), cut)


def _eligible(text: Column, long_words: int, residues: int) -> Column:
    """The chunks that are compared, with their place."""
    numbered = lambda c: F.transform(c, lambda x, k: F.struct(k.alias("k"), x["text"].alias("s"), x["eligible"].alias("eligible")))
    return let(chunks_of(text, long_words=long_words, residues=residues), lambda c: F.filter(numbered(c), lambda x: x["eligible"]))


def dedup_lines(docs: DataFrame, *, long_words: int = LONG_WORDS, residues: int = RESIDUES, count: str | None = None) -> DataFrame:
    """`docs` with the repeated chunks gone from `text`; `count` names a column for the number of removed chunks."""
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    pieces = rows.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.explode(_eligible(F.col("text"), long_words, residues)).alias("c"))
    s = F.col("c.s")
    pieces = materialise(pieces.select("d", "t", F.col("c.k").alias("k"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit("second"), s).alias("g"), s.alias("s")), "chunks")
    # Bytes are compared here: chunks count as one only where the strings are equal. A key of two strings removes nothing.
    texts = pieces.groupBy("h", "g", "s").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("owner"))
    repeated = texts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n"), F.min("owner").alias("owner"))
    repeated = materialise(repeated.where("kinds = 1 and n > 1").select("h", "g", "owner"), "repeated")
    copies = pieces.select("d", "t", "k", "h", "g").join(repeated, ["h", "g"])
    first = F.min("k").over(Window.partitionBy("d", "t", "h", "g"))
    gone = copies.withColumn("first", first).where("d <> owner or k > first")
    marks = materialise(gone.groupBy("d", "t").agg(F.collect_set("k").alias("gone")), "marks")
    held = marks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("places")).first()
    discard(pieces, repeated)
    if held["rows"] <= BROADCAST_ROWS and held["places"] <= 4 * BROADCAST_ROWS:
        marks = F.broadcast(marks)

    t, d2, t2, ks = (fresh(docs, x) for x in ("_text_hash", "_marked_doc", "_marked_hash", "_gone"))
    left = docs.withColumn(t, F.xxhash64("text"))
    joined = left.join(marks.toDF(d2, t2, ks), (F.col("doc_id") == F.col(d2)) & (F.col(t) == F.col(t2)), "left")
    kept = let(
        chunks_of(F.col("text"), long_words=long_words, residues=residues),
        lambda c: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col(ks)), lambda k: F.get(c, k)["text"]), ""),
    )
    text = F.when(F.col(ks).isNull(), F.col("text")).otherwise(kept).alias("text")
    cols = [text if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*cols, *([F.coalesce(F.size(ks), F.lit(0)).cast("long").alias(count)] if count else []))
