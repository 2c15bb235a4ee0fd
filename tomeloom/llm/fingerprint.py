"""Threshold-scaled sketches of word shingles, DataFrame functions only.

A document's sketch keeps every shingle hash below a fixed fraction of the hash
space, so sketches of any two documents can be compared, however unequal the
documents.  A text whose shingles all lie above it keeps its single least hash,
so that only texts without words have an empty sketch.  ``merged`` gives from two
sketches that of all shingles of both: the hashes below the fraction, or if there
are none the least of the least ones.

Defined cases: null text is empty text; a text without words has the empty
fingerprint, and two such texts have likeness 1; fewer words than a shingle
make one shingle; rows without an id are left out; rows that share an id are
ordered by a hash of their text; one lone document is its own successor; an empty
table gives no rows; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import doc_rows, shuffle_partitions, table

SHINGLE_WORDS = 5
FRACTION = 4  # one hash in so many is kept
_HASHES = 1 << 63
RANGE_BYTES = 256 << 20
_ROW_BYTES = 64  # what a row weighs besides its text


def sketch(text: Column, k: int = SHINGLE_WORDS, fraction: int = FRACTION) -> Column:
    """Sorted distinct 63-bit hashes of the text's k-word shingles below 2^63 / fraction."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A lambda variable holds the words: they are split once, not once a shingle.
    hashed = F.transform(
        F.array(words),
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), 1),
        ),
    )
    kept = F.transform(
        hashed, lambda hs: F.transform(F.array(F.filter(hs, lambda h: h < _HASHES // fraction)), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(hs))))
    )
    none = F.array().cast("array<bigint>")
    return F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", none).otherwise(F.get(F.get(kept, F.lit(0)), F.lit(0)))


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of all shingles of both sketched texts."""
    both = F.array(F.array_sort(F.array_union(a, b)))
    return F.get(F.transform(both, lambda u: F.when(F.get(u, 0) < _HASHES // fraction, F.filter(u, lambda h: h < _HASHES // fraction)).otherwise(F.slice(u, 1, 1))), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def document_sketches(docs: DataFrame, k: int = SHINGLE_WORDS, fraction: int = FRACTION, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, sketch of every document."""
    return doc_rows(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text"), k, fraction).alias("sketch"))


def range_bounds(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[int]:
    """The least ids of all contiguous ranges of doc_id but the first, each range of about ``range_bytes`` of text and one document at most beyond.

    Ids are dealt into sorted parts, and each part is cut by the running sum of
    its bytes, so neither the spacing of ids nor the spread of lengths matters.
    Only the bounds come to the driver: one a partition, or one a ``range_bytes``.
    """
    sized = docs.select("doc_id", (F.octet_length("text") + _ROW_BYTES).alias("size"))
    total = int(sized.agg(F.sum("size")).first()[0] or 0)
    if not total:
        return []
    # several ranges a partition, so that those that meet in one are about as many everywhere
    target = min(range_bytes, -(-total // (4 * shuffle_partitions(docs.sparkSession))))
    part = sized.repartitionByRange(-(-total // target), "doc_id").withColumn("part", F.spark_partition_id())
    before = F.sum("size").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cuts = part.withColumn("cut", F.floor(before / target)).groupBy("part", "cut").agg(F.min("doc_id").alias("least"))
    return sorted({r["least"] for r in cuts.select("least").collect()})[1:]


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds up to doc_id, by bisection."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # one literal after folding
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= doc_id), at + step).otherwise(at))


def with_next(rows: DataFrame, extra: dict[str, Column], bucket: Column) -> DataFrame:
    """rows (doc_id, text) with the extra columns and ``next``: a struct of text and extra columns of the row that follows by (doc_id, hash of text), the first after the last.

    Each range of ids gets a copy of the first row of the range after it, so
    that a window within the range finds every successor in one shuffle.
    """
    spark = rows.sparkSession
    heads = sorted((r[0], r[1]) for r in rows.groupBy(bucket.alias("bucket")).agg(F.min("doc_id")).collect())
    links = [(doc, heads[i - 1][0]) for i, (_, doc) in enumerate(heads)]
    head_ids = F.broadcast(spark.createDataFrame(links, "doc_id long, bucket int"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    first = Window.partitionBy("doc_id").orderBy("text_key")
    guards = rows.join(head_ids, "doc_id").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumn("guard", F.lit(1))
    every = rows.withColumn("bucket", bucket).withColumn("guard", F.lit(0)).unionByName(guards).withColumns(extra)
    order = Window.partitionBy("bucket").orderBy("guard", "doc_id", "text_key")
    return every.withColumn("next", F.lead(F.struct("text", *extra)).over(order)).where("guard = 0").drop("bucket", "guard", "text_key")


def edited_fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, fraction: int = FRACTION) -> DataFrame:
    """Fingerprints of each text and of the text with its second half replaced by the start of the next document."""
    rows = doc_rows(docs)
    bucket = range_of(F.col("doc_id"), range_bounds(rows))
    paired = with_next(rows, {"sketch": sketch(F.col("text"), k, fraction)}, bucket)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    done = paired.withColumn("edited_sketch", F.explode(F.array(sketch(F.col("edited"), k, fraction))))  # explode keeps it from being computed once a use
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
