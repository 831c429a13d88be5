"""FASTA as a chunk table without ever holding a chromosome in one row.

Lines are placed by running sums over file blocks: each block is summed on its own, then gets the totals of the blocks
before it in the same file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicelake.operators.ordered import lookup


def _line_table(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    head = F.col("value").startswith(">")
    return d.withColumns({"is_head": head.cast("int"), "bases": F.when(head, 0).otherwise(F.length("value"))})


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, seq) per sequence line; ``start`` is the 1-based position of its first base."""
    d = _line_table(spark, path)
    w = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"contig": F.sum("is_head").over(w), "upto": F.sum("bases").over(w)})
    per = d.groupBy("file", "block").agg(F.sum("is_head").alias("h"), F.sum("bases").alias("b"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "block", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    d = lookup(d, per, ["file", "block"]).withColumns({"contig": F.col("contig") + F.col("h0"), "upto": F.col("upto") + F.col("b0")})
    heads = d.filter("is_head = 1").select("file", "contig", F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"), F.col("upto").alias("base0"))
    s = lookup(d.filter("is_head = 0 AND bases > 0"), heads, ["file", "contig"])
    return s.select("chrom", (F.col("upto") - F.col("bases") - F.col("base0") + 1).cast("int").alias("start"), F.upper("value").alias("seq"))


def read_fasta(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """(chrom, chunk_idx, seq) with ``size`` bases per chunk; a line that crosses a chunk edge is cut there."""
    d = read_fasta_lines(spark, path).withColumn("lo", F.col("start") - 1)
    first, last = F.floor(F.col("lo") / size), F.floor((F.col("lo") + F.length("seq") - 1) / size)
    d = d.withColumn("chunk_idx", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    a = F.greatest(F.col("chunk_idx") * size, F.col("lo"))
    b = F.least((F.col("chunk_idx") + 1) * size, F.col("lo") + F.length("seq"))
    piece = F.substring("seq", (a - F.col("lo") + 1).cast("int"), (b - a).cast("int"))
    g = d.select("chrom", "chunk_idx", a.alias("a"), piece.alias("piece")).groupBy("chrom", "chunk_idx")
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).cast("int").alias("n_bases"))
