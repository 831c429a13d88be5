"""File readers and writers around the line parsers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicelake.sources import lines as L

SAMPLE_SHEET = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "donor_id", "bam", "fastq_1", "fastq_2", "strandness", "read_length")])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of files, folders or globs; gzip works through the file name."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=SAMPLE_SHEET, enforceSchema=False)
    return L.parse_sample_sheet(rows)


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    return L.parse_bed12(read_lines(spark, path))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return L.parse_sam(read_lines(spark, path))


def read_vcf(spark: SparkSession, path: str, sample_index: int | None = None) -> DataFrame:
    return L.parse_vcf(read_lines(spark, path), sample_index)


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """Genotypes of all donors of one or many files, each with the donors of its own header."""
    return L.parse_genotypes(read_lines(spark, path).withColumn("file", F.col("_metadata.file_path")), "file").drop("file")


def read_gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    return L.parse_gtf(read_lines(spark, path), feature)


def read_ids(spark: SparkSession, path: str, drop: str | None = None) -> DataFrame:
    return L.parse_ids(read_lines(spark, path), drop)


def write_vcf(variants: DataFrame, path: str, info_columns: dict[str, str], files: int | None = None) -> None:
    """VCF files in position order, each with the header first, so each is a valid file by itself.

    ``files`` bounds their number; 1 gives one file, written by one task. File names sort as the positions do. Without rows there is
    one file with the header alone.
    """
    spark = variants.sparkSession
    header = "\n".join(L.VCF_HEADER)
    cut = variants.repartitionByRange(files, "region", "pos") if files else variants.repartitionByRange("region", "pos")
    records = L.format_vcf(cut.sortWithinPartitions("region", "pos"), info_columns)

    def with_header(batches):
        first = next(batches, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([header], first.schema.field(0).type)], schema=first.schema)
            yield first
            yield from batches

    # a row with the header is written as its lines
    records.mapInArrow(with_header, "value string").write.mode("overwrite").text(path)
    if spark.read.text(path).isEmpty():
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """Delimited text with an explicit schema and an optional column subset (pruned in the parser)."""
    d = spark.read.csv(path, sep=sep, header=header, schema=schema)
    return d if columns is None else require_columns(d, columns).select(*columns)


def write_table(df: DataFrame, path: str, sep: str = "\t", gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("sep", sep).option("header", "true")
    (w.option("compression", "gzip") if gzip else w).csv(path)


def read_many(spark: SparkSession, glob: str, schema: T.StructType | str, key: str, pattern: str, sep: str = "\t") -> DataFrame:
    """Union of many files with a key taken from each file's path by the pattern's first group."""
    d = spark.read.option("recursiveFileLookup", "true").csv(glob, sep=sep, header=True, schema=schema)
    return d.withColumn(key, F.regexp_extract("_metadata.file_path", pattern, 1))


# Path patterns of the three layouts (grandparent folder, file stem after the first "_", parent and base).
GRANDPARENT = r"([^/]+)/[^/]+/[^/]+$"
STEM_AFTER_UNDERSCORE = r"/[^/_]+_([^/.]+)[^/]*$"
PARENT = r"([^/]+)/[^/]+$"


def read_predictions(spark: SparkSession, path: str, heads: Sequence[str]) -> DataFrame:
    """Prediction Parquet with only the needed columns read."""
    d = spark.read.parquet(path)
    return require_columns(d, ["chrom", "pos", "strand", "y_acceptor", "y_donor", "y_ssu", *heads]).select("chrom", "pos", "strand", "y_acceptor", "y_donor", "y_ssu", *heads)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], files_per_key: int = 1) -> None:
    """Parquet folders per key. A hash of the rows spreads every key over ``files_per_key`` tasks, so a hot key is not one file."""
    d = df.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key)))
    d.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """Count files: comment lines skipped, last column is the count; the sample comes from the parent folder."""
    d = L._fields(read_lines(spark, path).withColumn("sample", F.regexp_extract("_metadata.file_path", PARENT, 1)))
    f = lambda i: F.get("_f", F.lit(i))
    d = d.filter(f(0) != "Geneid")
    return d.select("sample", f(0).alias("gene_id"), f(5).try_cast("int").alias("length"), F.element_at("_f", -1).try_cast("long").alias("n"))


def read_gct(spark: SparkSession, path: str, tissues: Sequence[str]) -> DataFrame:
    """Median expression table: two leading lines and the column line are skipped by their shape; tissues are given in file order."""
    d = read_lines(spark, path).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") == 2 + len(tissues))
    f = lambda i: F.get("_f", F.lit(i))
    d = d.filter(f(0) != "Name")
    return d.select(f(0).alias("gene_id"), *[f(2 + i).try_cast("double").alias(t) for i, t in enumerate(tissues)])


def reporter_table(train: DataFrame, test: DataFrame, truth: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Train and labelled test rows in one schema without duplicate rows."""
    from splicelake.operators.joins import merge_labels

    t = merge_labels(test, truth, list(key), value)
    cols = [*key, *[c for c in train.columns if c not in (*key, value)], value]
    both = train.select(*cols).withColumn("split", F.lit("train")).unionByName(t.select(*cols).withColumn("split", F.lit("test")))
    return both.dropDuplicates()


def write_metrics(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str, levels: list[str], skip_missing: str | None = None) -> DataFrame:
    return L.parse_metrics(read_lines(spark, path), levels, skip_missing)
