"""Views that read the driver's tables as splice-usage inputs.

Each view is a list of SELECT expressions valid in Spark SQL and in ANSI SQL engines, so the checks start from the
same rows. Spark gets column pruning and pushdown through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splicelake.session import spread

_SAMPLE = "concat('S', CAST(l_suppkey % 10 AS STRING)) AS sample"
_LREGION = "concat('chr', CAST(l_partkey % 5 + 1 AS STRING)) AS region"
_LSTRAND = "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_usage": ("lineitem", [
        _SAMPLE, _LREGION, "CAST(l_partkey AS INT) AS site", _LSTRAND,
        "CASE WHEN l_partkey % 2 = 0 THEN 'exon_start' ELSE 'exon_end' END AS site_type",
        "l_linenumber AS alpha", "CAST(l_quantity AS INT) % 7 AS beta1",
    ]),
    "v_junction": ("lineitem", [
        _SAMPLE, _LREGION, _LSTRAND, "CAST(l_partkey AS INT) AS jleft",
        "CAST(l_partkey + l_linenumber * 10 AS INT) AS jright", "CAST(l_quantity AS INT) AS n",
    ]),
    "v_read": ("lineitem", [
        "concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING), '.', CAST(l_suppkey AS STRING)) AS qname",
        _SAMPLE, _LREGION, "CAST(l_partkey AS INT) AS pos",
        "CAST(l_quantity AS INT) % 2 * 2 + CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END "
        "+ CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 64 ELSE 128 END AS flag",
        "CASE WHEN l_discount > 0.02 THEN 255 ELSE 3 END AS mapq",
        "concat(CAST(l_linenumber * 2 AS STRING), 'S', CAST(CAST(l_quantity AS INT) AS STRING), 'M', CAST(l_linenumber * 10 AS STRING), 'N', "
        "CAST(l_linenumber + 3 AS STRING), 'M', CAST(l_linenumber AS STRING), 'I', CAST(l_linenumber + 5 AS STRING), 'M', "
        "CAST(l_suppkey % 4 * 7 + 4 AS STRING), 'N', '9M') AS cigar",
        "CASE WHEN l_tax = 0 THEN NULL WHEN l_tax < 0.05 THEN '1' ELSE '2' END AS vw",
    ]),
    "v_gene": ("part", [
        "concat('G', CAST(p_partkey AS STRING)) AS gene_id", "concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS region",
        "CAST(p_partkey AS INT) AS gstart", "CAST(p_partkey + p_size * 4 AS INT) AS gend",
        "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "p_retailprice AS tpm",
        "CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS paralog", "p_brand AS brand", "p_type AS ptype",
    ]),
    "v_variant": ("orders", [
        "concat('V', CAST(o_orderkey AS STRING)) AS var_key", "concat('chr', CAST(o_orderkey % 5 + 1 AS STRING)) AS region",
        "CAST(o_orderkey % 2000 AS INT) AS pos", "substring('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) AS ref",
        "substring('ACGT', CAST((o_custkey + 1 + o_orderkey % 3) % 4 + 1 AS INT), 1) AS alt",
        "concat('G', CAST(o_custkey % 2000 AS STRING)) AS gene_id", "o_totalprice / 500000 AS pip",
        "substring(o_orderpriority, 1, 1) AS tissue", "concat('L', CAST(o_custkey % 300 AS STRING)) AS cs_id",
        "o_orderstatus AS status", "o_custkey AS custkey", "o_orderkey AS orderkey",
    ]),
    "v_pred": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _SAMPLE, _LREGION, "CAST(l_partkey AS INT) AS pos", _LSTRAND,
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_acceptor",
        "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y_donor",
        "CASE WHEN l_tax = 0 THEN 777.0 ELSE l_quantity / 50 END AS y_ssu",
        "l_discount AS head_a", "l_extendedprice / 100000 AS head_b",
    ]),
    "v_reporter": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "concat('E', CAST(l_suppkey AS STRING)) AS exon", _LSTRAND,
        "CAST(l_partkey % 120 - 20 AS INT) AS pos", "CAST(0 AS INT) AS estart", "CAST(60 + l_suppkey % 40 AS INT) AS eend",
        "(l_quantity - 25) / 50 AS y", "l_discount * 10 - 0.5 AS a", "l_extendedprice / 100000 - 0.5 AS b", "l_tax * 12 - 0.5 AS c",
        "CASE WHEN l_returnflag = 'R' THEN 'train' ELSE 'test' END AS split",
    ]),
    "v_tissue_site": ("events", [
        "event_type AS tissue", "CAST(user_id AS INT) AS pos", "event_id % 10 AS sample", "value / (value + 50) AS ssu", "event_id",
    ]),
    "v_sample": ("customer", ["c_custkey AS sample_id", "c_mktsegment AS stratum", "c_nationkey AS site_code", "c_acctbal AS bal"]),
    "v_attr": ("embeddings", ["vec_id AS seq_id", "label AS class", "embedding AS attr"]),
    "v_seq": ("documents", ["doc_id", f"translate(text, {_LETTERS}) AS seq"]),
}

_JOINED = {
    "v_label_score": "SELECT l.doc_id, l.quality AS label, d.n_chars AS score, d.lang AS stratum "
    "FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "v_track": "SELECT a.vec_id AS var_id, a.embedding AS ref, b.embedding AS alt, a.label AS class "
    "FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_label_score":
        l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
        return l.join(d, "doc_id").selectExpr("doc_id", "quality AS label", "n_chars AS score", "lang AS stratum")
    if name == "v_track":
        e = table(spark, sf_dir, "embeddings")
        b = e.selectExpr("vec_id - 1 AS var_id", "embedding AS alt")
        a = e.filter("vec_id % 2 = 0").selectExpr("vec_id AS var_id", "embedding AS ref", "label AS class")
        return a.join(b, "var_id").select("var_id", "ref", "alt", "class")
    src, exprs = VIEWS[name]
    if name == "v_seq":
        return spread(table(spark, sf_dir, src).select("doc_id", "text")).selectExpr(*exprs)
    return table(spark, sf_dir, src).selectExpr(*exprs)


def cte(*names: str) -> str:
    """``WITH`` head that defines the named views for the SQL side of a check."""
    parts = []
    for n in names:
        body = _JOINED.get(n)
        if body is None:
            src, exprs = VIEWS[n]
            body = f"SELECT {', '.join(exprs)} FROM {src}"
        parts.append(f"{n} AS ({body})")
    return "WITH " + ", ".join(parts) + " "


def locations_sql(src: str, pos: str, start: str, end: str, out: str) -> str:
    """CTEs that repeat the rows of ``src`` for each of their location classes, as ``out`` with a column location.

    The rule is a table: how far outwards from a boundary a class reaches. Each boundary takes its closest class, the row takes the closest
    of both; rows that no boundary claims are exon or intron, on the side of the boundary they are nearer to or beyond.
    """
    return f""", {out}_row AS (SELECT *, row_number() OVER () AS rn, {start} - {pos} AS to_acc, {pos} - {end} AS to_don FROM {src}),
{out}_reach(cls, lo, hi, place) AS (VALUES ('splice_site', 1, 2, 1), ('splice_region', -2, 8, 2)),
{out}_side AS (SELECT rn, unnest(['_acc', '_don']) AS side, unnest([to_acc, to_don]) AS outward FROM {out}_row),
{out}_hit AS (SELECT rn, side, min_by(cls, place) AS cls, min(place) AS place FROM {out}_side JOIN {out}_reach ON outward BETWEEN lo AND hi GROUP BY rn, side),
{out}_best AS (SELECT rn, min_by(cls, place) AS cls FROM {out}_hit GROUP BY rn),
{out}_body AS (SELECT rn, cls, CASE WHEN greatest(to_acc, to_don) > 0 THEN 'intron' ELSE 'exon' END AS body, CASE WHEN to_acc < to_don THEN '_don' ELSE '_acc' END AS side FROM {out}_row LEFT JOIN {out}_best USING (rn)),
{out}_name AS (SELECT rn, 'all' AS location FROM {out}_row UNION ALL SELECT rn, coalesce(cls, body) FROM {out}_body UNION ALL SELECT rn, concat(body, side) FROM {out}_body WHERE cls IS NULL UNION ALL SELECT rn, concat(cls, side) FROM {out}_hit),
{out} AS (SELECT {out}_row.*, location FROM {out}_row JOIN {out}_name USING (rn))"""
