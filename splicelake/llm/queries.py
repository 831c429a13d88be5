"""One query per operator over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm import archives, decontaminate, nearcopies, negatives, packing, pii, quality, repeats, rules, shards, topsearch, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contamination(spark: SparkSession, sf_dir: str, slop: int) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=slop)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


@query(
    """with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    g as (select distinct item_id, least(len(w), 13) as l, array_to_string(w[i:i + 12], ' ') as gram from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0) x),
    k as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') as gram from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d join (select distinct l from g) z on len(w) >= l) x),
    h as (select k.doc_id, k.l, k.i, g.item_id from k join g on k.gram = g.gram and k.l = g.l),
    n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from h) x group by doc_id),
    t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h where item_id is not null) x group by doc_id)
    select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join n using (doc_id) left join t using (doc_id)"""
)
def op1_decontamination(spark, sf_dir):
    return _contamination(spark, sf_dir, 0).drop("n_near_items")


@query()
def op1_proximity(spark, sf_dir):
    """The columns of op1_decontamination and the number of items with proximity matches, which its SQL doesn't have."""
    return _contamination(spark, sf_dir, 2)


@query(
    """with p as (select page_id, html, encode(coalesce(html, '')) as body from pages),
    g as (select body, max(page_id) as kept, count(*) as n from p where octet_length(body) >= 1000 group by body),
    j as (select p.page_id, p.body, case when g.n > 1 and g.kept is distinct from p.page_id then g.kept end as refers_to from p left join g on p.body = g.body)
    select page_id, cast(octet_length(body) as bigint) as payload_bytes, sha1(body) as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from j"""
)
def op2_warc(spark, sf_dir):
    return archives.round_trip(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_sharding(spark, sf_dir):
    out = shards.sharded(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query()
def op4_quality_rules(spark, sf_dir):
    return rules.judged(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op7_quality_classifier(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query(
    """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
    s as (select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end) as shingle from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
    r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.reached),
    c as (select doc_id, min(reached) as component_id from r group by doc_id)
    select c.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)"""
)
def op10_minhash(spark, sf_dir):
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), k=4).withColumnRenamed("id", "doc_id")


@query()
def op9_toxicity(spark, sf_dir):
    out = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.transform("evidence", lambda x: x.id.cast("string")).alias("evidence"))


@query()
def op6_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents")).drop("tokens").withColumnRenamed("id", "doc_id")


@query()
def op3_pii(spark, sf_dir):
    out = pii.all_spans(table(spark, sf_dir, "documents"))
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return out.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query()
def op5_suffix_dedup(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")


#: Whole numbers of the vectors that take part; ``r`` tells repeated rows apart.
_VECTORS = """with v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)"""


@query(
    _VECTORS
    + """, s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
    k as (select *, row_number() over (partition by r order by score desc, vec_id) as place from s)
    select query_id, cast(place as integer) as rank, vec_id, score from k where place <= 5"""
)
def op11_topk_search(spark, sf_dir):
    return topsearch.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5).withColumnRenamed("id", "vec_id")


@query(
    _VECTORS
    + """, w as (select r, vec_id, x, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l from v where label is not null),
    s as (select a.r, a.vec_id as anchor_id, c.r as other, c.vec_id, a.l = c.l as same, cast(list_inner_product(a.x, c.x) as bigint) as score from w a join w c on a.r <> c.r where a.vec_id % 50 = 0),
    p as (select * from (select *, row_number() over (partition by r order by score desc, vec_id) as place from s where same) t where place <= 5),
    n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.r, p.place order by s.score desc, s.vec_id) as rank
    from p join s on s.r = p.r and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
    select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
)
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query()
def op13_whitening(spark, sf_dir):
    out = whitening.whitened(table(spark, sf_dir, "embeddings"), 4)
    return out.withColumn("deviation", F.col("deviation").cast("long")).withColumnRenamed("id", "vec_id")
