"""Personal data: patterns find it, co-occurrence in the corpus finds the terms that give it away. SQL expressions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity, each word of a text
(in lower case) a term. Over all documents, n(e) hold the entity, n(t) the term and n(t, e) both, wherever they stand. With N documents
the term tells log2(N n(t, e) / (n(t) n(e))) bits about an entity that has log2(N / n(e)) bits in all. From the share ``GENERALISE`` of
these bits on, every occurrence of the term in documents with that entity is generalised to its kind of word, from ``REMOVE`` on it is
removed; words that touch a base span go with the span. Fewer than ``MIN_SUPPORT`` documents with the pair are no evidence: a term and an
entity that both stand in one document only would always have the share 1, so that every rare word of the document would go.

As n(t, e) is at most n(e), a term with n(t) > n(e) (N / n(e)) ** (1 - GENERALISE) can't reach the share. Such pairs are not formed.

Positions are code points. The patterns are written so that a search never goes back over what it has read (possessive, and started
only where a run of characters starts or the last match ended); matches are the same as those of the plain patterns.

Null texts count as empty. Spans depend on the text and the corpus only, so repeated rows and copies have the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.blocks import stored, text_key

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no match.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
MIN_SUPPORT, GENERALISE, REMOVE = 2, 0.7, 0.9
_BLOCK = 256
_PLACED = "array<struct<start:bigint,end:bigint,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _placed(text: Column, pattern: str | Column, hits: Column) -> Column:
    """start, end, value of the hits: what lies between them gives the places. Sums run over blocks, so the work stays near linear."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    gaps = F.split(text, pattern, -1)
    parts = bound(gaps, lambda g: F.struct(g.alias("gaps"), F.zip_with(g, hits, lambda a, b: (F.length(a) + F.coalesce(F.length(b), F.lit(0))).cast("long")).alias("steps")))

    def with_sums(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.size(hits) - 1)), lambda b: _sum(F.slice(x.steps, b * _BLOCK + 1, F.lit(_BLOCK))))
        ahead = bound(sums, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))
        return bound(ahead, lambda a: F.transform(hits, lambda h, i: bound(a[block(i)] + _sum(F.slice(x.steps, block(i) * _BLOCK + 1, i % _BLOCK)) + F.length(x.gaps[i]), lambda s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value")))))

    return bound(parts, with_sums).cast(_PLACED)


def placed(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap."""
    return bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda h: F.when(F.size(h) > 0, _placed(text, pattern, h)).otherwise(F.array().cast(_PLACED)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d).cast("long")

    return _sum(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return bound(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    hits = placed(text, PATTERNS[kind])
    if kind in NEEDED:
        hits = F.when(F.contains(text, F.lit(NEEDED[kind])), hits).otherwise(F.array().cast(_PLACED))
    return F.transform(F.filter(hits, lambda s: _valid(kind, s.value)), lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))


def base_spans(text: Column) -> Column:
    """Array of kind, start, end, value: kinds in order, each by start."""
    return F.concat(*[_spans(text, kind) for kind in KINDS])


def _entity(span: Column) -> Column:
    value = F.when(span.kind.isin("card", "phone"), _digits(span.value)).otherwise(F.lower(span.value))
    return F.concat(span.kind, F.lit(":"), value)


def _words(text: Column) -> Column:
    """Distinct words in lower case. Each is lowered by itself, as in ``_occurrences``."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lower))


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, spans and, where there are any, the text of every row, stored."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = rows.withColumn("spans", base_spans(F.col("text")))
    return stored(spans.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")


def disclosing(docs: DataFrame, base: DataFrame, text_col: str) -> DataFrame:
    """text_key, term, share: terms of each text that have GENERALISE or more of an entity of the text, from counts over all documents."""
    n = F.col("n")
    share = lambda both: F.log2(n * both / (F.col("n_term") * F.col("n_entity"))) / F.log2(n / F.col("n_entity"))
    n_docs = base.agg(F.count("*").alias("n"))
    texts = base.where(F.size("spans") > 0).groupBy("text_key").agg(F.count("*").alias("m"), F.any_value("spans").alias("spans"), F.any_value("text").alias("text"))
    texts = stored(texts.select("text_key", "m", F.array_distinct(F.transform("spans", _entity)).alias("entities"), _words(F.col("text")).alias("words")), "holders")
    entities = texts.select("m", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("m").alias("n_entity")).withColumn("n", n_docs.scalar())
    entities = entities.where((F.col("n_entity") >= MIN_SUPPORT) & (n > F.col("n_entity")))
    held = stored(texts.select("text_key", F.explode("entities").alias("entity")).join(entities, "entity"), "held")
    most = held.groupBy("text_key").agg(F.max(F.col("n_entity") * F.pow(n / F.col("n_entity"), F.lit(1 - GENERALISE))).alias("most"))
    words = texts.join(most, "text_key").select("text_key", "m", "most", F.explode("words").alias("term"))
    terms = docs.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= MIN_SUPPORT)
    words = words.join(terms, "term").where(F.col("n_term") <= F.col("most") + 1).drop("most")
    pairs = words.join(held, "text_key").where(share(F.least("n_term", "n_entity")) >= GENERALISE)
    pairs = stored(pairs.select("text_key", "m", "entity", "term", "n_entity", "n_term", "n"), "pairs")
    counted = pairs.groupBy("entity", "term", "n_entity", "n_term", "n").agg(F.sum("m").alias("n_both")).where(F.col("n_both") >= MIN_SUPPORT)
    telling = counted.select("entity", "term", share(F.col("n_both")).alias("share")).where(F.col("share") >= GENERALISE)
    return pairs.select("text_key", "entity", "term").join(telling, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("share").alias("share"))


def _occurrences(text: Column, spans: Column, terms: Column) -> Column:
    """Array of start, end, removed: all places of the terms (term, removed) in the text that touch no span."""
    forms = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.array_contains(terms.term, F.lower(w))))
    # a letter beyond 16 bits in the pattern makes Java look behind by code points
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}𝒳])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def places(pattern: Column) -> Column:
        return bound(F.regexp_extract_all(text, pattern, 0), lambda h: F.when(F.size(h) > 0, _placed(text, pattern, h)).otherwise(F.array().cast(_PLACED)))

    free = F.filter(bound(pattern, places), lambda w: ~F.exists(spans, lambda s: (s.start < w.end) & (w.start < s.end)))
    removed = F.filter(terms, lambda t: t.removed).term
    return F.transform(free, lambda w: F.struct(w.start.alias("start"), w.end.alias("end"), F.array_contains(removed, F.lower(w.value)).alias("removed")))


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, base (kind, start, end, value), terms (start, end, removed) of every row."""
    base = found(docs, id_col, text_col)
    telling = disclosing(docs, base, text_col).select("text_key", F.struct("term", (F.col("share") >= REMOVE).alias("removed")).alias("t"))
    telling = telling.groupBy("text_key").agg(F.collect_list("t").alias("telling"))
    terms = F.when(F.col("telling").isNotNull(), _occurrences(F.col("text"), F.col("spans"), F.col("telling")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")
    return base.join(telling, "text_key", "left").select("id", "text_key", F.col("spans").alias("base"), F.coalesce(terms, none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with labels in place of personal data and generalised or removed terms; texts without any are unchanged."""
    spans = all_spans(docs, id_col, text_col).select("text_key", "base", "terms").where((F.size("base") > 0) | (F.size("terms") > 0))
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.concat(F.lit("["), s.kind, F.lit("]")).alias("label")))
    terms = F.transform("terms", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.when(s.removed, F.lit("")).alias("label")))
    rows = spans.select("text_key", F.explode(F.concat(base, terms)).alias("s")).select("text_key", "s.*").distinct()
    ahead = Window.partitionBy("text_key").orderBy("start", F.desc("end"), "label").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.max("end").over(ahead), F.lit(0).cast("long"))).where(F.col("end") > F.col("from"))
    pieces = rows.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start", "from").alias("start"), "from", "end", "label"))).alias("pii_pieces"))
    text = F.col(text_col)
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    general = lambda word: F.when(word.rlike(r"^\p{N}+$"), F.lit("[number]")).when(word.rlike(r"^\p{Lu}"), F.lit("[name]")).otherwise(F.lit("[word]"))
    part = lambda p: F.concat(cut(p["from"], p.start), F.coalesce(p.label, general(cut(p.start, p.end))))
    rest = F.substring(text, (F.element_at("pii_pieces", -1).end + 1).cast("int"), F.length(text))
    clean = F.when(F.col("pii_pieces").isNotNull(), F.concat(F.array_join(F.transform("pii_pieces", part), ""), rest)).otherwise(text)
    return docs.withColumn("pii_key", text_key(text_col)).join(pieces.withColumnRenamed("text_key", "pii_key"), "pii_key", "left").withColumn(text_col, clean).select(*docs.columns)
