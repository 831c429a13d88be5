"""Column expressions for keys, filters, labels and fractions. All stay in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The "no measurement" marker and the coverage threshold of the usage matrix.
SENTINEL = 777.0
MIN_COVERAGE = 5

# SAM flag bits.
PAIRED, PROPER_PAIR, REVERSE, FIRST_IN_PAIR, SECONDARY = 1, 2, 16, 64, 256
UNIQUE_MAPQ = 255

# Class order of merged site types, and the classes that count as ambiguous in strict mode.
SITE_CLASS_ORDER = ["exon_end", "exon_start", "both", "unknown"]
STRICT_AMBIGUOUS = ["exon_start,both", "exon_end,exon_start,both", "exon_end,exon_start", "both"]

# Lower edges of the ten usage bins as a floating-point range from 0 in steps of 0.1.
USAGE_BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


# --- reads -----------------------------------------------------------------------------------------------------


def quality_read(flag: Column, mapq: Column, vw: Column) -> Column:
    """Uniquely mapped proper pair, not secondary, and variant-aware tag absent or 1."""
    mapped = has_bits(flag, PROPER_PAIR) & ~has_bits(flag, SECONDARY) & (mapq == UNIQUE_MAPQ)
    return mapped & (vw.isNull() | (vw == "1"))


def read_strand(flag: Column, library: str) -> Column:
    """Strand of the transcript a read comes from, for library type ``fr`` or ``rf``."""
    if library not in ("fr", "rf"):
        raise ValueError("library must be fr or rf")
    leading = has_bits(flag, FIRST_IN_PAIR) | ~has_bits(flag, PAIRED)
    forward = leading != has_bits(flag, REVERSE)
    plus = forward if library == "fr" else ~forward
    return F.when(plus, "+").otherwise("-")


def strandness_call(fr: Column, rf: Column) -> Column:
    return (
        F.when(rf > 0.8, "rf").when(fr > 0.8, "fr").when(F.abs(fr - rf) < 0.2, "unstranded").otherwise("unknown")
    )


def feature_count_strand(strandness: Column) -> Column:
    return F.when(strandness == "rf", "2").when(strandness == "fr", "1").otherwise("0")


def strand_arguments(strandness: Column) -> Column:
    return F.when(strandness.isin("rf", "fr"), F.concat(F.lit("--isStranded -s "), strandness)).otherwise("")


# --- keys ------------------------------------------------------------------------------------------------------


def with_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def parse_variant_key(key: Column) -> Column:
    """Struct(chrom, pos, ref, alt); null when the key does not have four parts or an integer position."""
    p = F.split(key, ":")
    pos = F.get(p, F.lit(1)).try_cast("int")
    ok = (F.size(p) == 4) & pos.isNotNull()
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("chrom"), pos.alias("pos"), F.get(p, F.lit(2)).alias("ref"), F.get(p, F.lit(3)).alias("alt")))


def parse_intron(trait: Column) -> Column:
    """Struct(chrom, start, end, strand) from ``chr:start:end[:clu_n_strand]``; null when malformed."""
    p = F.split(trait, ":")
    start, end = F.get(p, F.lit(1)).try_cast("int"), F.get(p, F.lit(2)).try_cast("int")
    tail = F.get(p, F.lit(3))
    strand = F.when(tail.endswith("_+"), "+").when(tail.endswith("_-"), "-")
    ok = (F.size(p) >= 3) & start.isNotNull() & end.isNotNull()
    return F.when(ok, F.struct(with_chr(F.get(p, F.lit(0))).alias("chrom"), start.alias("start"), end.alias("end"), strand.alias("strand")))


def strip_version(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"\.\d+$", "")


def site_key(region: Column, strand: Column, site: Column, site_type: Column) -> Column:
    return F.concat_ws("_", region, strand, site.cast("string"), site_type)


def parse_site_key(key: Column) -> Column:
    """Struct(region, strand, site, site_type); the type keeps its own underscores (at most three splits)."""
    p = F.split(key, "_", 4)
    return F.struct(
        F.get(p, F.lit(0)).alias("region"), F.get(p, F.lit(1)).alias("strand"),
        F.get(p, F.lit(2)).try_cast("int").alias("site"), F.get(p, F.lit(3)).alias("site_type"),
    )


def donor_id(sample: Column, cohort: str | None = None) -> Column:
    """First two dash parts; with ``cohort`` only for samples of that cohort, others keep their id."""
    two = F.substring_index(sample, "-", 2)
    return two if cohort is None else F.when(sample.startswith(cohort), two).otherwise(sample)


def sample_id(file_name: Column, suffix_pattern: str = r"\.(bam|fastq\.gz|fq\.gz)$") -> Column:
    return F.regexp_replace(file_name, suffix_pattern, "")


def uid_head(uid: Column) -> Column:
    return F.substring_index(uid, "_", 1)


# --- chromosomes -----------------------------------------------------------------------------------------------


def chromosome_number(chrom: Column) -> Column:
    """1–22 as numbers, X as 23, Y as 24, null otherwise; ``chr`` prefix optional."""
    bare = F.regexp_replace(chrom, "^chr", "")
    n = bare.try_cast("int")
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(n.between(1, 22), n)


def is_autosome(chrom: Column) -> Column:
    return F.coalesce(F.regexp_replace(chrom, "^chr", "").try_cast("int").between(1, 22), F.lit(False))


def on_chromosomes(chrom: Column, chroms: list[str], paralog: Column | None = None) -> Column:
    """Membership; with ``paralog`` given, paralogs pass from every chromosome."""
    inside = chrom.isin(*chroms)
    return inside if paralog is None else inside | (paralog == 1)


def outside_training(chrom: Column, excluded: list[str], paralog: Column) -> Column:
    """True for non-paralogs on excluded chromosomes (rows to drop before splitting)."""
    return (paralog == 0) & chrom.isin(*excluded)


# --- variants --------------------------------------------------------------------------------------------------


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "snv").when(r > a, "deletion").when(r < a, "insertion").otherwise("mnv")


def snvs_of(keys: Column) -> Column:
    """Keep single-nucleotide members of a list of variant keys."""

    def single(k: Column) -> Column:
        p = F.split(k, ":")
        return (F.length(F.get(p, F.lit(2))) == 1) & (F.length(F.get(p, F.lit(3))) == 1)

    return F.filter(keys, single)


def frequency_class(af: Column) -> Column:
    missing = af.isNull() | F.isnan(af)
    return (
        F.when(missing, "missing").when(af < 1e-5, "singleton").when(af < 1e-3, "rare").when(af < 0.01, "low").otherwise("common")
    )


# --- lists and fractions ---------------------------------------------------------------------------------------


def unpack_ints(packed: Column) -> Column:
    return F.transform(F.filter(F.split(packed, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast("int"))


def unpack_doubles(packed: Column) -> Column:
    return F.transform(F.filter(F.split(packed, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast("double"))


def pack(values: Column) -> Column:
    return F.array_join(values, ",")


def parse_fraction(text: Column) -> Column:
    """Struct(num, den, ok) of an ``a/b`` string; malformed text counts as 0/0 with ok = false."""
    num = F.regexp_extract(text, r"^(\d+)/(\d+)$", 1).try_cast("int")
    den = F.regexp_extract(text, r"^(\d+)/(\d+)$", 2).try_cast("int")
    ok = F.coalesce(num.isNotNull() & den.isNotNull(), F.lit(False))
    return F.struct(F.when(ok, num).otherwise(0).alias("num"), F.when(ok, den).otherwise(0).alias("den"), ok.alias("ok"))


def masked_usage(num: Column, den: Column, min_coverage: int = MIN_COVERAGE) -> Column:
    """num/den, null below the coverage threshold."""
    return F.when((den >= min_coverage) & (den > 0), num / den)


def to_sentinel(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(SENTINEL))


def from_sentinel(value: Column) -> Column:
    return F.when(value != SENTINEL, value.cast("double"))


def all_sentinel(values: Column) -> Column:
    """True for a non-empty list made only of the missing marker."""
    return (F.size(values) > 0) & F.forall(values, lambda x: x == SENTINEL)


def has_values(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) > 0


def usage_bin(ssu: Column) -> Column:
    """Bin 0–9 by literal left-closed edges."""
    out = F.when(ssu < USAGE_BIN_EDGES[1], 0)
    for i in range(2, 10):
        out = out.when(ssu < USAGE_BIN_EDGES[i], i - 1)
    return out.otherwise(9)


def expression_bin(tpm: Column, width: float = 0.4) -> Column:
    return F.floor(F.when(tpm > 0, F.log2(tpm)).otherwise(F.lit(-10.0)) / width).cast("int")


# --- splice geometry -------------------------------------------------------------------------------------------


def splice_label(strand: Column, site_type: Column) -> Column:
    start, end = F.lower(site_type).contains("start"), F.lower(site_type).contains("end")
    plus = strand == "+"
    return (
        F.when((plus & start) | (~plus & ~start & end), "acceptor").when((plus & end) | (~plus & start), "donor").otherwise("unknown")
    )


def site_motif(seq: Column, label: Column, centre: Column) -> Column:
    """Dinucleotide next to a site at 0-based ``centre``: two bases before an acceptor (fewer at the start), two from a donor on."""
    return (
        F.when(label == "acceptor", F.upper(F.substring(seq, F.greatest(centre - 1, F.lit(1)), F.least(centre, F.lit(2)))))
        .when(label == "donor", F.upper(F.substring(seq, centre + 1, F.lit(2))))
        .otherwise("")
    )


#: Bases outward from an exon boundary (negative: inside the exon) that form a splice site and a splice region.
SITE_REACH, REGION_REACH = (1, 2), (-2, 8)


def _boundary_class(outward: Column) -> Column:
    """Class of an offset from one boundary, null beyond the region."""
    return F.when(outward.between(*SITE_REACH), "splice_site").when(outward.between(*REGION_REACH), "splice_region")


def locations(pos: Column, start: Column, end: Column) -> Column:
    """Names of the location classes of a variant: ``all``, its class, and the class with the side it belongs to.

    Each boundary classifies its offset on its own; the class nearer to a splice site counts. What neither boundary claims is exon or
    intron and belongs to the boundary on its side. In short exons both boundaries may name a side.
    """
    body = F.when(pos.between(start, end), "exon").otherwise("intron")
    side = F.when(_left_half(pos, start, end), "_acc").otherwise("_don")
    return _location_names(_boundary_class(start - pos), _boundary_class(pos - end), body, side)


def location_code(pos: Column, start: Column, end: Column) -> Column:
    """The set of ``locations`` as a small number, cheap to group by; ``locations_of`` gives the names."""
    cls = lambda outward: F.when(outward.between(*SITE_REACH), 1).when(outward.between(*REGION_REACH), 2).otherwise(0)
    body, side = F.when(pos.between(start, end), 0).otherwise(1), F.when(_left_half(pos, start, end), 0).otherwise(1)
    return cls(start - pos) * 12 + cls(pos - end) * 4 + body * 2 + side


def locations_of(code: Column) -> Column:
    """The names of a ``location_code``, from a list of the names of all codes."""
    cls = [F.lit(c).cast("string") for c in (None, "splice_site", "splice_region")]
    body, side = [F.lit(c) for c in ("exon", "intron")], [F.lit(c) for c in ("_acc", "_don")]
    return F.get(F.array(*[_location_names(cls[c // 12], cls[c // 4 % 3], body[c // 2 % 2], side[c % 2]) for c in range(36)]), code)


def _left_half(pos: Column, start: Column, end: Column) -> Column:
    return F.when(pos.between(start, end), F.abs(pos - start) <= F.abs(pos - end)).otherwise(pos < start)


def _location_names(acceptor: Column, donor: Column, body: Column, side: Column) -> Column:
    best = F.when((acceptor == "splice_site") | (donor == "splice_site"), "splice_site").otherwise(F.coalesce(acceptor, donor))
    acc, don = F.concat(acceptor, F.lit("_acc")), F.concat(donor, F.lit("_don"))
    # sites stand before regions
    swap = (donor == "splice_site") & (acceptor == "splice_region")
    first = F.when(swap, don).otherwise(F.coalesce(acc, don, F.concat(body, side)))
    second = F.when(swap, acc).when(acceptor.isNotNull(), don)
    names = [F.lit("all"), F.coalesce(best, body), first]
    return F.when(second.isNotNull(), F.array(*names, second)).otherwise(F.array(*names))


def boundary_distance(pos: Column, start: Column, end: Column) -> Column:
    return F.least(F.abs(pos - start), F.abs(pos - end))


def signed_boundary_distance(pos: Column, start: Column, end: Column) -> Column:
    """Offset to the nearest boundary; the acceptor side wins a tie."""
    return F.when(F.abs(pos - start) <= F.abs(pos - end), pos - start).otherwise(pos - end)


def strand_select(strand: Column, plus_value: Column, minus_value: Column) -> Column:
    return F.when(strand == "+", plus_value).otherwise(minus_value)


def strongest(values: Column) -> Column:
    """Signed member with the largest absolute value; the first one wins a tie."""
    top = F.array_max(F.transform(values, F.abs))
    return F.get(F.filter(values, lambda x: F.abs(x) == top), F.lit(0))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
