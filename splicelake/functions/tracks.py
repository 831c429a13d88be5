"""Score tracks and attributions held as arrays per sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half width of the scored region and usage cut-offs of the attribution bins.
SCORED_HALF = 2000
LOW_USAGE, HIGH_USAGE = 0.1, 0.9


def central(track: Column, half: int) -> Column:
    """Positions centre ± half (whole track when shorter)."""
    centre = F.floor(F.size(track) / 2).cast("int")
    lo = F.greatest(centre - half, F.lit(0))
    return F.slice(track, lo + 1, F.least(F.size(track), centre + half + 1) - lo)


def absolute_delta(ref: Column, alt: Column) -> Column:
    return F.zip_with(ref, alt, lambda r, a: F.abs(a.cast("double") - r.cast("double")))


def delta_score(ref: Column, alt: Column, half: int = SCORED_HALF) -> Column:
    """Largest absolute change near the centre of one channel."""
    return F.array_max(absolute_delta(central(ref, half), central(alt, half)))


def delta_score_channels(ref: Column, alt: Column, half: int = SCORED_HALF) -> Column:
    """The same over an array of channels."""
    return F.array_max(F.zip_with(ref, alt, lambda r, a: delta_score(r, a, half)))


def delta_offset(ref: Column, alt: Column, half: int = SCORED_HALF) -> Column:
    """Offset of the first largest change from the centre."""
    d = absolute_delta(central(ref, half), central(alt, half))
    centre = F.floor(F.size(ref) / 2).cast("int")
    lo = F.greatest(centre - half, F.lit(0))
    return (F.array_position(d, F.array_max(d)) - 1 + lo - centre).cast("int")


def realign_indel(track: Column, ref_len: Column, alt_len: Column) -> Column:
    """Alternate track in reference coordinates: insertions collapse to their maximum, deletions get zeros."""
    n = F.size(track)
    c = F.floor(n / 2).cast("int")
    diff = alt_len - ref_len
    ins = F.concat(F.slice(track, 1, c), F.array(F.array_max(F.slice(track, c + 1, diff + 1))), F.slice(track, c + diff + 2, n))
    zero = F.transform(F.array_repeat(F.lit(0.0), -diff), lambda z: z.cast("float"))
    dele = F.concat(F.slice(track, 1, c + 1), zero, F.slice(track, c + 2, n))
    return F.slice(F.when(diff > 0, ins).when(diff < 0, dele).otherwise(track), 1, n)


def oriented_track(track: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.reverse(track)).otherwise(track)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def absolute_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))


def observed_attribution(per_base: Column, codes: Column) -> Column:
    """Attribution at the actual base: ``per_base`` has four values per position, codes 1–4 pick one, 0 gives 0."""
    return F.zip_with(per_base, codes, lambda v, c: F.coalesce(F.get(v, c.cast("int") - 1), F.lit(0.0).cast("float")))


def l1_normalised(values: Column) -> Column:
    s = absolute_total(values)
    return F.transform(values, lambda x: F.when(s > 0, x.cast("double") / s).otherwise(0.0))


def usage_class(ssu: Column) -> Column:
    return F.when(ssu <= LOW_USAGE, "low").when(ssu >= HIGH_USAGE, "high").otherwise("mid")


def distal_share(values: Column, half: int) -> Column:
    """Share of absolute attribution farther than ``half`` from the centre."""
    s = absolute_total(values)
    return F.when(s > 0, 1 - absolute_total(central(values, half)) / s)


def entropy_bits(values: Column) -> Column:
    s = absolute_total(values)
    part = lambda x: F.abs(x.cast("double")) / s
    return F.when(s > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a - F.when(x != 0, part(x) * F.log2(part(x))).otherwise(0.0)))


def effective_width(values: Column, share: float = 0.9) -> Column:
    """Fewest positions that hold ``share`` of the absolute attribution."""
    s = absolute_total(values)
    big = F.sort_array(F.transform(values, lambda x: F.abs(x.cast("double"))), asc=False)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(a["sum"] >= share * s, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
    return F.when(s > 0, F.aggregate(big, zero, step, lambda a: a["n"]))


def positive_share(values: Column) -> Column:
    s = absolute_total(values)
    return F.when(s > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + F.greatest(x.cast("double"), F.lit(0.0))) / s)
