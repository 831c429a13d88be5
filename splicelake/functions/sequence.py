"""Base codes, complements and overlays on sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base codes 0–10 in this letter order, and the complement of every letter.
CODE_LETTERS = "NACGTMRWSYK"
BASIC_LETTERS = "NACGT"
COMPLEMENT_FROM = "ACGTNMRWSYKacgtnmrwsyk"
COMPLEMENT_TO = "TGCANKYWSRMtgcankywsrm"
# Two-base codes.
HET_CODES = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
# One character for each base code, in sequences of codes kept as text.
CODE_DIGITS = "0123456789a"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def base_codes(seq: Column, het: bool = False) -> Column:
    """Array of base codes (tinyint); letters outside the alphabet become 0."""
    letters = CODE_LETTERS if het else BASIC_LETTERS
    chars = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.greatest(F.instr(F.lit(letters), c) - 1, F.lit(0)).cast("tinyint"))


def reverse_complement_codes(codes: Column, het: bool = False) -> Column:
    """Complement on codes: basic codes mirror as 5 - c, the two-base codes follow their letters."""
    letters = CODE_LETTERS if het else BASIC_LETTERS
    table = [letters.index(COMPLEMENT_TO[COMPLEMENT_FROM.index(x)]) for x in letters]
    lut = F.array(*[F.lit(v).cast("tinyint") for v in table])
    return F.transform(F.reverse(codes), lambda c: F.get(lut, c.cast("int")))


def one_hot(codes: Column) -> Column:
    """Array of four weights per base (A, C, G, T); two-base codes give 0.5 twice, code 0 gives zeros."""
    pairs = {v: k for k, v in HET_CODES.items()}
    rows = []
    for letter in CODE_LETTERS:
        bases = pairs.get(letter, letter)
        rows.append(F.array(*[F.lit(1.0 / len(bases) if b in bases else 0.0).cast("float") for b in "ACGT"]))
    lut = F.array(*rows)
    return F.transform(codes, lambda c: F.get(lut, c.cast("int")))


def code_text(seq: Column, het: bool = False) -> Column:
    """Base codes as text, a digit of ``CODE_DIGITS`` each: a string where an array would hold a value per base."""
    letters = CODE_LETTERS if het else BASIC_LETTERS
    return F.translate(F.regexp_replace(F.upper(seq), f"[^{letters}]", "N"), letters, CODE_DIGITS[: len(letters)])


def reverse_complement_code_text(codes: Column, het: bool = False) -> Column:
    letters = CODE_LETTERS if het else BASIC_LETTERS
    table = "".join(CODE_DIGITS[letters.index(COMPLEMENT_TO[COMPLEMENT_FROM.index(x)])] for x in letters)
    return F.reverse(F.translate(codes, CODE_DIGITS[: len(letters)], table))


def code_count(codes: Column, code: int) -> Column:
    """Number of bases with a code, from the text of codes."""
    return F.length(codes) - F.length(F.replace(codes, F.lit(CODE_DIGITS[code]), F.lit("")))


def weight_sum(codes: Column, base: str, het: bool = False) -> Column:
    """Sum of the weights of ``base`` over all positions of ``one_hot``, from the text of codes."""
    pairs = {v: k for k, v in HET_CODES.items()}
    out = F.lit(0.0)
    for code, letter in enumerate(CODE_LETTERS if het else BASIC_LETTERS):
        bases = pairs.get(letter, letter)
        if base in bases:
            out = out + code_count(codes, code) / len(bases)
    return out


def het_letter(ref: Column, alt: Column) -> Column:
    """Two-base code for a heterozygous single-base variant."""
    pair = F.concat(F.least(ref, alt), F.greatest(ref, alt))
    out = F.when(F.lit(False), F.lit("N"))
    for k, v in HET_CODES.items():
        out = out.when(pair == k, v)
    return out


def overlay_letters(seq: Column, edits: Column) -> Column:
    """Write letters at 0-based offsets: ``edits`` is an array of struct(off, letter)."""
    return F.aggregate(edits, seq, lambda s, e: F.overlay(s, e["letter"], e["off"] + 1))
