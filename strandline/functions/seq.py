"""Column functions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 2-bit alphabet and the IUPAC complements.
ALPHABET = "ACGT"
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def bases(text: str | Column = "text") -> Column:
    """The A, C, G and T of a text, upper-cased; null as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^ACGTacgt]+", ""))


def reverse_complement(seq: str | Column) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.reverse(F.translate(c, IUPAC, IUPAC_COMPLEMENT))


def homopolymer_compressed(seq: str | Column) -> Column:
    """Each run of one base as one base."""
    c = F.col(seq) if isinstance(seq, str) else seq
    for b in ALPHABET:
        c = F.regexp_replace(c, f"{b}+", b)
    return c


def subsequence(seq: Column, start: Column, end: Column, reverse: Column) -> Column:
    """Bases [start, end) of a strand, as stored or reverse-complemented."""
    s = F.substring(seq, start + 1, end - start)
    return F.when(reverse, reverse_complement(s)).otherwise(s)


def sequence_name(header: Column) -> Column:
    """The first word of a header."""
    return F.element_at(F.split(header, r"[\x00-\x20]"), 1)


def fragment_name(name: Column) -> Column:
    """A read's name without its mate number."""
    return F.regexp_replace(name, "/[0-9]$", "")


def number_with_suffix(text: Column) -> Column:
    """10k, 5M, 1G (powers of ten) as whole numbers."""
    n = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])$", 1))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.floor(n * scale + 0.499).cast("long")


def io_bytes(mebibytes: Column) -> Column:
    """MiB as bytes in whole 4 KiB pages, one at least."""
    return (F.ceil(F.greatest(F.round(mebibytes * 1048576), F.lit(4096.0)) / 4096) * 4096).cast("long")


def escaped(text: Column) -> Column:
    r"""\t, \n and \\ of a command line as the characters they stand for."""
    mark = F.lit("\x01")
    c = F.replace(text, F.lit("\\\\"), mark)
    c = F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    return F.replace(c, mark, F.lit("\\"))


def point_mutated(seq: Column, position_salt: Column, one_in: int) -> Column:
    """A<->C and G<->T at positions chosen by a hash of salt and position, about one in ``one_in``."""
    chars = F.split(seq, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        F.pmod((i.cast("long") * 7919 + position_salt.cast("long") * 104729) % 1000003, F.lit(one_in)) == 0, F.translate(c, "ACGT", "CATG")).otherwise(c)), "")
