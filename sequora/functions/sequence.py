"""Column expressions over base sequences: all JVM-side, no Python in the data path.

Bases code two bits each, A=0 C=1 G=2 T=3, most significant pair of a byte first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_bytes(c: Column | str) -> Column:
    """Lower-case hex digits of a string's UTF-8 bytes or of a binary."""
    return F.lower(F.hex(col(c).cast("binary")))


def bytes_to_dna(c: Column | str) -> Column:
    """Four bases a byte; null stays null, empty gives empty."""
    digits = "0123456789abcdef"
    return reduce(lambda s, d: F.replace(s, F.lit(d), F.lit(BASES[int(d, 16) >> 2] + BASES[int(d, 16) & 3])), digits, hex_bytes(c))


def dna_to_bytes(c: Column | str) -> Column:
    """The bytes of a sequence; null unless it is ACGT only and a multiple of four long."""
    c = col(c)
    pairs = F.regexp_extract_all(c, F.lit("(..)"), F.lit(1))
    digit = lambda p: F.lower(F.hex((F.instr(F.lit(BASES), F.substring(p, 1, 1)) - 1) * 4 + F.instr(F.lit(BASES), F.substring(p, 2, 1)) - 1))
    whole = c.rlike("^[ACGT]*$") & (F.length(c) % 4 == 0)
    return F.when(whole, F.unhex(F.array_join(F.transform(pairs, digit), "")))


def gc_content(c: Column | str) -> Column:
    """Share of G and C; an empty sequence has 0."""
    c = col(c)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise((F.length(c) - F.length(F.translate(c, "GC", ""))) / F.length(c))


def runs(c: Column | str) -> Column:
    """The maximal runs of one base, in order."""
    return F.regexp_extract_all(col(c), F.lit("(A+|C+|G+|T+)"), F.lit(1))


def max_homopolymer(c: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(runs(c), lambda r: F.length(r))), F.lit(0))


def count_homopolymers(c: Column | str, least: int = 3) -> Column:
    """Runs of ``least`` bases or more."""
    return F.regexp_count(col(c), F.lit("|".join(f"{b}{{{least},}}" for b in BASES)))


def has_homopolymer(c: Column | str, least: int = 2) -> Column:
    return col(c).rlike("|".join(b * least for b in BASES))


def constraint_ok(c: Column | str, max_run: int = 3, gc_low: float = 0.4, gc_high: float = 0.6) -> Column:
    """The synthesis constraint; an empty sequence passes."""
    c = col(c)
    return (F.length(c) == 0) | (~has_homopolymer(c, max_run + 1) & gc_content(c).between(gc_low, gc_high))


def reverse_complement(c: Column | str) -> Column:
    """Letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(col(c), "[^ACGT]", "N"), "ACGT", "TGCA"))


def complement_bytes(c: Column | str) -> Column:
    """Complement of a packed sequence: every two-bit code inverted."""
    return F.unhex(F.translate(hex_bytes(c), "0123456789abcdef", "fedcba9876543210"))


def yin_yang(c: Column | str) -> Column:
    """Two-bit codes through ACGT at even positions and CGTA at odd ones."""
    digits = "0123456789abcdef"
    return reduce(lambda s, d: F.replace(s, F.lit(d), F.lit(BASES[int(d, 16) >> 2] + "CGTA"[int(d, 16) & 3])), digits, hex_bytes(c))


def yin_yang_inverse(c: Column | str) -> Column:
    """The directly mapped sequence of a yin-yang one."""
    pairs = F.regexp_extract_all(col(c), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.substring(p, 1, 1), F.translate(F.substring(p, 2, 1), "CGTA", "ACGT"))), "")


def windows(c: Column | str, width: int, step: int) -> Column:
    """Array of substrings of ``width`` every ``step``; a shorter tail is dropped."""
    c = col(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1)), F.lit(step))
    return F.when(F.length(c) < width, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: c.substr(i, F.lit(width))))


def kmers(c: Column | str, k: int) -> Column:
    """Distinct overlapping k-mers of ACGT."""
    return F.array_distinct(F.filter(windows(c, k, 1), lambda w: w.rlike("^[ACGT]+$")))


def kmer_code(c: Column | str) -> Column:
    """A k-mer (k up to 31) as a base-4 number."""
    return F.conv(F.translate(col(c), "ACGT", "0123"), 4, 10).cast("long")


def chunks(c: Column | str, width: int) -> Column:
    """Consecutive pieces of ``width`` characters, the last one shorter."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing positions plus the difference in length."""
    a, b = F.split(col(a), ""), F.split(col(b), "")
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(1))), F.slice(b, F.lit(1), F.greatest(n, F.lit(1))), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))


def jaccard_distance(a: Column | str, b: Column | str) -> Column:
    """1 - shared/union of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, 1.0).otherwise(1 - F.size(F.array_intersect(col(a), col(b))) / union)


def occurrences(c: Column | str, motif: str) -> Column:
    """Overlapping occurrences of a literal motif."""
    return F.regexp_count(col(c), F.lit(f"(?={motif})"))


def g_quadruplexes(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit("G{3,}.{1,7}G{3,}.{1,7}G{3,}.{1,7}G{3,}"))


def phred_error(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def phred_log_odds(q: Column | str, clamp: float = 20.0) -> Column:
    """Log of right over wrong, kept within the clamp."""
    p = phred_error(q)
    return F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.log((1 - p) / p)))


def quality_mask(bases: Column | str, qualities: Column | str, least: int) -> Column:
    """A base of quality under ``least`` becomes N."""
    return F.array_join(F.zip_with(F.split(col(bases), ""), col(qualities), lambda b, q: F.when(q < least, "N").otherwise(b)), "")


def melting_wallace(c: Column | str) -> Column:
    c = col(c)
    gc = F.length(c) - F.length(F.translate(c, "GC", ""))
    return 4 * gc + 2 * (F.length(c) - gc)


def is_dna_like(c: Column | str) -> Column:
    """16 bases or more, and half of the letters or more, once headers and white space are gone."""
    body = F.upper(F.regexp_replace(F.regexp_replace(col(c), "(?m)^>[^\n]*$", ""), r"\s", ""))
    bases = F.length(body) - F.length(F.translate(body, "ACGT", ""))
    return (bases >= 16) & (bases * 2 >= F.length(body))


def input_kind(c: Column | str) -> Column:
    """compressed, biological or general, by leading bytes."""
    raw = F.hex(F.substring(col(c).cast("binary"), 1, 6))
    packed = F.lit(False)
    for magic in ("1F8B", "28B52FFD", "425A68", "FD377A585A00", "04224D18"):
        packed = packed | raw.startswith(magic)
    text = col(c).cast("string")
    biological = raw.startswith("3E") | text.rlike(r"^@[^\n]*\n[ACGTN]") | raw.startswith("42414D01")
    return F.when(packed, "compressed").when(biological, "biological").otherwise("general")


def dna_uri(c: Column | str) -> Column:
    """Pool and key of a dna:// address."""
    pattern = "^dna://([^/]+)/?(.*)$"
    return F.struct(F.regexp_extract(col(c), pattern, 1).alias("pool"), F.regexp_extract(col(c), pattern, 2).alias("key"))


def size_label(c: Column | str) -> Column:
    """1024-based size with a unit."""
    c = col(c).cast("double")
    label = F.concat(F.format_number(c, 0), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        label = F.when(c >= 1024**i, F.concat(F.format_number(c / 1024**i, 2), F.lit(f" {unit}"))).otherwise(label)
    return label
