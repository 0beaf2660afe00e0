"""Column expressions on nucleotide strings. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point with the Unicode White_Space property, and the four ASCII separators.
WHITE_SPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(seq: Column | str) -> Column:
    """Upper case, without any white space."""
    return F.upper(F.translate(_col(seq), WHITE_SPACE, ""))


def reverse_complement(seq: Column | str) -> Column:
    """A-T and C-G exchanged in either case, read backwards; other symbols stay."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(seq: Column | str) -> Column:
    """The lesser, as strings, of a sequence and its reverse complement."""
    return F.least(_col(seq), reverse_complement(seq))


def read_key(seq: Column | str) -> Column:
    """Key of a read: strand-neutral, without white space or case; null if it holds no base at all."""
    s = squeeze(seq)
    return F.when(s.rlike("[ACGT]"), canonical(s))


def is_id(c: Column | str) -> Column:
    """True where a class id is neither null nor the INVALID marker -1."""
    return _col(c).isNotNull() & (_col(c) != -1)


def overlaps(a: Column | str, b: Column | str, k: int) -> Column:
    """Whether the last k - 1 symbols of a are the first of b."""
    return F.right(_col(a), F.lit(k - 1)) == F.left(_col(b), F.lit(k - 1))


def phred_probability(q: Column | str) -> Column:
    """Probability that a base is right; qualities 0 and 1 say nothing."""
    return F.when(_col(q) <= 1, F.lit(0.25)).otherwise(1 - F.pow(F.lit(10.0), -_col(q) / 10.0))


def phred_log(q: Column | str) -> Column:
    """Natural log of the probability that a base is right; null for quality 0."""
    return F.when(_col(q) > 0, F.log(1 - F.pow(F.lit(10.0), -_col(q) / 10.0)))


def log_add(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)); null stands for the logarithm of zero."""
    high, low = F.greatest(a, b), F.least(a, b)
    both = high + F.log1p(F.exp(low - high))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def log_subtract(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)); null (zero) where a is not above b."""
    return F.when(b.isNull(), a).when(a > b, a + F.log1p(-F.exp(b - a)))
