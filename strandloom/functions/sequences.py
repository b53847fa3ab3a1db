"""Sequence functions as Column expressions: complement, strands, k-mers, minimizers, packing, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def dna(text: Column) -> Column:
    """Letters of a text as bases, a to z taken in turn for A, C, G, T; other characters are dropped."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def clean(seq: Column) -> Column:
    """Upper case, anything but A, C, G, T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTN", "TGCAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def ordinal(base: Column) -> Column:
    """0 to 3 for A, C, G, T; 100 for anything else."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when(at > 0, at - 1).otherwise(100)


def strand_sum(kmer: Column) -> Column:
    """Sum of 2 * ordinal - 3: its sign flips under reverse complement, and isn't 0 for odd lengths."""
    count = lambda b: F.length(kmer) - F.length(F.replace(kmer, F.lit(b), F.lit("")))
    return 3 * (count("T") - count("A")) + count("G") - count("C")


def is_forward(kmer: Column) -> Column:
    return strand_sum(kmer) > 0


def canonical(kmer: Column) -> Column:
    """The k-mer as it reads on its canonical strand (odd lengths)."""
    return F.when(is_forward(kmer), kmer).otherwise(reverse_complement(kmer))


def minimizer(canon: Column, weight: int = 13, windows: int = 9) -> Column:
    """Least of the first `windows` words of `weight` bases; lexicographic order is numeric order for A < C < G < T."""
    return F.least(*[F.substr(canon, F.lit(i), F.lit(weight)) for i in range(1, windows + 1)])


def minimizer_at(canon: Column, weight: int = 13, windows: int = 9) -> Column:
    """1-based place of the leftmost least word."""
    return F.array_position(F.array(*[F.substr(canon, F.lit(i), F.lit(weight)) for i in range(1, windows + 1)]), minimizer(canon, weight, windows)).cast("int")


def extension(canon: Column, at: Column, weight: int = 13, bases: int = 4) -> Column:
    """The bases that follow the minimizer; fewer at the end of the span."""
    return F.substr(canon, at + weight, F.lit(bases))


def pack(seq: Column) -> Column:
    """2-bit number of up to 31 bases (A 0, C 1, G 2, T 3); null if another letter occurs."""
    digits = F.translate(seq, BASES, "0123")
    return F.when(seq.rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def unpack(number: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), length, "0"), "0123", BASES)


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """Array of struct(pos, kmer), 0-based, every `step` bases; empty for short sequences."""
    last = F.length(seq) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.struct(p.alias("pos"), F.substr(seq, p + 1, F.lit(k)).alias("kmer")))


def homopolymer_compressed(seq: Column) -> Column:
    return F.regexp_replace(seq, "(.)\\1+", "$1")


def sign_of_strand(strand: Column) -> Column:
    """0 and 1 to -1 and +1."""
    return 2 * strand - 1


def flip(coordinate: Column, length: Column, strand: Column) -> Column:
    """length * strand - sign(strand) * coordinate."""
    return length * strand - sign_of_strand(strand) * coordinate


def forward_start(y1: Column, y2: Column, strand: Column, length: Column) -> Column:
    """First forward position of a block whose coordinates are on its strand; ends swap on the reverse."""
    return F.when(strand == 0, y1).otherwise(length - 1 - y2)


def forward_end(y1: Column, y2: Column, strand: Column, length: Column) -> Column:
    return F.when(strand == 0, y2).otherwise(length - 1 - y1)


def cell(coordinate: Column, size: int = 16) -> Column:
    return F.floor(coordinate / size)


def pack_cord(strand: Column, block_end: Column, gid: Column, x: Column, y: Column) -> Column:
    """strand[1] block_end[1] genome[10] x[30] y[20] as one long."""
    shift = lambda c, n: F.shiftleft(c.cast("long"), n)
    return shift(strand, 61).bitwiseOR(shift(block_end, 60)).bitwiseOR(shift(gid, 50)).bitwiseOR(shift(x, 20)).bitwiseOR(y.cast("long"))


def unpack_cord(cord: Column) -> list[Column]:
    part = lambda n, bits: F.shiftright(cord, n).bitwiseAND((1 << bits) - 1)
    return [part(61, 1).alias("strand"), part(60, 1).alias("block_end"), part(50, 10).alias("gid"), part(20, 30).alias("x"), part(0, 20).alias("y")]


def hash64(number: Column) -> Column:
    """A 64-bit mixing hash for directories."""
    return F.xxhash64(number)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for different lengths."""
    zipped = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(zipped, F.lit(0), lambda s, x: s + x))


# The standard genetic code, codons in the order of A, C, G, T.
CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


def translated(seq: Column, frame: int = 0) -> Column:
    """Amino acids of one frame (0 to 2 forward, 3 to 5 of the reverse complement); X for codons with other letters."""
    strand = seq if frame < 3 else reverse_complement(seq)
    count = F.greatest(F.lit(0), F.floor((F.length(strand) - frame % 3) / 3).cast("int"))
    order = lambda b: F.instr(F.lit(BASES), b) - 1

    def amino(i: Column) -> Column:
        codon = F.substr(strand, i * 3 + 1 + frame % 3, F.lit(3))
        number = order(F.substr(codon, F.lit(1), F.lit(1))) * 16 + order(F.substr(codon, F.lit(2), F.lit(1))) * 4 + order(F.substr(codon, F.lit(3), F.lit(1)))
        return F.when(codon.rlike("^[ACGT]{3}$"), F.substr(F.lit(CODE), number.cast("int") + 1, F.lit(1))).otherwise("X")

    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, amino), "")


def cigar_lengths(cigar: Column) -> tuple[Column, Column]:
    """(reference, read) length of array<struct<op, n>>: = X M both, D N reference, I S read."""
    total = lambda ops: F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + F.when(e["op"].isin(*ops), e["n"]).otherwise(0))
    return total(("=", "X", "M", "D", "N")), total(("=", "X", "M", "I", "S"))


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda e: F.concat(e["n"].cast("string"), e["op"])), "")


def normal_cdf(value: Column, mean: float, deviation: float) -> Column:
    """(1 + erf(z)) / 2 with a rational approximation of erf, absolute error below 1.5e-7."""
    z = (value - mean) / (deviation * 2**0.5)
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return (1 + erf) / 2
