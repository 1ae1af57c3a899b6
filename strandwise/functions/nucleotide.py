"""Column functions on DNA text and IUPAC motifs (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the IUPAC nucleotide code ------------------------------
IUPAC_BASES = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "R": "AG",
    "Y": "CT",
    "S": "CG",
    "W": "AT",
    "K": "GT",
    "M": "AC",
    "B": "CGT",
    "D": "AGT",
    "H": "ACT",
    "V": "ACG",
    "N": "ACGT",
}
BASE_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
# Letters that mark a k-mer as ambiguous (upper case only).
AMBIGUITY_LETTERS = "HVYWDKBNMSR"
# Digit per base of the integer encoding.
BASE_DIGITS = {"G": "0", "T": "1", "C": "2", "A": "3"}
# In a search pattern X means the same as N.
PATTERN_BASES = {**IUPAC_BASES, "X": "ACGT"}

LETTER_OF_BASES = {bases: letter for letter, bases in IUPAC_BASES.items()}


def _complement_letter(letter: str) -> str:
    paired = "".join(sorted(BASE_COMPLEMENT[b] for b in IUPAC_BASES[letter]))
    return LETTER_OF_BASES[paired]


_UPPER = "".join(IUPAC_BASES)
_UPPER_RC = "".join(_complement_letter(c) for c in _UPPER)
COMPLEMENT_FROM = _UPPER + _UPPER.lower()
COMPLEMENT_TO = _UPPER_RC + _UPPER_RC.lower()

_BITS = "ACGT"
# Letter for each base mask (A=1, C=2, G=4, T=8); position 0 is unused.
MASK_LETTERS = "-" + "".join(
    LETTER_OF_BASES["".join(b for i, b in enumerate(_BITS) if mask >> i & 1)]
    for mask in range(1, 16)
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Reverse complement, IUPAC codes included, case kept."""
    return F.reverse(F.translate(_col(c), COMPLEMENT_FROM, COMPLEMENT_TO))


def has_ambiguity(c: Column | str) -> Column:
    """True for k-mers that hold an upper-case ambiguity code."""
    return _col(c).rlike(f"[{AMBIGUITY_LETTERS}]")


def encode_bases(c: Column | str) -> Column:
    return F.translate(_col(c), "".join(BASE_DIGITS), "".join(BASE_DIGITS.values()))


def decode_bases(c: Column | str) -> Column:
    return F.translate(_col(c), "".join(BASE_DIGITS.values()), "".join(BASE_DIGITS))


def number_text(c: Column | str) -> Column:
    """The ASCII text whose bytes are those of a BIGINT, from the first one that isn't 0."""
    return F.unhex(F.hex(_col(c))).cast("string")


def accession(c: Column | str) -> Column:
    """Accession of a header id: third pipe field if there is a pipe, else all."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("|")), F.get(F.split(c, r"\|"), F.lit(2))).otherwise(c)


def motif_regex(c: Column | str) -> Column:
    """Search pattern of an IUPAC motif: each code becomes a base class."""
    out = _col(c)
    for letter, bases in PATTERN_BASES.items():
        if len(bases) > 1:
            out = F.replace(out, F.lit(letter), F.lit(f"[{bases}]"))
    return out


def degenerate_positions(c: Column | str) -> Column:
    """Number of positions that stand for more than one base."""
    return F.length(F.translate(_col(c), "ACGT", "")).cast("bigint")


def represented_bases(c: Column | str) -> Column:
    """Bases represented by the degenerate positions (plain bases count 0)."""
    c = _col(c)

    def letters_of(n: int) -> str:
        return "".join(x for x, bases in IUPAC_BASES.items() if len(bases) == n)

    total = F.lit(0)
    for n in (2, 3, 4):
        total = total + n * (F.length(c) - F.length(F.translate(c, letters_of(n), "")))
    return total.cast("bigint")


def pattern_bases(letter: Column) -> Column:
    """Array of the concrete bases a motif letter stands for."""
    lookup = F.create_map(
        *[
            x
            for letter_, bases in PATTERN_BASES.items()
            for x in (F.lit(letter_), F.array(*[F.lit(b) for b in bases]))
        ]
    )
    return F.coalesce(
        F.element_at(lookup, letter),
        F.raise_error(F.concat(F.lit("not an IUPAC motif letter: "), letter)).cast(
            "array<string>"
        ),
    )


def bit_plane(c: Column | str, bases: str) -> Column:
    """BIGINT with one bit per position, set where the base is one of `bases`.

    The text may hold up to 63 letters.
    """
    c = _col(c)
    marks = "".join("1" if b in bases else "0" for b in _BITS)
    plane = F.conv(F.translate(c, _BITS, marks), 2, 10).cast("bigint")
    return F.when(F.length(c) <= 63, plane).otherwise(
        F.raise_error(F.lit("k-mers longer than 63 letters do not fit a bit plane"))
    )


def iupac_from_planes(a: Column, c: Column, g: Column, t: Column, k: Column) -> Column:
    """Consensus text from the four per-base planes of a group of k-mers."""

    def letter(shift: Column) -> Column:
        def bit(plane: Column, weight: int) -> Column:
            set_ = F.call_function("shiftright", plane, shift).bitwiseAND(F.lit(1).cast("bigint"))
            return set_ * weight

        mask = bit(a, 1) + bit(c, 2) + bit(g, 4) + bit(t, 8)
        return F.substr(F.lit(MASK_LETTERS), (mask + 1).cast("int"), F.lit(1))

    return F.array_join(
        F.transform(F.sequence(k.cast("int") - 1, F.lit(0), F.lit(-1)), letter), ""
    )
