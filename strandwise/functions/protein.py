"""Column functions on coding sequences, proteins and reduced alphabets."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import IUPAC_BASES, _col

# --- fixed values: the standard genetic code ------------------------------
# Residues by codon, bases in the order TCAG, third base fastest.
CODON_BASE_ORDER = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Residue letters that stand for two residues.
AMBIGUOUS_RESIDUES = {"DN": "B", "EQ": "Z", "IL": "J"}
# The 20 residues and X, the alphabet used when none is given.
RESIDUES = "FYWMLIVATSNHQEDRKCPGX"

CODON_TABLE = {
    "".join(codon): aa for codon, aa in zip(product(CODON_BASE_ORDER, repeat=3), STANDARD_CODE)
}
IDENTITY_ALPHABET = {r: r for r in RESIDUES}


def ambiguous_codons() -> dict[str, str]:
    """Codons with IUPAC codes that still name one residue (or a named pair)."""
    out = {}
    for codon in product(IUPAC_BASES, repeat=3):
        word = "".join(codon)
        if word in CODON_TABLE:
            continue
        found = {CODON_TABLE["".join(c)] for c in product(*[IUPAC_BASES[x] for x in codon])}
        name = "".join(sorted(found))
        if len(found) == 1:
            out[word] = name
        elif name in AMBIGUOUS_RESIDUES:
            out[word] = AMBIGUOUS_RESIDUES[name]
    return out


def _literal_map(table: dict[str, str]) -> Column:
    return F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))


def translate_codons(c: Column | str) -> Column:
    """Protein of a coding sequence by the standard code, stops as `*`.

    A codon that names no single residue gives X; a trailing partial codon is
    left out. Codons come from one linear regex pass, never from repeated
    `substr` over the whole sequence.
    """
    rna_free = F.translate(F.upper(_col(c)), "U", "T")
    plain, ambiguous = _literal_map(CODON_TABLE), _literal_map(ambiguous_codons())
    valid = "^[" + "".join(IUPAC_BASES) + "]{3}$"

    def residue(codon: Column) -> Column:
        return F.coalesce(
            F.element_at(plain, codon),
            F.element_at(ambiguous, codon),
            F.when(codon.rlike(valid), F.lit("X")).otherwise(
                F.raise_error(F.concat(F.lit("not a codon: "), codon))
            ),
        )

    codons = F.regexp_extract_all(rna_free, F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, residue), "")


def protein_of(c: Column | str) -> Column:
    """Protein with every stop removed, internal ones as well."""
    return F.translate(translate_codons(c), "*", "")


def is_valid_cds(c: Column | str, k: int) -> Column:
    """Whole codons, and more of them (stop included) than the word size."""
    n = F.length(_col(c))
    return (n % 3 == 0) & (F.floor(n / 3) > k)


def cds_accession(c: Column | str) -> Column:
    """Accession of a CDS id such as `join(AB1.1:3-9,12-20`."""
    return F.replace(F.substring_index(_col(c), ":", 1), F.lit("join("), F.lit(""))


def has_ambiguous_residue(c: Column | str) -> Column:
    return _col(c).rlike("[JBZ]")


def full_alphabet(alphabet: dict[str, str] | None) -> dict[str, str]:
    """The given residue map with X added, or the identity over 20 residues and X."""
    if alphabet is None:
        return dict(IDENTITY_ALPHABET)
    out = {**alphabet, "X": "X"}
    bad = [k for k, v in out.items() if len(k) != 1 or len(v) != 1]
    if bad:
        raise ValueError(f"residues and classes must be single letters: {bad}")
    return out


def alphabet_encode(c: Column | str, alphabet: dict[str, str] | None = None) -> Column:
    """Protein in a reduced alphabet; a residue outside it is an error."""
    c, table = _col(c), full_alphabet(alphabet)
    known = re.escape("".join(table))
    return F.when(
        c.rlike(f"[^{known}]"),
        F.raise_error(F.concat(F.lit("residue outside the alphabet in "), c)),
    ).otherwise(F.translate(c, "".join(table), "".join(table.values())))


def alphabet_classes(c: Column | str, alphabet: dict[str, str] | None = None) -> Column:
    """As `alphabet_encode`, but residues outside the alphabet become a blank."""
    c, table = _col(c), full_alphabet(alphabet)
    known = re.escape("".join(table))
    return F.translate(
        F.regexp_replace(c, f"[^{known}]", " "), "".join(table), "".join(table.values())
    )


def reduced_motif_regex(c: Column | str, alphabet: dict[str, str] | None = None) -> Column:
    """Search pattern of a reduced word: each class becomes its residues."""
    table = full_alphabet(alphabet)
    classes: dict[str, str] = {}
    for residue, cls in table.items():
        classes[cls] = classes.get(cls, "") + residue
    patterns = {cls: f"[{res}]" if len(res) > 1 else res for cls, res in classes.items()}
    letters = F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0))

    def to_class(x: Column) -> Column:
        return F.coalesce(
            F.element_at(_literal_map(patterns), x),
            F.raise_error(F.concat(F.lit("not a class of the alphabet: "), x)),
        )

    return F.array_join(F.transform(letters, to_class), "")
