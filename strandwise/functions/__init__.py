from strandwise.functions.nucleotide import (  # noqa: F401
    accession,
    decode_bases,
    degenerate_positions,
    encode_bases,
    has_ambiguity,
    motif_regex,
    represented_bases,
    reverse_complement,
)
from strandwise.functions.protein import (  # noqa: F401
    alphabet_encode,
    cds_accession,
    is_valid_cds,
    protein_of,
    translate_codons,
)
from strandwise.functions.scoring import bed_score, binarize, sigmoid  # noqa: F401
