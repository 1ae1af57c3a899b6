from strandwise.sources.fasta import read_fasta, read_fasta_folder, write_fasta  # noqa: F401
from strandwise.sources.tables import (  # noqa: F401
    codon_table,
    read_alphabet,
    read_bed,
    read_coefficients,
    read_grid,
    read_metadata,
    write_bed,
    write_csv,
    write_tsv,
)
