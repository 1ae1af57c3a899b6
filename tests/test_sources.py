import gzip
import json

import pytest

from strandwise import sources
from strandwise.operators.proteins import with_accession
from strandwise.sources import fasta, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fasta_folder(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b"junk line\n>a1 desc > more\r\nACGT\r\nAC\r\n\r\n>a2\r\nGG\r\n")
    (tmp_path / "b.fna").write_text(">b1|x|KJ.1|z foo\nACG\nT\n>b2\n\n>b3\nT")
    (tmp_path / "c.fasta").write_text("\n>c1\nAC")
    (tmp_path / "notes.txt").write_text(">no\nAC\n")
    with gzip.open(tmp_path / "d.fasta.gz", "wt") as f:
        f.write(">d1\nGGG\nCC\n")
    got = rows(sources.read_fasta_folder(spark, str(tmp_path)), "seq_id", "description", "seq")
    assert got == [
        ("a1", "a1 desc > more", "ACGTAC"),
        ("a2", "a2", "GG"),
        ("b1|x|KJ.1|z", "b1|x|KJ.1|z foo", "ACGT"),
        ("b2", "b2", ""),
        ("b3", "b3", "T"),
        ("c1", "c1", "AC"),
        ("d1", "d1", "GGGCC"),
    ]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m0", "ACRT"), ("m1", "NNN")], "motif_id STRING, motif STRING")
    fasta.write_fasta(df, str(tmp_path / "out"), "motif_id", "motif")
    got = sources.read_fasta(spark, str(tmp_path / "out"), clean=True)
    assert rows(got, "seq_id", "seq") == [("m0", "ACRT"), ("m1", "NNN")]


def test_bed_both_layouts(spark, tmp_path):
    data = [("a|b|X1|c", 0, 3, "ACG", 667), ("s2", 5, 8, "ACG", 667), ("s2", 7, 10, "GGR", 333)]
    bed = spark.createDataFrame(data, tables.BED_SCHEMA)
    tables.write_bed(bed, str(tmp_path / "many"), per_sequence=True)
    names = sorted(p.name for p in (tmp_path / "many").glob("sequence=*"))
    assert names == ["sequence=a_b_X1_c", "sequence=s2"]
    assert rows(tables.read_bed(spark, str(tmp_path / "many")), *bed.columns) == sorted(data)
    assert rows(tables.read_bed_folders(spark, str(tmp_path / "many")), *bed.columns) == sorted(data)
    tables.write_bed(bed, str(tmp_path / "flat"))
    got = tables.read_bed(spark, str(tmp_path / "flat"), rvdb=True)
    assert rows(got, "chr", "start") == [("X1", 0), ("s2", 5), ("s2", 7)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x_primers.bed").write_text("x\t1\t4\tACG\t10\n")
    (tmp_path / "files" / "x.txt").write_text("x\t9\t9\tACG\t10\n")
    assert rows(tables.read_bed(spark, str(tmp_path / "files")), "chr", "end") == [("x", 4)]


def test_metadata_by_name(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("label\taccession\textra\n1\tA\tx\n-1\tB\ty\n")
    got = sources.read_metadata(spark, str(tmp_path / "m.tsv"))
    assert rows(got, "accession", "label") == [("A", 1), ("B", -1)]
    assert got.columns == ["accession", "label", "species", "groups"]


def test_small_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("ACG\t0.5\nGGR\t-1.25\n")
    assert rows(sources.read_coefficients(spark, str(tmp_path / "c.tsv")), "motif", "coef") == [("ACG", 0.5), ("GGR", -1.25)]
    (tmp_path / "a.json").write_text(json.dumps({"A": "S", "S": "S"}))
    assert sources.read_alphabet(spark, str(tmp_path / "a.json")) == {"A": "S", "S": "S", "X": "X"}
    assert rows(tables.alphabet_rows(spark, str(tmp_path / "a.json")), "residue", "class") == [("A", "S"), ("S", "S")]
    (tmp_path / "g.json").write_text('{"max_depth": [2, 3], "eta": 0.1}')
    assert sources.read_grid(spark, str(tmp_path / "g.json")) == {"max_depth": [2, 3], "eta": [0.1]}
    (tmp_path / "codons.tsv").write_text("codon\tamino\nATG\tM\n")
    assert rows(sources.codon_table(spark, str(tmp_path / "codons.tsv")), "codon", "amino") == [("ATG", "M")]
    assert sources.codon_table(spark).count() == 64


def test_matrix_and_vocabulary_round_trip(spark, tmp_path):
    matrix = spark.createDataFrame(
        [(0, "s", "x", "ACG", 2), (1, "s", "y", "CCG", 1)], "bin INT, draw_id STRING, seq_id STRING, kmer STRING, cnt BIGINT"
    )
    tables.write_kmer_matrix(matrix, str(tmp_path / "m"))
    assert rows(tables.read_kmer_matrix(spark, str(tmp_path / "m")), "bin", "kmer", "cnt") == [(0, "ACG", 2), (1, "CCG", 1)]
    vocab = spark.createDataFrame([(0, "ACG")], "idx BIGINT, feature STRING")
    tables.write_vocabulary(vocab, str(tmp_path / "v"))
    assert rows(tables.read_vocabulary(spark, str(tmp_path / "v")), "idx", "feature") == [(0, "ACG")]


def test_duplicates_are_reported(spark):
    df = spark.createDataFrame([("a", "AC"), ("a", "GG"), ("b", "T")], "seq_id STRING, seq STRING")
    assert rows(tables.duplicate_ids(df), "seq_id", "n") == [("a", 2)]
    assert rows(tables.unique_records(df), "seq_id", "seq") == [("a", "GG"), ("b", "T")]


def test_cds_headers(spark):
    df = spark.createDataFrame([("join(AB1.1:3-9,12-20", "ATG")], "seq_id STRING, seq STRING")
    assert rows(with_accession(df), "accession") == [("AB1.1",)]


def test_reports(spark, tmp_path):
    from strandwise.operators import motifs

    names = spark.createDataFrame([("ACR",), ("YGT",), ("NNA",)], "motif STRING")
    tables.write_degeneracy_summary(motifs.motif_degeneracy(names), str(tmp_path / "deg"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "deg")).collect())
    assert lines == [
        "Average number of bases represented in degenerate motifs:\t4.0",
        f"Average number of degenerate positions:\t{4 / 3}",
    ]
    tables.write_complement_report(
        motifs.rev_comp_ratio(names), motifs.rev_comp_motifs(names), str(tmp_path / "rc")
    )
    kept = sorted(r["value"] for r in spark.read.text(str(tmp_path / "rc" / "motifs")).collect())
    assert kept == ["ACR", "YGT"]


def test_labels_with_a_decimal_point(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("accession\tlabel\nA\t1.0\nB\t\nC\t-1\nD\t0.0\n")
    got = {r.accession: r.label for r in sources.read_metadata(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {"A": 1, "B": None, "C": -1, "D": 0}
    (tmp_path / "n.tsv").write_text("accession\tlabel\nA\t0.5\n")
    with pytest.raises(Exception, match="not a whole label"):
        sources.read_metadata(spark, str(tmp_path / "n.tsv")).collect()
