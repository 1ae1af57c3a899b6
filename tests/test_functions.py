from pyspark.sql import functions as F

from strandwise.functions import nucleotide as nt
from strandwise.functions import protein as pr
from strandwise.functions.scoring import bed_score


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x STRING").select(fn(F.col("x")).alias("y")).first()["y"]


def test_reverse_complement(spark):
    assert one(spark, "ACGTRYKMBDHVN", nt.reverse_complement) == "NBDHVKMRYACGT"
    assert one(spark, "acgWS", nt.reverse_complement) == "SWcgt"
    assert one(spark, "GATTACARYN", lambda c: nt.reverse_complement(nt.reverse_complement(c))) == "GATTACARYN"


def test_accessions(spark):
    assert one(spark, "acc|GENBANK|KJ156866.1|x", nt.accession) == "KJ156866.1"
    assert one(spark, "KJ156866.1", nt.accession) == "KJ156866.1"
    assert one(spark, "join(AB1.1:3-9,12-20", pr.cds_accession) == "AB1.1"
    assert one(spark, "AB1.1:3-9", pr.cds_accession) == "AB1.1"


def test_codec_and_pattern(spark):
    assert one(spark, "GTCA", nt.encode_bases) == "0123"
    assert one(spark, "0123", nt.decode_bases) == "GTCA"
    assert one(spark, "ARNX", nt.motif_regex) == "A[AG][ACGT][ACGT]"
    assert one(spark, "ACRTNB", nt.degenerate_positions) == 3
    assert one(spark, "ACRTNB", nt.represented_bases) == 2 + 4 + 3
    assert [one(spark, k, nt.has_ambiguity) for k in ("ACGT", "ACNT", "acnt")] == [False, True, False]


def test_mask_letters_follow_the_code():
    assert nt.MASK_LETTERS[0b0101] == "R" and nt.MASK_LETTERS[0b1111] == "N"
    assert len(nt.MASK_LETTERS) == 16


def test_translation(spark):
    assert one(spark, "ATGAAATAGCCC", pr.translate_codons) == "MK*P"
    assert one(spark, "ATGAAATAGCCC", pr.protein_of) == "MKP"
    assert one(spark, "augAA", pr.translate_codons) == "M"
    # CTN is always L, RAY is D or N, SAR is E or Q, TAR is a stop, NNN is open.
    assert one(spark, "CTNRAYSARTARNNN", pr.translate_codons) == "LBZ*X"


def test_cds_validity(spark):
    check = lambda s, k: one(spark, s, lambda c: pr.is_valid_cds(c, k))
    assert check("ATGAAATAG", 2) and not check("ATGAAATAG", 3) and not check("ATGAAATA", 1)


def test_alphabet(spark):
    table = {"A": "S", "S": "S", "K": "K"}
    assert one(spark, "ASKX", lambda c: pr.alphabet_encode(c, table)) == "SSKX"
    assert one(spark, "SK", lambda c: pr.reduced_motif_regex(c, table)) == "[AS]K"
    try:
        one(spark, "ASW", lambda c: pr.alphabet_encode(c, table))
    except Exception as e:
        assert "outside the alphabet" in str(e)
    else:
        raise AssertionError("unknown residue must be an error")


def test_half_even_score(spark):
    df = spark.createDataFrame([(0.0125,), (0.0135,), (0.5,)], "x DOUBLE")
    assert [r[0] for r in df.select(bed_score("x")).collect()] == [12, 14, 500]
