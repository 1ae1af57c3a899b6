"""Protein words counted and located in tasks, against plain text code."""

import random
from collections import Counter

import pytest

from strandwise.functions.protein import CODON_TABLE, ambiguous_codons
from strandwise.operators import codes, proteins

CODONS = {**ambiguous_codons(), **CODON_TABLE}
ALPHABET = {"A": "S", "S": "S", "K": "K", "R": "K", "M": "M", "X": "X"}


def protein(seq):
    seq = seq.upper().replace("U", "T")
    return "".join(CODONS.get(seq[i : i + 3], "X") for i in range(0, len(seq) - 2, 3)).replace("*", "")


@pytest.fixture
def records():
    r = random.Random(8)
    own = ["GCT", "AGC", "AAA", "CGT", "atg", "TAA", "GCN", "NNN", "aug"]
    make = lambda n, more=(): "".join(r.choices([*own, *more], k=n))
    one = make(60)
    rows = [("a", "A1", one), ("a", "A1", one), ("b", "A1", make(500)), ("c", None, make(30)), (None, "A2", make(40, ["RAY"] * 9)),
            ("d", "A3", None), ("e", "A3", "TAA" * 20), ("f", "A4", make(20) + "GC"), ("g", "A4", ""), ("h", "A5", "GCT" * 40)]
    return rows + [(f"r{i}", f"A{i % 3}", make(i)) for i in range(30)]


@pytest.mark.parametrize("k, step", [(1, 50), (3, 1 << 20), (6, 50), (9, 1 << 20), (11, 50)])
def test_word_counts(spark, records, monkeypatch, k, step):
    monkeypatch.setattr(codes, "STEP_LETTERS", step)
    df = spark.createDataFrame(records, "seq_id STRING, accession STRING, seq STRING")
    want = {str(a): Counter() for _, a, _ in records}
    for _, accession, seq in records:
        if seq is not None and len(seq) % 3 == 0 and len(seq) // 3 > k and not set(p := protein(seq)) & set("JBZ"):
            text = "".join(ALPHABET[x] for x in p)
            want[str(accession)].update(text[i : i + k] for i in range(len(text) - k + 1))
    counted = proteins.amino_kmer_counts(df, k, ALPHABET)
    got = sorted((str(r.accession), str(r.word), r.cnt) for r in counted.collect())
    assert got == sorted((a, w, n) for a, c in want.items() for w, n in (c or {"None": 0}).items())
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and ("posexplode" in plan) == (k > 9)


def test_counting_errors(spark):
    df = lambda seq: spark.createDataFrame([("x", "A", seq)], "seq_id STRING, accession STRING, seq STRING")
    with pytest.raises(Exception, match=r"not a codon: A\?T"):
        proteins.amino_kmer_counts(df("GCTGCTA?TGCT"), 2).collect()
    with pytest.raises(Exception, match="residue outside the alphabet in AAW"):
        proteins.amino_kmer_counts(df("GCTGCTTGG"), 2, ALPHABET).collect()


@pytest.mark.parametrize("step", [50, 1 << 20])
@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_locations(spark, records, monkeypatch, step, broadcast_rows):
    """Ids and words that repeat, residues outside the alphabet, words of several lengths."""
    monkeypatch.setattr(codes, "STEP_LETTERS", step)
    df = spark.createDataFrame(records, "seq_id STRING, accession STRING, seq STRING")
    words = [("SS", 0.5), ("SKS", 1.0), ("SS", 0.5), ("SS", 2.0), ("SSSSSSSSSS", 1.5), ("M", 3.0), ("Q!", 1.0), ("S S", 4.0)]
    want = []
    for name, accession, seq in records:
        p = protein(seq or "")
        text = "".join(ALPHABET.get(x, " ") for x in p)
        for word, coef in words:
            at = text.find(word)
            while at >= 0:
                want.append((p[at : at + len(word)], at, at + len(word), word, str(name), str(accession), coef))
                at = text.find(word, at + len(word))
    coefs = spark.createDataFrame(words, "motif STRING, coef DOUBLE")
    found = proteins.amino_motif_locations(df, coefs, ALPHABET, broadcast_rows)
    got = [(r.amino_match, r.start, r.end, r.motif, str(r["name"]), str(r.accession), r.coef) for r in found.collect()]
    assert sorted(got) == sorted(want)
    only = proteins.amino_motif_locations(df, coefs.filter("length(motif) < 10"), ALPHABET, broadcast_rows)
    assert ("posexplode" in only._jdf.queryExecution().optimizedPlan().toString()) == (broadcast_rows == 0)
