"""Protein words: counting, abundance filter and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.protein import (
    alphabet_classes,
    alphabet_encode,
    cds_accession,
    has_ambiguous_residue,
    is_valid_cds,
    protein_of,
)
from strandwise.operators.kmers import above_quantile
from strandwise.operators.residues import Classes, any_word, word_counts, word_places
from strandwise.operators.windows import kmer_windows
from strandwise.plans.lineage import BROADCAST_ROWS, broadcast_if_small


def with_accession(cds: DataFrame) -> DataFrame:
    return cds.withColumn("accession", cds_accession("seq_id"))


def cds_translate(cds: DataFrame, k: int = 6) -> DataFrame:
    """`accession, seq_id, protein` of the valid coding sequences, stops removed."""
    return cds.filter(is_valid_cds("seq", k)).select(
        "accession", "seq_id", protein_of("seq").alias("protein")
    )


def amino_kmer_counts(
    cds: DataFrame, k: int = 6, alphabet: dict[str, str] | None = None
) -> DataFrame:
    """`accession, word, cnt` over all coding sequences of an accession.

    Proteins with J, B or Z are skipped. An accession without any word keeps
    one row with a null word and count 0. Tasks translate and count; their sums
    are shuffled by (accession, word), so a large accession spreads.
    """
    classes = Classes(alphabet)
    # Not a filter: pushed down it would derive the sequence once for each use of its length.
    valid = cds.select("accession", F.when(is_valid_cds("seq", k), F.col("seq")).alias("seq"))
    if classes.fits(k):
        words = word_counts(valid, k, classes)
    else:
        proteins = cds_translate(cds, k).filter(~has_ambiguous_residue("protein"))
        encoded = proteins.select("accession", alphabet_encode("protein", alphabet).alias("seq"))
        words = kmer_windows(encoded, k, include_last=True, key=["accession"]).select(
            "accession", F.col("kmer").alias("word"), F.lit(1).cast("bigint").alias("n")
        )
    counts = words.groupBy("accession", "word").agg(F.sum("n").alias("cnt"))
    # Whether an accession has any word shows in its proteins; the words
    # themselves need not be made a second time.
    silent = any_word(valid, k).groupBy("accession").agg(F.max("any").alias("any")).filter(~F.col("any"))
    return counts.unionByName(
        silent.select(
            "accession",
            F.lit(None).cast("string").alias("word"),
            F.lit(0).cast("bigint").alias("cnt"),
        )
    )


def amino_high_abundance(counts: DataFrame, q: float) -> DataFrame:
    """`word, total`: words whose total count is strictly above the quantile."""
    totals = counts.filter(F.col("word").isNotNull()).groupBy("word").agg(
        F.sum("cnt").alias("total")
    )
    return above_quantile(totals, "total", q)


def keep_words(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Counts of the given words; accessions left without any keep a null row."""
    kept = counts.join(words.select("word"), "word", "left_semi")
    silent = counts.select("accession").distinct().join(kept, "accession", "left_anti")
    return kept.select("accession", "word", "cnt").unionByName(
        silent.select(
            "accession",
            F.lit(None).cast("string").alias("word"),
            F.lit(0).cast("bigint").alias("cnt"),
        )
    )


def amino_motif_locations(
    cds: DataFrame,
    coefs: DataFrame,
    alphabet: dict[str, str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Where the words of a model occur: `amino_match, start, end, motif, name,
    accession, coef`, non-overlapping hits from left to right.

    A class pattern matches exactly where the window spells the word in the
    reduced alphabet, so hits are looked up by equality: tasks translate a record,
    look up its windows' codes and resolve overlaps per word; a hit counts unless
    it begins inside the last one that counted. The hits are joined to `coefs`.
    Words that tasks can't look up (long ones, or more than `broadcast_rows`) are
    joined to all windows.

    Records are told apart by their text as well as their id, so ids may repeat;
    a record that is there n times has each of its positions n times.
    """
    name = "description" if "description" in cds.columns else "seq_id"
    classes = Classes(alphabet, " ")
    few = coefs.limit(broadcast_rows + 1).count() <= broadcast_rows
    widths = sorted(r["w"] for r in coefs.select(F.length("motif").alias("w")).distinct().collect())
    coded = [k for k in widths if few and classes.fits(k)]
    out = None
    if coded:
        own = coefs.filter(F.length("motif").isin(coded))
        listed = own.select("motif").distinct().toArrow().column(0).to_pylist()
        named = cds.select("accession", F.col(name).alias("name"), "seq")
        k = F.length("motif")
        out = word_places(named, listed, classes).join(F.broadcast(own), "motif").select(
            "amino_match", F.col("pos").alias("start"), (F.col("pos") + k).alias("end"), "motif", "name", "accession", "coef"
        )
    for k in widths:
        if k not in coded:
            located = _joined_locations(cds, name, coefs, k, alphabet, broadcast_rows)
            out = located if out is None else out.unionByName(located)
    return out


def _joined_locations(
    cds: DataFrame, name: str, coefs: DataFrame, k: int, alphabet: dict[str, str] | None, broadcast_rows: int
) -> DataFrame:
    """Locations of the words of k letters: all windows joined to them, overlaps resolved per
    record and word. Those lists are bounded by one protein's length."""
    record = ["seq_id", "accession", "name", "record"]
    proteins = cds.select(
        "seq_id",
        "accession",
        F.col(name).alias("name"),
        F.xxhash64("seq").alias("record"),
        protein_of("seq").alias("seq"),
    )
    words = broadcast_if_small(coefs, broadcast_rows)
    windows = kmer_windows(proteins, k, True, record).withColumnRenamed("kmer", "amino_match")
    hits = (
        windows.withColumn("motif", alphabet_classes("amino_match", alphabet))
        .join(words, "motif")
        .groupBy(*record, "motif", "coef", "pos", "amino_match")
        .agg(F.count("*").alias("times"))
        .groupBy(*record, "motif", "coef")
        .agg(
            F.max("times").cast("int").alias("times"),
            F.sort_array(F.collect_list(F.struct("pos", "amino_match"))).alias("at"),
        )
    )
    never = F.lit(-k).cast("bigint")
    kept = F.aggregate(
        "at",
        F.struct(
            never.alias("last"),
            F.array().cast("array<struct<pos:bigint,amino_match:string>>").alias("kept"),
        ),
        lambda acc, hit: F.when(
            hit["pos"] >= acc["last"] + k,
            F.struct(
                hit["pos"].alias("last"), F.array_append(acc["kept"], hit).alias("kept")
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    copies = F.flatten(F.array_repeat(kept, F.col("times")))
    return hits.select("accession", "name", "motif", "coef", F.explode(copies).alias("hit")).select(
        F.col("hit.amino_match").cast("string").alias("amino_match"),
        F.col("hit.pos").alias("start"),
        (F.col("hit.pos") + k).alias("end"),
        "motif",
        "name",
        "accession",
        "coef",
    )
