"""Plans that must not shuffle windows."""

import contextlib
import io

from pyspark.sql import functions as F

from strandwise.operators import hits, kmers
from strandwise.plans import registry
from strandwise.plans.lineage import by_record


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_counting_shuffles_records_only(seqs):
    counts = kmers.kmer_counts(by_record(seqs("ACGTACGT"), "seq_id"), 3)
    text = plan(counts)
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION" in text


def test_prevalence_adds_one_shuffle(seqs):
    text = plan(kmers.sequence_prevalence(by_record(seqs("ACGTACGT"), "seq_id"), 3))
    assert text.count("Exchange hashpartitioning") == 2 and "partial_count" in text


def test_hits_do_not_shuffle_windows(seqs, motif_table):
    few = plan(hits.motif_hits(seqs("ACGTACGT"), motif_table("ACR")))
    assert "BroadcastHashJoin" in few and "hashpartitioning" not in few


def test_references_derive_no_other_sequence(spark, tmp_path):
    rows = [(1, "web", "Ab c"), (2, "web", "zz"), (4, "code", None), (3, "code", "a-z"), (3, "code", "y"), (5, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    refs = registry._references(spark, str(tmp_path))
    text = plan(refs.filter(F.length("seq") > 0))
    assert "regexp_replace" not in text and "hashpartitioning" not in text
    assert sorted(map(tuple, refs.collect())) == [(1, "D1", "ACG"), (3, "D3", "A"), (3, "D3", "AC")]


def test_matrix_rows_are_not_sorted(spark, tmp_path):
    """The least text of a group would need a sort of all its windows in each task."""
    rows = [(1, "web", "acca gtc tag" * 9), (2, "web", "acca gtc tag" * 9 + "a"), (3, "code", "zyx" * 40), (4, "code", "b" * 115)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.kmer_matrix(spark, str(tmp_path))
    text = plan(found)
    assert "MapInArrow" in text and "SortAggregate" not in text
    assert text.index("MapInArrow") < text.index("Sort ")  # only records are sorted, below the tasks that cut them
    refs = registry._references(spark, str(tmp_path)).withColumn("draw_id", F.lit("reference"))
    binned = registry._binned(spark, str(tmp_path)).withColumn("draw_id", F.lit("sample"))
    matrix = kmers.kmer_matrix(refs, binned, registry.K)
    want = matrix.groupBy("bin", "draw_id", "seq_id").agg(F.count("*"), F.sum("cnt"), F.min("kmer"), F.max("kmer"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 4
