import random
import re

import pytest
from brute import average_linkage, mismatches
from pyspark.sql import functions as F

from strandwise.operators import binning, clustering, codons, features, hits, kmers, motifs
from strandwise.operators import pairs, proteins, sampling, windows
from strandwise.plans import pipelines
from strandwise.plans.lineage import dense_index

WIDE = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "N": "[ACGT]", "K": "[GT]"}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_windows_cross_tiles(seqs):
    rnd = random.Random(5)
    text = "".join(rnd.choice("ACGT") for _ in range(1500))
    got = rows(windows.kmer_windows(seqs(text), 17), "pos", "kmer")
    assert got == [(i, text[i : i + 17]) for i in range(1500 - 17)]
    for n in (255, 256, 257, 272, 273):
        part = text[:n]
        got = rows(windows.kmer_windows(seqs(part), 17, include_last=True), "pos", "kmer")
        assert got == [(i, part[i : i + 17]) for i in range(n - 16)]


def test_counts_palindromes_and_last_window(seqs):
    assert rows(kmers.kmer_counts(seqs("ACGTA"), 2), "kmer", "cnt") == [("AC", 2), ("CG", 1), ("GT", 2)]
    assert rows(kmers.kmer_counts(seqs("AC", "A", ""), 2), "kmer") == []
    # CG twice: 2 * 2 - 1.
    assert ("CG", 3) in rows(kmers.kmer_counts(seqs("CGTCGTT"), 2), "kmer", "cnt")


def test_counts_agree_with_a_dictionary(seqs):
    rnd = random.Random(2)
    text = "".join(rnd.choice("ACGTN") for _ in range(700))
    comp = str.maketrans("ACGTN", "TGCAN")
    seen = {}
    for i in range(len(text) - 4):
        w = text[i : i + 4]
        c = w.translate(comp)[::-1]
        if w in seen:
            seen[w] += 1
            seen[c] += 1
        else:
            seen[w] = 1
            seen[c] = 1
    got = rows(kmers.kmer_counts(seqs(text), 4), "kmer", "cnt")
    assert got == sorted(seen.items())
    clean = rows(kmers.drop_ambiguous(kmers.kmer_counts(seqs(text), 4)), "kmer")
    assert clean == sorted((k,) for k in seen if "N" not in k)


def test_prevalence_both_ways(seqs):
    df = seqs("ACGTACGGT", "ACGGG", "TTTTT", "CCGTAAA")
    a = rows(kmers.kmer_prevalence(kmers.kmer_counts(df, 3)), "kmer", "prevalence")
    assert a == rows(kmers.sequence_prevalence(df, 3), "kmer", "prevalence")


def test_quantile_is_interpolated_and_strict(spark):
    df = spark.range(10).select((F.col("id") * F.col("id")).alias("v"))
    assert rows(kmers.above_quantile(df, "v", 0.95), "v") == [(81,)]
    flat = spark.range(10).select(F.lit(3).alias("v"))
    assert kmers.above_quantile(flat, "v", 0.5).count() == 0


def test_bin_edges(spark, seqs):
    refs = spark.createDataFrame([(0, 1000), (1, 1050)], "bin INT, ref_len INT")
    df = seqs(*[(str(n), "A" * n) for n in (900, 901, 1099, 1100, 1154, 1155)])
    got = dict(rows(binning.replicon_bin(df, refs, 0.1), "seq_id", "bin"))
    assert got == {"901": 0, "1099": 0, "1100": 1, "1154": 1}


def test_matrix_counts_reference_twice(spark):
    ref = spark.createDataFrame([(0, "r", "x", "ACGTTA")], "bin INT, draw_id STRING, seq_id STRING, seq STRING")
    sample = ref.withColumn("draw_id", F.lit("s"))
    got = kmers.kmer_prevalence(kmers.kmer_matrix(ref, sample, 3))
    assert {r["prevalence"] for r in got.collect()} == {2}


def test_dense_index_is_sorted_and_dense(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10_000_019)).alias("h"))
    got = [r["h"] for r in dense_index(df, ["h"]).orderBy("idx").collect()]
    assert got == sorted(got)
    assert rows(dense_index(df, ["h"]), "idx") == [(i,) for i in range(1000)]
    assert dense_index(df.limit(0), ["h"]).count() == 0


def test_overlapping_hits(seqs, motif_table):
    assert rows(hits.motif_hits(seqs("AAAAA"), motif_table("AAR")), "pos") == [(0,), (1,), (2,)]
    assert rows(hits.motif_hits(seqs("ACNACG"), motif_table("ACN")), "pos") == [(3,)]
    assert rows(hits.motif_hits(seqs("acgacg"), motif_table("ACG")), "pos") == []


def naive_hits(data, names):
    out = []
    for sid, text in data:
        for m in names:
            pattern = re.compile("(?=" + "".join(WIDE[x] for x in m) + ")")
            out += [(sid, m, x.start()) for x in pattern.finditer(text)]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 4, 4096])
@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_hits_of_any_width(seqs, motif_table, limit, broadcast_rows):
    rnd = random.Random(9)
    data = [(f"s{i}", "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([3, 40, 700])))) for i in range(6)]
    names = ["ACR", "NNGRTK", "ANNNC", "KKKKKK"]
    got = hits.motif_hits(seqs(*data), motif_table(*names), max_expand=limit, broadcast_rows=broadcast_rows)
    assert rows(got, "seq_id", "motif", "pos") == naive_hits(data, names)


def test_unknown_motif_letter_is_an_error(seqs, motif_table):
    with pytest.raises(Exception, match="not an IUPAC motif letter"):
        hits.motif_hits(seqs("ACGT"), motif_table("AC?")).collect()


def test_scores_and_bed(seqs, motif_table):
    df, names = seqs("ACGT", "ACGACG", "TTTT"), motif_table("ACG", "GGG")
    found = hits.motif_hits(df, names)
    scores = hits.motif_score_table(found, names, df)
    assert rows(scores, "motif", "total_score") == [("ACG", 667), ("GGG", 0)]
    bed = rows(hits.motif_bed(found, scores), "chr", "start", "end", "name", "score")
    assert bed == [("s0", 0, 3, "ACG", 667), ("s1", 0, 3, "ACG", 667), ("s1", 3, 6, "ACG", 667)]
    none = hits.motif_hits(seqs("TTTT"), names)
    assert hits.motif_bed(none, scores).count() == 0


def test_consensus(spark):
    df = spark.createDataFrame([(1, "ACGT"), (1, "ACAT"), (0, "TTTT")], "cluster_id INT, kmer STRING")
    got = motifs.consensus_motif(df, "m")
    assert rows(got, "cluster_id", "motif_id", "motif") == [(0, "m1", "TTTT"), (1, "m0", "ACRT")]


def test_reverse_complement_ratio(motif_table):
    df = motif_table("AAC", "GTT", "CCC", "ACGT", "AAC")
    assert motifs.rev_comp_ratio(df).first()[0] == 3 / 4
    assert rows(motifs.rev_comp_motifs(df), "motif") == [("AAC",), ("ACGT",), ("GTT",)]


def test_cut_radius():
    assert pairs.cut_radius(15, 2) == (0.13, 1) and pairs.cut_radius(15, 4) == (0.27, 4)
    assert pairs.cut_radius(17, 2) == (0.12, 2) and pairs.cut_radius(17, 4) == (0.24, 4)
    assert pairs.cut_radius(8, 1) == (0.12, 0)


@pytest.mark.parametrize("bucket_rows", [1, 12, 10_000])
def test_pairs_are_complete_and_unique(spark, bucket_rows):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("AAAACGT") for _ in range(8)) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "kmer STRING")
    want = [(a, b, mismatches(a, b)) for a in words for b in words if a < b and mismatches(a, b) <= 2]
    assert rows(pairs.hamming_pairs(df, 2, bucket_rows), "a", "b", "mismatches") == sorted(want)


@pytest.mark.parametrize("k, n, letters, count", [(6, 2.0, "AACGT", 60), (9, 3.0, "AAACGT", 50), (8, 1.0, "ACGT", 20)])
def test_clusters_equal_sequential_linkage(spark, k, n, letters, count):
    rnd = random.Random(count)
    words = sorted({"".join(rnd.choice(letters) for _ in range(k)) for _ in range(count)})
    df = spark.createDataFrame([(w,) for w in words], "kmer STRING")
    got = {}
    for r in clustering.kmer_clusters(df, k, n, seed=3).collect():
        got.setdefault(r["cluster_id"], set()).add(r["kmer"])
    order = df.orderBy(F.xxhash64(F.lit(3), "kmer"), "kmer").collect()
    want = average_linkage([r["kmer"] for r in order], pairs.cut_radius(k, n)[0])
    assert {frozenset(v) for v in got.values()} == set(want)
    assert sorted(w for v in got.values() for w in v) == words


def test_discovered_motifs_match_their_members(seqs):
    rnd = random.Random(4)
    base = "".join(rnd.choice("ACGT") for _ in range(60))
    data = []
    for _ in range(8):
        text = list(base)
        text[rnd.randrange(60)] = rnd.choice("ACGT")
        data.append("".join(text))
    found = pipelines.discover_motifs(seqs(*data), k=8, n=2.0, q=0.5, seed=1)
    names = [r["motif"] for r in found.collect()]
    assert names and all(len(m) == 8 for m in names)
    assert hits.motif_hits(seqs(*data), found).count() > 0


def test_align_and_score(spark):
    feats = spark.createDataFrame([("a", "M1", 2), ("a", "ZZ", 5), ("b", "ZZ", 1)], "accession STRING, motif STRING, cnt BIGINT")
    aligned = features.feature_align(feats, ["M2", "M1"])
    assert rows(aligned, "accession", "x") == [("a", [0.0, 2.0]), ("b", [0.0, 0.0])]
    coefs = spark.createDataFrame([("M1", 0.5)], "motif STRING, coef DOUBLE")
    got = rows(features.score_sequences(feats, coefs), "accession", "predict", "predict_proba")
    assert got[0][:2] == ("a", 1) and abs(got[0][2] - 0.7310585786300049) < 1e-12
    assert got[1] == ("b", 0, 0.5)


def test_published_weight_of_one_motif(seqs, spark):
    coefs = spark.createDataFrame([("CWCARGATGGTAATGCT", 1.370962695524669)], "motif STRING, coef DOUBLE")
    got = pipelines.predict_sequences(seqs("GG" + "CACAAGATGGTAATGCT" + "GGGG", "ACGT"), coefs)
    got = {r["accession"]: r for r in got.collect()}
    assert got["s0"]["predict"] == 1 and abs(got["s0"]["predict_proba"] - 0.797555) < 1e-4
    assert got["s1"]["predict"] == 0 and got["s1"]["predict_proba"] == 0.5


def test_labels(spark):
    feats = spark.createDataFrame([(a, "M", 1) for a in "abcd"], "accession STRING, motif STRING, cnt BIGINT")
    meta = spark.createDataFrame(
        [("a", 1, "g"), ("b", -1, "g"), ("c", None, "g"), ("x", 0, "g")],
        "accession STRING, label INT, groups STRING",
    )
    assert rows(features.labelled_features(feats, meta), "accession", "label") == [("a", 1)]
    assert rows(features.labelled_semi(feats, meta), "accession") == [("a",)]


def test_resample_quotas(spark):
    data = [(f"r{i}", "big" if i < 70 else f"g{i % 7}") for i in range(100)]
    df = spark.createDataFrame(data, "id STRING, grp STRING")
    out = sampling.stratified_resample(df, 57, "grp", "id", seed=1)
    assert out.count() == 57
    quota = {r["grp"]: r["quota"] for r in sampling.stratum_quotas(df, 57, "grp", 1).collect()}
    assert sum(quota.values()) == 57 and quota["big"] in (39, 40)
    drawn = {r["grp"]: r["count"] for r in out.groupBy("grp").count().collect()}
    assert drawn == {g: q for g, q in quota.items() if q}
    assert rows(out, "id", "draw_no") == rows(sampling.stratified_resample(df, 57, "grp", "id", seed=1), "id", "draw_no")
    by = sampling.stratified_resample(df.withColumn("bin", F.length("id")), 30, "grp", "id", 1, ["bin"])
    assert {r["bin"]: r["count"] for r in by.groupBy("bin").count().collect()} == {2: 30, 3: 30} or by.count() % 30 == 0


def test_group_splits_never_straddle(spark):
    df = spark.createDataFrame([(f"g{i % 13}",) for i in range(100)], "grp STRING")
    out = sampling.group_shuffle_split(df, "grp", 4, 0.1, seed=2)
    assert out.count() == 4 * 13
    assert {r["n"] for r in out.filter("is_test").groupBy("split").agg(F.count("*").alias("n")).collect()} == {2}


def test_folds_are_balanced_per_label(spark):
    df = spark.createDataFrame([(f"r{i}", int(i < 20)) for i in range(100)], "id STRING, label INT")
    out = sampling.stratified_kfold(df, "label", "id", 5, seed=2)
    assert {r["count"] for r in out.filter("label = 1").groupBy("fold").count().collect()} == {4}
    assert {r["count"] for r in out.filter("label = 0").groupBy("fold").count().collect()} == {16}


def cds(spark, *data):
    return spark.createDataFrame(list(data), "seq_id STRING, accession STRING, seq STRING")


def test_words_span_removed_stops(spark):
    df = cds(spark, ("x", "A1", "ATGAAATAGCCC"), ("y", "A2", "ATGA"), ("z", "A1", "RAYATGAAACCC"))
    got = rows(proteins.amino_kmer_counts(df, 2).filter("word is not null"), "accession", "word", "cnt")
    assert got == [("A1", "KP", 1), ("A1", "MK", 1)]
    silent = proteins.amino_kmer_counts(df, 2).filter("word is null")
    assert rows(silent, "accession", "cnt") == [("A2", 0)]


def test_locations_do_not_overlap(spark):
    code = {"A": "GCT", "K": "AAA"}
    text = "".join(code[x] for x in "AAKAAKKAAAAK")
    coefs = spark.createDataFrame([("AC", 0.5)], "motif STRING, coef DOUBLE")
    table = {"A": "A", "K": "C", "C": "C"}
    got = proteins.amino_motif_locations(cds(spark, ("x", "acc", text)), coefs, table)
    assert rows(got, "start", "end", "amino_match") == [(1, 3, "AK"), (4, 6, "AK"), (10, 12, "AK")]
    same = {"A": "A", "K": "A"}
    coefs = spark.createDataFrame([("AA", 0.5)], "motif STRING, coef DOUBLE")
    got = proteins.amino_motif_locations(cds(spark, ("x", "acc", text)), coefs, same)
    assert rows(got, "start") == [(0,), (2,), (4,), (6,), (8,), (10,)]


def test_locations_of_repeated_ids(spark):
    code = {"A": "GCT", "M": "ATG"}
    text = lambda p: "".join(code[x] for x in p)
    coefs = spark.createDataFrame([("AA", 0.5)], "motif STRING, coef DOUBLE")
    df = cds(spark, ("x", "acc", text("MAA")), ("x", "acc", text("AAM")), ("x", "acc", text("AAM")))
    got = proteins.amino_motif_locations(df, coefs, {"A": "A", "M": "M"})
    assert rows(got, "start", "amino_match") == [(0, "AA"), (0, "AA"), (1, "AA")]


def test_codons(spark):
    df = cds(spark, ("x", "A1", "CTTCTTCTCATG" + "AT"), ("y", "A2", "cttNNN"))
    usage = codons.codon_usage(df)
    assert rows(usage, "accession", "codon", "cnt") == [("A1", "ATG", 1), ("A1", "CTC", 1), ("A1", "CTT", 2)]
    freq = {r["codon"]: r["rel_freq"] for r in codons.relative_codon_freq(usage).collect()}
    assert freq == {"ATG": 1.0, "CTC": 1 / 3, "CTT": 2 / 3}


def test_mapping_diff(spark):
    a = spark.createDataFrame([("A", "S"), ("C", "C"), ("D", None)], "r STRING, v STRING")
    b = spark.createDataFrame([("A", "T"), ("C", "C"), ("D", "E")], "r STRING, v STRING")
    assert rows(codons.mapping_diff(a, b, "r", "v"), "r", "right_value") == [("A", "T"), ("D", "E")]


def test_bins_of_long_references_make_few_rows(spark):
    """A genome of 250 million letters; a thousand references against a plain search."""
    long = spark.createDataFrame([(0, 250_000_000)], "bin INT, ref_len INT")
    assert binning.length_bins(long, 0.1).count() < 20
    rng = random.Random(4)
    refs = [(i, rng.choice([0, 1, 7, 30, 33, rng.randrange(1, 3000), rng.randrange(1, 60_000)])) for i in range(300)]
    table = binning.length_bins(spark.createDataFrame(refs, "bin INT, ref_len INT"), 0.1).collect()
    probes = sorted({*range(0, 200), *(rng.randrange(70_000) for _ in range(3000))})
    lengths = spark.createDataFrame([(n,) for n in probes], "n LONG").select("n", binning._bucket(F.col("n")).alias("b"))
    buckets = {r["n"]: r["b"] for r in lengths.collect()}
    assert all(buckets[a] <= buckets[b] for a, b in zip(probes, probes[1:]))
    for n in probes:
        got = [r["bin"] for r in table if r["bucket"] == buckets[n] and r["first"] <= n < r["stop"]]
        want = [i for i, size in refs if size - size * 0.1 < n < size + size * 0.1]
        assert got == [min(want)] if want else got == [], n


@pytest.fixture
def bin_input(spark, seqs):
    rng = random.Random(8)
    texts = {f"a{i}": "".join(rng.choices("ACGT", k=rng.randrange(95, 105))) for i in range(12)}
    texts |= {f"b{i}": "".join(rng.choices("ACGTN", (9, 9, 9, 9, 1), k=rng.randrange(290, 310))) for i in range(9)}
    refs = [(0, "ra", texts["a0"]), (1, "rb", texts["b0"])]
    meta = [(s, 1, "s", s[0] + str(int(s[1:]) % 2)) for s in texts]
    return (
        seqs(*texts.items()),
        spark.createDataFrame(refs, "bin INT, seq_id STRING, seq STRING"),
        spark.createDataFrame(meta, "accession STRING, label INT, species STRING, groups STRING"),
    )


def test_weights_count_like_copies(spark, bin_input):
    data, refs, meta = bin_input
    records = pipelines.bin_records(data, refs, 0.1, draws=40, meta=meta, seed=3).cache()
    total = records.filter("draw_id = 'sample'").groupBy("bin").agg(F.sum("weight").alias("n"))
    assert {r["n"] for r in total.collect()} == {40}
    copies = records.withColumn("draw_id", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn(
        "draw_id", F.concat_ws("#", "draw_id", "seq_id")
    )
    matrix = kmers.drop_ambiguous(kmers.kmer_counts(copies, 5, key=["bin", "draw_id", "seq_id"]))
    want = matrix.groupBy("bin", "kmer").agg(F.count("*").alias("prevalence"))
    got = kmers.weighted_prevalence(records, "bin", 5)
    assert rows(got, "bin", "kmer", "prevalence") == rows(want, "bin", "kmer", "prevalence")
    kept = kmers.high_freq_kmers(got, 0.9, ["bin"])
    for b in (0, 1):
        own = kmers.high_freq_kmers(got.filter(F.col("bin") == b).drop("bin"), 0.9)
        assert rows(kept.filter(F.col("bin") == b), "kmer", "prevalence") == rows(own, "kmer", "prevalence")


def test_all_bins_at_once_equal_one_bin_each(spark, bin_input):
    data, refs, _ = bin_input
    records = pipelines.bin_records(data, refs, 0.1).cache()
    together = pipelines.discover_motifs_by_bin(records, 6, 2.0, 0.9, "m", seed=3).collect()
    for b in (0, 1):
        alone = pipelines.discover_motifs_by_bin(records.filter(F.col("bin") == b), 6, 2.0, 0.9, "m", seed=3)
        got = sorted((r["motif_id"], r["motif"]) for r in together if r["bin"] == b)
        assert got and got == rows(alone, "motif_id", "motif")


def test_samples_without_a_group_are_an_error(bin_input):
    data, refs, meta = bin_input
    with pytest.raises(ValueError):
        pipelines.bin_records(data, refs, 0.1, draws=5, meta=meta.limit(3), seed=1)
    with pytest.raises(ValueError):
        pipelines.bin_records(data, refs, 0.1, draws=5)
