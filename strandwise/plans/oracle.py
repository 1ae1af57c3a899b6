"""DuckDB SQL for the registered queries, over the same tables.

Shared pieces are common table expressions; `_with` puts the ones a query
needs in front of it.
"""

from __future__ import annotations

from strandwise.functions.nucleotide import IUPAC_BASES, PATTERN_BASES
from strandwise.functions.protein import CODON_TABLE, STANDARD_CODE
from strandwise.plans import registry as r
from strandwise.sources import derived

K = r.K


def _letters(target: str, text: str = "text") -> str:
    return (
        f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), "
        f"'{derived.LETTERS}', '{target}')"
    )


def _rc(c: str) -> str:
    return f"reverse(translate({c}, 'ACGTRYKMBDHVNSW', 'TGCAYRMKVHDBNSW'))"


def _windows(source: str, k: int, last: bool, key: str = "seq_id", seq: str = "seq") -> str:
    stop = f"length({seq}) - {k}" + (" + 1" if last else "")
    return (
        f"SELECT {key}, i AS pos, substr({seq}, CAST(i AS BIGINT) + 1, {k}) AS kmer FROM "
        f"(SELECT {key}, {seq}, unnest(range(0, {stop})) AS i FROM {source})"
    )


def _regex(motif: str) -> str:
    return "".join(f"[{PATTERN_BASES[x]}]" if len(PATTERN_BASES[x]) > 1 else x for x in motif)


def _hits(names: list[str]) -> str:
    widths = sorted({len(m) for m in names})
    parts = []
    for m in names:
        parts.append(
            f"SELECT seq_id, '{m}' AS motif, pos FROM w{len(m)} "
            f"WHERE regexp_full_match(kmer, '{_regex(m)}')"
        )
    wins = ", ".join(f"w{w} AS ({_windows('seqs', w, True)})" for w in widths)
    return f"{wins}, hits AS ({' UNION ALL '.join(parts)})"


def _md5(*cols: str) -> str:
    return "md5(concat_ws('|', '7', " + ", ".join(cols) + "))"


_WEIGHTS = ", ".join(f"('{m}', {w})" for m, w in r.WEIGHTS.items())
_CODON_ROWS = ", ".join(f"('{c}', '{a}')" for c, a in CODON_TABLE.items())
_KEYS, _CLASSES = "".join(r.ALPHABET), "".join(r.ALPHABET.values())
_IUPAC_ROWS = ", ".join(f"('{bases}', '{x}')" for x, bases in IUPAC_BASES.items())
_TWO = "".join(x for x, b in IUPAC_BASES.items() if len(b) == 2)
_THREE = "".join(x for x, b in IUPAC_BASES.items() if len(b) == 3)


def _quotas(source: str, n: int, by: str = "") -> str:
    """Largest-remainder quotas and ranked members of `source`, per `by`."""
    p = f"PARTITION BY {by} " if by else ""
    g = f"{by}, groups" if by else "groups"
    b = f"{by}, " if by else ""
    return f"""
sizes AS (SELECT {g}, count(*) AS size FROM {source} GROUP BY {g}),
shared AS (SELECT {b}groups, size, ({n} * size) // total AS base, ({n} * size) % total AS rest
  FROM (SELECT *, sum(size) OVER ({p}) AS total FROM sizes)),
quotas AS (SELECT {b}groups, size, base + CASE WHEN row_number() OVER ({p}ORDER BY rest DESC,
    {_md5('groups')}) <= {n} - sum(base) OVER ({p}) THEN 1 ELSE 0 END AS quota FROM shared),
members AS (SELECT {g}, accession, row_number() OVER (PARTITION BY {g}
    ORDER BY {_md5('accession')}, accession) - 1 AS rnk FROM {source}),
draws AS (SELECT {b}groups, size, unnest(range(1, CAST(quota AS BIGINT) + 1)) AS draw_no FROM quotas),
picks AS (SELECT {b}groups, draw_no,
    CAST(concat('0x', substr({_md5('groups', 'draw_no')}, 1, 15)) AS BIGINT) % size AS rnk FROM draws)
"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def _seqs(target: str = derived.TO_BASES) -> str:
    return f"seqs AS (SELECT concat('D', doc_id) AS seq_id, {_letters(target)} AS seq FROM documents)"


SEQS = _seqs()
META = """meta AS (SELECT concat('D', d.doc_id) AS accession,
  CASE WHEN l.toxic = 1 THEN -1 ELSE l.quality END AS label, d.source AS groups
  FROM documents d JOIN labels l USING (doc_id))"""
HEADERS = """headers AS (SELECT doc_id,
  CASE WHEN lang = 'en' THEN concat('acc|', source, '|D', doc_id, '|', lang)
       ELSE concat('D', doc_id) END AS header,
  CASE WHEN lang = 'en' THEN concat('join(D', doc_id, ':1-', n_chars, ',9-20')
       ELSE concat('D', doc_id, ':1-', n_chars) END AS cds_id FROM documents)"""
MOTIFS = f"""motifs AS (SELECT DISTINCT translate(word, '{derived.LETTERS}', '{derived.TO_IUPAC}') AS motif
  FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
  WHERE length(word) > 0)"""
STRANDS = f"""w AS ({_windows('seqs', K, False)}),
n AS (SELECT seq_id, kmer, count(*) AS n FROM w GROUP BY seq_id, kmer),
both_strands AS (SELECT seq_id, kmer, n, kmer = {_rc('kmer')} AS palindrome FROM n
  UNION ALL SELECT seq_id, {_rc('kmer')}, n, false FROM n WHERE kmer <> {_rc('kmer')}),
counts AS (SELECT seq_id, kmer, CASE WHEN bool_or(palindrome) THEN 2 * sum(n) - 1 ELSE sum(n) END AS cnt
  FROM both_strands GROUP BY seq_id, kmer)"""


def _prevalence(k: int) -> str:
    return f"""w AS ({_windows('seqs', k, False)}),
present AS (SELECT seq_id, kmer FROM w UNION SELECT seq_id, {_rc('kmer')} FROM w),
prevalence AS (SELECT kmer, count(*) AS prevalence FROM present GROUP BY kmer)"""


def _retained(q: float) -> str:
    return f"""retained AS (SELECT * FROM prevalence
  WHERE prevalence > (SELECT quantile_cont(prevalence, {q}) FROM prevalence))"""


REFS = f"""refs AS (SELECT doc_id AS bin, concat('D', doc_id) AS seq_id, {_letters(derived.TO_BASES)} AS seq
  FROM documents JOIN (SELECT source AS s, min(doc_id) AS m FROM documents GROUP BY source) f
  ON documents.source = f.s AND documents.doc_id = f.m)"""
BINNED = """binned AS (SELECT s.seq_id, s.seq, min(x.bin) AS bin FROM seqs s JOIN
  (SELECT bin, length(seq) AS ref_len FROM refs) x
  ON length(s.seq) < x.ref_len + x.ref_len * CAST(0.1 AS DOUBLE)
 AND length(s.seq) > x.ref_len - x.ref_len * CAST(0.1 AS DOUBLE) GROUP BY s.seq_id, s.seq)"""
IDS = "ids AS (SELECT concat('D', doc_id) AS accession, source AS groups FROM documents)"
BIN_RECORDS = (
    SEQS,
    REFS,
    BINNED,
    IDS,
    "placed AS (SELECT b.bin, i.accession, i.groups FROM binned b JOIN ids i ON b.seq_id = i.accession)",
    _quotas("placed", r.BIN_DRAWS, "bin"),
    "records AS (SELECT bin, 'sample' AS draw_id, accession AS seq_id, count(*) AS weight FROM picks "
    "JOIN members USING (bin, groups, rnk) GROUP BY ALL UNION ALL SELECT bin, 'reference', seq_id, 1 FROM refs)",
)
BIN_PREVALENCE = f"""w AS ({_windows('seqs', K, False)}),
present AS (SELECT seq_id, kmer FROM w UNION SELECT seq_id, {_rc('kmer')} FROM w),
bin_prevalence AS (SELECT bin, kmer, CAST(sum(weight) AS BIGINT) AS prevalence FROM records
  JOIN present USING (seq_id) GROUP BY bin, kmer)"""
HITS = _hits(list(r.WEIGHTS))
FEATURES = "features AS (SELECT seq_id AS accession, motif, count(*) AS cnt FROM hits GROUP BY ALL)"
SCORES = f"""scores AS (SELECT m.motif,
  coalesce(h.n, 0) / CAST((SELECT count(DISTINCT doc_id) FROM documents) AS DOUBLE) AS share
  FROM (VALUES {', '.join(f"('{m}')" for m in [*r.WEIGHTS, 'A' * 16])}) m(motif)
  LEFT JOIN (SELECT motif, count(DISTINCT seq_id) AS n FROM hits GROUP BY motif) h USING (motif))"""
PREDICTIONS = f"""z AS (SELECT d.accession, coalesce(sum(f.cnt * c.coef), 0) AS z
  FROM (SELECT concat('D', doc_id) AS accession FROM documents) d
  LEFT JOIN features f USING (accession)
  LEFT JOIN (VALUES {_WEIGHTS}) c(motif, coef) USING (motif) GROUP BY d.accession),
predictions AS (SELECT accession, CAST(1 / (1 + exp(-CAST(z AS DOUBLE))) > 0.5 AS BIGINT) AS predict,
  1 / (1 + exp(-CAST(z AS DOUBLE))) AS predict_proba FROM z)"""
LABELLED = """labelled AS (SELECT p.*, CAST(m.label AS BIGINT) AS label, m.groups
  FROM predictions p JOIN meta m USING (accession) WHERE m.label > -1)"""
SCORED = (SEQS, META, HITS, FEATURES, PREDICTIONS, LABELLED)
CDS = f"""cds AS (SELECT concat('D', doc_id) AS seq_id, concat(source, '_', lang) AS accession,
  {_letters(derived.TO_BASES)} AS seq FROM documents)"""


def _base(c: str, shift: int) -> str:
    return f"(strpos('TCAG', substr({c}, CAST(i AS BIGINT) * 3 + {shift}, 1)) - 1)"


def _proteins(where: str) -> str:
    """Translated coding sequences; stops removed."""
    residue = (
        f"substr('{STANDARD_CODE}', 16 * {_base('seq', 1)} + 4 * {_base('seq', 2)} + "
        f"{_base('seq', 3)} + 1, 1)"
    )
    return f"""residues AS (SELECT seq_id, i, {residue} AS aa
  FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM cds {where})),
joined AS (SELECT seq_id, string_agg(aa, '' ORDER BY i) FILTER (WHERE aa <> '*') AS protein
  FROM residues GROUP BY seq_id),
proteins AS (SELECT c.accession, c.seq_id, coalesce(j.protein, '') AS protein
  FROM cds c JOIN joined j USING (seq_id))"""


def _valid(k: int) -> str:
    return f"WHERE length(seq) % 3 = 0 AND length(seq) // 3 > {k}"


ENCODED = f"encoded AS (SELECT accession, seq_id, translate(protein, '{_KEYS}', '{_CLASSES}') AS seq FROM proteins)"
AMINO_COUNTS = f"""words AS ({_windows('encoded', r.WORD_K, True, 'accession')}),
word_counts AS (SELECT accession, kmer AS word, count(*) AS cnt FROM words GROUP BY ALL),
amino AS (SELECT * FROM word_counts UNION ALL SELECT DISTINCT accession, CAST(NULL AS VARCHAR), 0
  FROM cds WHERE accession NOT IN (SELECT accession FROM word_counts))"""


def _class_regex(word: str) -> str:
    return "".join("[" + "".join(k for k, v in r.ALPHABET.items() if v == x) + "]" for x in word)


def _locations() -> str:
    """Non-overlapping matches: the pieces between them give the positions."""
    parts = []
    for word, weight in r.WORD_WEIGHTS.items():
        k = len(word)
        parts.append(
            f"""SELECT substr(protein, CAST(start AS BIGINT) + 1, {k}) AS amino_match, start,
  start + {k} AS "end", '{word}' AS motif, seq_id AS name, accession, CAST({weight} AS DOUBLE) AS coef FROM (
  SELECT seq_id, accession, protein, CAST(list_sum(list_transform(pieces[1:j], lambda x: length(x))) AS BIGINT)
    + (j - 1) * {k} AS start FROM (SELECT seq_id, accession, protein, pieces,
      unnest(range(1, len(pieces))) AS j FROM (SELECT seq_id, accession, protein,
        regexp_split_to_array(protein, '{_class_regex(word)}') AS pieces FROM proteins)))"""
        )
    return " UNION ALL ".join(parts)


CODONS = f"""codon_table AS (SELECT * FROM (VALUES {_CODON_ROWS}) t(codon, amino)),
usage AS (SELECT accession, codon, count(*) AS cnt FROM (
  SELECT accession, substr(seq, CAST(i AS BIGINT) + 1, 3) AS codon
  FROM (SELECT accession, seq, unnest(range(0, length(seq), 3)) AS i FROM cds))
  JOIN codon_table USING (codon) GROUP BY accession, codon)"""

_replace = "motif"
for _letter, _bases in PATTERN_BASES.items():
    if len(_bases) > 1:
        _replace = f"replace({_replace}, '{_letter}', '[{_bases}]')"
_DEGENERATE = "length(translate(motif, 'ACGT', ''))"
_REPRESENTED = (
    f"(2 * (length(motif) - length(translate(motif, '{_TWO}', '')))"
    f" + 3 * (length(motif) - length(translate(motif, '{_THREE}', '')))"
    " + 4 * (length(motif) - length(translate(motif, 'N', ''))))"
)

_BED = """SELECT h.seq_id AS chr, CAST(h.pos AS BIGINT) AS start, CAST(h.pos + length(h.motif) AS BIGINT) AS "end",
  h.motif AS name, CAST(round_even(s.share * 1000, 0) AS BIGINT) AS score FROM hits h JOIN scores s USING (motif)"""
_SCORE = "SELECT accession, predict, round(predict_proba, 9) AS predict_proba FROM predictions"

ORACLE: dict[str, str] = {
    "accession_parse": _with(
        "SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN contains(header, '|') "
        "THEN split_part(header, '|', 3) ELSE header END AS accession FROM headers",
        HEADERS,
    ),
    "cds_accession": _with(
        "SELECT CAST(doc_id AS BIGINT) AS doc_id, "
        "replace(split_part(cds_id, ':', 1), 'join(', '') AS accession FROM headers",
        HEADERS,
    ),
    "reverse_complement": _with(
        f"SELECT seq_id, {_rc('seq')} AS rc FROM seqs", _seqs(derived.TO_IUPAC)
    ),
    "kmer_ambiguity_filter": _with(
        "SELECT kmer, count(*) AS cnt FROM w WHERE NOT regexp_matches(kmer, '[HVYWDKBNMSR]') GROUP BY kmer",
        _seqs(derived.TO_MOSTLY_BASES),
        f"w AS ({_windows('seqs', K, False)})",
    ),
    "dna_numeric_codec": _with(
        "SELECT DISTINCT kmer, translate(kmer, 'GTCA', '0123') AS code, kmer AS decoded FROM w",
        SEQS,
        f"w AS ({_windows('seqs', K, False)})",
    ),
    "motif_to_regex": _with(f"SELECT motif, {_replace} AS regex FROM motifs", MOTIFS),
    "motif_degeneracy": _with(
        f"SELECT round(avg({_DEGENERATE}), 9) AS avg_degenerate_positions, "
        f"round(sum({_REPRESENTED}) / CAST(count(*) AS DOUBLE), 9) AS avg_represented_bases FROM motifs",
        MOTIFS,
    ),
    "motif_degeneracy_each": _with(
        f"SELECT motif, CAST({_DEGENERATE} AS BIGINT) AS degenerate_positions, "
        f"CAST({_REPRESENTED} AS BIGINT) AS represented_bases FROM motifs",
        MOTIFS,
    ),
    "rev_comp_motifs": _with(
        f"SELECT motif FROM motifs INTERSECT SELECT {_rc('motif')} FROM motifs", MOTIFS
    ),
    "rev_comp_ratio": _with(
        f"SELECT round((SELECT count(*) FROM (SELECT motif FROM motifs INTERSECT SELECT {_rc('motif')} "
        "FROM motifs)) / CAST((SELECT count(*) FROM motifs) AS DOUBLE), 9) AS rev_comp_ratio",
        MOTIFS,
    ),
    "kmer_windows": _with(
        "SELECT kmer, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, max(pos) AS last_pos "
        "FROM w GROUP BY kmer",
        SEQS,
        f"w AS ({_windows('seqs', K, False)})",
    ),
    "kmer_counts": _with(
        "SELECT kmer, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS records, "
        "CAST(max(cnt) AS BIGINT) AS most FROM counts GROUP BY kmer",
        SEQS,
        STRANDS,
    ),
    "replicon_bin": _with("SELECT seq_id, bin FROM binned", SEQS, REFS, BINNED),
    "kmer_matrix": _with(
        "SELECT i.bin, i.draw_id, i.seq_id, count(*) AS n_kmers, CAST(sum(c.cnt) AS BIGINT) AS total, "
        "min(c.kmer) AS first_kmer, max(c.kmer) AS last_kmer FROM items i JOIN counts c USING (seq_id) "
        "WHERE NOT regexp_matches(c.kmer, '[HVYWDKBNMSR]') GROUP BY i.bin, i.draw_id, i.seq_id",
        SEQS,
        REFS,
        BINNED,
        "items AS (SELECT bin, 'reference' AS draw_id, seq_id FROM refs "
        "UNION ALL SELECT bin, 'sample', seq_id FROM binned)",
        STRANDS,
    ),
    "kmer_prevalence": _with("SELECT kmer, prevalence FROM prevalence", SEQS, _prevalence(K)),
    "high_freq_kmers": _with(
        "SELECT kmer, prevalence FROM retained", SEQS, _prevalence(K), _retained(0.95)
    ),
    "kmer_index": _with(
        "SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS idx FROM prevalence",
        SEQS,
        _prevalence(K),
    ),
    "hamming_pairs": _with(
        # Two of ten letters differ at most, so one of three blocks is equal.
        "SELECT DISTINCT a, b, mismatches FROM ("
        + " UNION ALL ".join(
            "SELECT x.kmer AS a, y.kmer AS b, CAST(hamming(x.kmer, y.kmer) AS BIGINT) AS mismatches FROM retained x "
            f"JOIN retained y ON substr(x.kmer, {at}, {size}) = substr(y.kmer, {at}, {size}) AND x.kmer < y.kmer "
            "WHERE hamming(x.kmer, y.kmer) <= 2"
            for at, size in ((1, 3), (4, 3), (7, 4))
        )
        + ")",
        SEQS,
        # Read several times: without this each reading computes it again.
        _prevalence(r.PAIR_K).replace("prevalence AS (", "prevalence AS MATERIALIZED ("),
        _retained(r.PAIR_Q).replace("retained AS (", "retained AS MATERIALIZED ("),
    ),
    "consensus_motif": _with(
        "SELECT n.cluster_id, concat('motif', n.n) AS motif_id, m.motif FROM "
        "(SELECT cluster_id, row_number() OVER (ORDER BY min(kmer)) - 1 AS n FROM groups GROUP BY cluster_id) n "
        "JOIN (SELECT cluster_id, string_agg(code, '' ORDER BY p) AS motif FROM (SELECT s.cluster_id, s.p, t.code "
        "FROM (SELECT cluster_id, p, string_agg(base, '' ORDER BY base) AS bases FROM (SELECT DISTINCT cluster_id, p, "
        "substr(kmer, CAST(p AS BIGINT), 1) AS base FROM (SELECT cluster_id, kmer, unnest(range(1, length(kmer) + 1)) AS p "
        f"FROM groups)) GROUP BY cluster_id, p) s JOIN (VALUES {_IUPAC_ROWS}) t(bases, code) USING (bases)) "
        "GROUP BY cluster_id) m USING (cluster_id)",
        SEQS,
        _prevalence(K),
        _retained(0.95),
        "groups AS (SELECT substr(kmer, 1, 4) AS cluster_id, kmer FROM retained)",
    ),
    "motif_hits": _with("SELECT seq_id, motif, pos FROM hits", SEQS, HITS),
    "motif_hits_mixed": _with("SELECT seq_id, motif, pos FROM hits", SEQS, _hits(r.MIXED_MOTIFS)),
    "motif_score_table": _with(
        "SELECT motif, round(share, 9) AS setcompletion, "
        "CAST(round_even(share * 1000, 0) AS BIGINT) AS total_score FROM scores",
        SEQS,
        HITS,
        SCORES,
    ),
    "motif_bed": _with(_BED, SEQS, HITS, SCORES),
    "motif_features": _with("SELECT * FROM features", SEQS, HITS, FEATURES),
    "labelled_features": _with(
        "SELECT accession, motif, cnt, CAST(label AS BIGINT) AS label, groups "
        "FROM features JOIN meta USING (accession) WHERE label > -1",
        SEQS,
        META,
        HITS,
        FEATURES,
    ),
    "labelled_semi": _with(
        "SELECT * FROM features WHERE accession IN (SELECT accession FROM meta WHERE label > -1)",
        SEQS,
        META,
        HITS,
        FEATURES,
    ),
    "binarize_features": _with(
        "SELECT accession, motif, CAST(cnt > 0 AS BIGINT) AS cnt FROM features", SEQS, HITS, FEATURES
    ),
    "feature_align": _with(
        "SELECT a.accession, v.idx, v.motif, coalesce(f.cnt, 0) AS cnt FROM "
        "(SELECT DISTINCT accession FROM features) a CROSS JOIN "
        "(SELECT CAST(idx AS BIGINT) AS idx, motif FROM (VALUES (0, 'GGYCAN'), (1, 'ACRTNA'), (2, 'CATGWA'), "
        "(3, 'AAAAAAAAAAAAAAAA')) v(idx, motif)) v "
        "LEFT JOIN features f ON f.accession = a.accession AND f.motif = v.motif",
        SEQS,
        HITS,
        FEATURES,
    ),
    "score_sequences": _with(_SCORE, SEQS, HITS, FEATURES, PREDICTIONS),
    "stream_scores": _with(_SCORE, SEQS, HITS, FEATURES, PREDICTIONS),
    "misclassified": _with(
        "SELECT accession, predict, round(predict_proba, 9) AS predict_proba, label, groups "
        "FROM labelled WHERE label <> predict",
        *SCORED,
    ),
    "model_accuracy": _with(
        "SELECT count(*) AS n, round(avg(CAST(label = predict AS DOUBLE)), 9) AS accuracy FROM labelled",
        *SCORED,
    ),
    "brier_score": _with(
        "SELECT count(*) AS n, round(-avg(pow(predict_proba - label, 2)), 9) AS neg_brier FROM labelled",
        *SCORED,
    ),
    "mapping_diff": _with(
        "SELECT accession, CAST(m.label AS BIGINT) AS left_value, p.predict AS right_value "
        "FROM meta m JOIN predictions p USING (accession) WHERE m.label IS DISTINCT FROM p.predict",
        SEQS,
        META,
        HITS,
        FEATURES,
        PREDICTIONS,
    ),
    "stratified_resample": _with(
        "SELECT groups, accession, draw_no FROM picks JOIN members USING (groups, rnk)",
        IDS,
        _quotas("ids", r.DRAWS),
    ),
    "stratified_resample_bins": _with(
        "SELECT bin, groups, accession, draw_no FROM picks JOIN members USING (bin, groups, rnk)",
        SEQS,
        REFS,
        BINNED,
        IDS,
        "placed AS (SELECT b.bin, i.accession, i.groups FROM binned b JOIN ids i ON b.seq_id = i.accession)",
        _quotas("placed", 100, "bin"),
    ),
    "resample_weights_bins": _with("SELECT bin, draw_id, seq_id, weight FROM records", *BIN_RECORDS),
    "bin_prevalence": _with("SELECT bin, kmer, prevalence FROM bin_prevalence", *BIN_RECORDS, BIN_PREVALENCE),
    "bin_high_freq": _with(
        "SELECT bin, kmer, prevalence FROM bin_prevalence JOIN (SELECT bin, quantile_cont(prevalence, 0.95) AS cut "
        "FROM bin_prevalence GROUP BY bin) USING (bin) WHERE prevalence > cut",
        *BIN_RECORDS,
        BIN_PREVALENCE.replace("bin_prevalence AS (", "bin_prevalence AS MATERIALIZED ("),
    ),
    "group_shuffle_split": _with(
        f"SELECT CAST(split AS BIGINT) AS split, groups, row_number() OVER (PARTITION BY split ORDER BY "
        f"{_md5('split', 'groups')}, groups) <= ceil(CAST(0.1 AS DOUBLE) * "
        f"(SELECT count(DISTINCT groups) FROM ids)) AS is_test "
        f"FROM (SELECT DISTINCT groups FROM ids), range(0, {r.SPLITS}) s(split)",
        IDS,
    ),
    "stratified_kfold": _with(
        f"SELECT accession, CAST(label AS BIGINT) AS label, groups, (row_number() OVER (PARTITION BY label "
        f"ORDER BY {_md5('accession')}, accession) - 1) % 5 AS fold FROM meta",
        META,
    ),
    "cds_translate": _with(
        "SELECT accession, seq_id, protein FROM proteins", CDS, _proteins(_valid(6))
    ),
    "alphabet_encode": _with(
        "SELECT seq_id, seq AS encoded FROM encoded", CDS, _proteins(_valid(6)), ENCODED
    ),
    "amino_kmer_counts": _with(
        "SELECT accession, word, cnt FROM amino", CDS, _proteins(_valid(r.WORD_K)), ENCODED, AMINO_COUNTS
    ),
    "predict_amino": _with(
        "SELECT accession, CAST(p > 0.5 AS BIGINT) AS predict, round(p, 9) AS predict_proba FROM "
        "(SELECT accession, 1 / (1 + exp(-CAST(sum(cnt * coalesce(coef, 0)) AS DOUBLE))) AS p FROM amino "
        f"LEFT JOIN (VALUES {', '.join(f"('{w}', {c})" for w, c in r.AMINO_WEIGHTS.items())}) c(word, coef) "
        "USING (word) GROUP BY accession)",
        CDS,
        _proteins(_valid(r.WORD_K)),
        ENCODED,
        AMINO_COUNTS,
    ),
    "amino_high_abundance": _with(
        "SELECT word, total FROM totals WHERE total > (SELECT quantile_cont(total, 0.9) FROM totals)",
        CDS,
        _proteins(_valid(r.WORD_K)),
        ENCODED,
        AMINO_COUNTS,
        "totals AS (SELECT word, CAST(sum(cnt) AS BIGINT) AS total FROM amino WHERE word IS NOT NULL GROUP BY word)",
    ),
    "amino_motif_locations": _with(_locations(), CDS, _proteins("")),
    "codon_usage": _with("SELECT accession, codon, cnt FROM usage", CDS, CODONS),
    "relative_codon_freq": _with(
        "SELECT accession, codon, amino, round(cnt / CAST(sum(cnt) OVER (PARTITION BY accession, amino) AS DOUBLE), 9) "
        "AS rel_freq FROM usage JOIN codon_table USING (codon)",
        CDS,
        CODONS,
    ),
    "fasta_scan": _with(
        "SELECT seq_id, CAST(length(seq) AS BIGINT) AS len, md5(seq) AS digest FROM seqs", SEQS
    ),
    "bed_scan": _with(_BED, SEQS, HITS, SCORES),
    "metadata_scan": _with(
        "SELECT accession, CAST(label AS BIGINT) AS label, groups FROM meta", META
    ),
}
