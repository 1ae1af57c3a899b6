"""The registered queries of the text operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import (
    ball_tree, bpe, chunks, language_model, license_scan, manifest, packing, pivots, quality_rules, quality_trees, simhash, suffixes,
    token_files,
)
from strandwise.llm.common import documents, held, shared_folder

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
BPE_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    files = token_files.write_token_files(docs, BPE_50K, folder)
    return token_files.read_documents(spark, files, docs, folder)


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality_trees.fit_quality(docs, labels, ~held("doc_id", 5, 0))
    scored = quality_trees.score_quality(docs, trees)
    return scored.select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", "predicted")




def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("size", F.octet_length("text"))
    out = chunks.without_passages(docs)
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return out.select(
        "doc_id",
        F.coalesce("size", F.lit(0)).cast("long").alias("n_bytes"),
        cut.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = pivots.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = language_model.fit_and_score(docs, ~held("doc_id", 7, 2))
    return out.withColumn("train", ~F.col("train")).withColumnRenamed("train", "held_out")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.fit_rules(docs, labels, F.lit(True))
    return quality_rules.judge(docs, rules).drop("text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.encode_and_decode(docs, BPE_MULTI, public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), BPE_50K)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = ball_tree.top_documents(documents(spark, sf_dir, "doc_id", "text"), items, "doc_id", "item_id")
    return found.withColumnsRenamed({"query_id": "item_id", "id": "doc_id"})


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_rows(docs: DataFrame, bits: int = manifest.BLOCK_BITS) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    made = manifest.manifest(docs, LEAF_COLUMNS, "doc_id", "lang", claims, bits)
    return made.select(
        "doc_id", "leaf", "subroot", "root",
        manifest.proof_digest("proof").alias("proof_sha256"),
        manifest.folded("claimed", "proof").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(documents(spark, sf_dir, *LEAF_COLUMNS))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score", "spans",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_token_files, op3_quality_trees, op4_chunk_dedup, op5_top_k, op6_simhash,
        op7_language_model, op8_quality_rules, op9_bpe, op10_packing, op11_lexical_search, op12_merkle_manifest,
        op13_license_scan,
    )
}
#: Bits of a CRC-32: each text byte is mixed in, then eight shifts (marked -1) follow.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
    lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
    4294967295::BIGINT)"""


def _code(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(concat(strlen({text}), ':', {text}), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_code(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


#: SQL for those that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, total GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))
    AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree
    FROM documents),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (width + 1) // 2
  FROM nodes WHERE width > 1 GROUP BY tree, level, pos // 2, width),
tops AS (SELECT tree, level AS height, digest AS subroot FROM nodes WHERE width = 1),
upper_nodes AS (SELECT 0 AS level, tree - 1 AS pos, subroot AS digest, count(*) OVER () AS width FROM tops
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (width + 1) // 2
  FROM upper_nodes WHERE width > 1 GROUP BY level, pos // 2, width),
steps AS (SELECT doc_id, leaf, claimed, tree, subroot, unnest(range(0, height)) AS level, pos, height FROM leaves JOIN tops USING (tree)),
siblings AS (
  SELECT s.doc_id, s.level, n.digest, (s.pos >> s.level) % 2 = 1 AS on_left FROM steps s LEFT JOIN nodes n
    ON n.tree = s.tree AND n.level = s.level AND n.pos = xor(s.pos >> s.level, 1::BIGINT)
  UNION ALL
  SELECT s.doc_id, 1000 + s.level, n.digest, ((s.tree - 1) >> s.level) % 2 = 1 FROM (SELECT doc_id, tree,
    unnest(range(0, (SELECT max(level) FROM upper_nodes))) AS level FROM leaves) s LEFT JOIN upper_nodes n
    ON n.level = s.level AND n.pos = xor((s.tree - 1) >> s.level, 1::BIGINT)),
ordered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k, coalesce(digest, '') AS digest, on_left
  FROM siblings),
folds AS (SELECT doc_id, 0::BIGINT AS k, claimed AS digest FROM leaves
  UNION ALL SELECT f.doc_id, o.k, sha256(CASE WHEN o.on_left THEN concat(o.digest, f.digest) ELSE concat(f.digest, o.digest) END)
  FROM folds f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
proofs AS (SELECT doc_id, sha256(string_agg(digest, '' ORDER BY k)) AS proof_sha256 FROM ordered GROUP BY doc_id),
roots AS (SELECT digest AS root FROM upper_nodes WHERE width = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN tops USING (tree) LEFT JOIN proofs USING (doc_id)
JOIN (SELECT doc_id, arg_max(digest, k) AS folded_root FROM folds GROUP BY doc_id) USING (doc_id), roots""",
}
