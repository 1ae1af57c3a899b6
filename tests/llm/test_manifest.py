"""Merkle manifests against trees built level by level in plain Python."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from strandwise.llm import manifest as m
from strandwise.llm import queries

SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, leaf STRING, _pos INT"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((at % 2 == 1, level[other] if other < len(level) else None))
        at >>= 1
    return out


def brute(rows):
    def leaf(r, extra=0):
        n = None if r[3] is None else r[3] + extra
        return h(*map(code, (r[0], r[1], r[2], n, r[4])))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = siblings(trees[g], i) + siblings(top, k)
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf(r, int(tampered))
            for left, other in proof:
                digest = h(other or "", digest) if left else h(digest, other or "")
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*[d for _, d in proof if d]), digest, digest == root))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def rows_of(counts, text="some text"):
    rows, n = [], 0
    for lang, count in counts.items():
        for _ in range(count):
            rows.append((n, "s", lang, 9 if n % 3 else None, f"{text} {n}", "x", 1))
            n += 1
    return rows


def run(spark, rows):
    """Blocks of four nodes, so that a few dozen rows take several rounds."""
    return queries.merkle_rows(spark.createDataFrame(rows, SCHEMA), bits=2)


@pytest.mark.parametrize("counts", [{"en": 37, None: 5, "de": 1, "é": 16, "": 2}, {"en": 1}, {"a": 1, "b": 1, "c": 1}])
def test_equals_plain_trees(spark, counts):
    rows = rows_of(counts)
    assert in_order(run(spark, rows).collect()) == in_order(brute(rows))


def test_nulls_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None, "x", 1),
        (None, None, None, None, "", "x", 1),
        (7, "s", "en", 3, "long " * 200_000, "x", 1),
        *[(5, "s", "en", 3, "same", "x", 1)] * 6,
        (5, "s", "en", 2**63 - 2, "other", "x", 1),
    ]
    found = run(spark, rows).collect()
    assert in_order(found) == in_order(brute(rows))


def test_empty_table_and_taken_names(spark):
    assert run(spark, []).collect() == []
    with pytest.raises(ValueError):
        m.manifest(spark.createDataFrame([(1, "a")], "root BIGINT, lang STRING"), ["lang"], "root", "lang")


def test_only_changed_rows_fail_to_verify(spark, tmp_path):
    rows = rows_of({"en": 60})
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert in_order(found) == in_order(brute(rows))
    changed = {r[0] for r in rows if crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert changed and {r["doc_id"] for r in found if not r["verified"]} == changed


def test_proofs_lead_to_the_root_by_hand(spark):
    rows = spark.createDataFrame([(i, "g", str(i)) for i in range(11)], "id BIGINT, g STRING, text STRING")
    for r in m.manifest(rows, ["text"], "id", "g").collect():
        digest = r["leaf"]
        for left, other in r["proof"]:
            digest = h(other or "", digest) if left else h(digest, other or "")
        assert digest == r["root"] and r["claimed"] == r["leaf"] == h(code(str(r["id"])))


def test_labels_ascend_and_messages_stay_in_the_block():
    digests = [h(str(i)) for i in range(3)]
    nodes = m.sweep_forward(digests, 2, 2)
    assert list(nodes) == [4, 5, 8] and nodes[8][0] == levels_of(digests)[-1][0]
    proofs = m.sweep_back(nodes, 2, (True, "top", None), 2)
    assert proofs[2] == (False, None, (True, nodes[4][0], (True, "top", None)))


def test_column_codes(spark):
    row = spark.range(1).select(m.leaf_digest([F.lit("é"), F.lit(None), F.lit(-12)]).alias("d")).first()
    assert row["d"] == h("2:é-3:-12")
