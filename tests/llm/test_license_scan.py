"""Licence scan against brute force over all runs of words."""

import random
import re

import numpy as np
import pytest

from strandwise.llm import license_scan as ls
from strandwise.llm import queries
from strandwise.llm.licenses import NOTICES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = NOTICES[0][2]


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def base(text):
    found, own = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        own += [(i, label) for i in range(len(found)) if found[i : i + len(p)] == p]
    places = [i for i, _ in own]
    labels = sorted({x for _, x in own})
    return len(found), len(own), min(places, default=None), max(places, default=None), labels


def test_matching_statistics_equal_all_runs():
    a = ls.build(NOTICES, PHRASES)
    runs = [tuple(run) for _, _, run in a.notices]
    known = {r[i:j] for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + 30) + 1)}
    rng = random.Random(5)
    for _ in range(100):
        text = []
        while len(text) < 50:
            run = rng.choice(runs)
            at = rng.randrange(len(run))
            text += run[at : at + rng.randrange(1, 12)] if rng.random() < 0.7 else [rng.choice([0, 0, 1, 2, 3])]
        numbers = np.array(text, np.int32)
        got = {end: length for end, length, _, _ in ls.matches(a, numbers)}
        for end in range(len(text)):
            n = 0
            while n <= end and tuple(text[end - n : end + 1]) in known:
                n += 1
            assert max(n, 1) == max(got.get(end, 0), 1)


def test_base_columns_equal_a_plain_search():
    a = ls.build(NOTICES, PHRASES)
    rng = random.Random(2)
    pool = ["mit", "MIT", "License", "license", "apache", "general", "public", "gnu", "the", "é", "x1", "of", "this", "software"]
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", "_", ". "]) for _ in range(rng.randrange(60)))
        got = ls.scan_text(a, text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base(text)
        assert set(got["base_labels"]) <= set(got["labels"]) and 0 <= got["score"] <= 1


def test_whole_notices_are_found_with_their_spans():
    a = ls.build(NOTICES, PHRASES)
    for label, name, text in NOTICES:
        lead, n = "Alpha beta gamma. ", len(words(text))
        got = ls.scan_text(a, (lead + text + " delta").encode())
        span = next(s for s in got["spans"] if s["notice"] == name)
        assert label in got["labels"] and got["score"] == 1.0
        assert (span["first_word"], span["last_word"], span["cover"]) == (3, 3 + n - 1, 1.0)


def test_chains_bridge_changes_but_not_long_gaps():
    a = ls.build(NOTICES, PHRASES)
    own = words(MIT)
    changed = own[:30] + ["really"] * 3 + own[30:60] + own[63:]
    got = ls.scan_text(a, " ".join(changed).encode())
    (span,) = got["spans"]
    assert span["label"] == "mit" and span["first_word"] == 0 and span["last_word"] == len(changed) - 1
    assert span["cover"] == pytest.approx((len(own) - 3) / len(own))
    apart = own[:40] + ["other"] * (ls.MOST_GAP + 1) + own[40:]
    got = ls.scan_text(a, " ".join(apart).encode())
    assert got["spans"] == [] and got["score"] == pytest.approx(max(40, len(own) - 40) / len(own))
    assert len(ls.scan_text(a, " ".join(own + ["x"] * 50 + own).encode())["spans"]) == 2


def test_brute_cover_of_cut_notices():
    """Two stretches of a notice in its order, close together: cover is their length."""
    a = ls.build([("mit", "MIT", MIT)], {})
    own, rng = words(MIT), random.Random(9)
    for _ in range(60):
        i, j, k, e = sorted(rng.sample(range(len(own) + 1), 4))
        gap = rng.randrange(1, ls.MOST_GAP + 1)
        parts = [p for p in (own[i:j], own[k:e])]
        got = ls.scan_text(a, " ".join(parts[0] + ["zzz"] * gap + parts[1]).encode())
        want = sum(len(p) for p in parts if len(p) >= ls.LEAST_MATCH) / len(own)
        assert got["score"] >= want - 1e-12 and got["score"] <= want + 2 * ls.LEAST_MATCH / len(own)


def test_query_on_odd_rows(spark, tmp_path):
    long = "filler words here " * 120_000 + "the MIT License " + "more " * 400_000
    texts = [None, "", "MIT license", "MIT license", "the Apache_License; GNU General Public\nLicense", long, "." * 3_000_000]
    rows = [(i if i else None, t, 1.0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score DOUBLE, Labels STRING")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(texts):
        n, places, first, last, labels = base(text)
        r = got[i or None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            n, places, first, last, ",".join(labels),
        )
    kept = ls.scan(df)
    assert kept.columns[:4] == df.columns and "_score" in kept.columns and "_labels" in kept.columns
    assert {r["score"] for r in kept.collect()} == {1.0}
    assert ls.scan(df.limit(0)).collect() == []
