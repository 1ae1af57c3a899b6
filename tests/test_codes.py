"""Windows counted as codes against a plain count of texts."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import number_text
from strandwise.operators import codes, hits, kmers

PAIRS = str.maketrans("ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")


def canonical(text, k):
    windows = (text[i : i + k] for i in range(len(text) - k))
    return Counter(min(w, w.translate(PAIRS)[::-1]) for w in windows)


@pytest.fixture
def records():
    r = random.Random(3)
    make = lambda n, letters="ACGT": "".join(r.choices(letters, k=n))
    one = make(400)
    rows = [("a", one), ("a", make(90)), ("a", one), (None, make(50)), (None, make(60, "ACGTNa")), ("b", ""), ("c", None)]
    return rows + [(f"d{i}", make(30 * i % 170, "ACGTR" if i % 5 == 0 else "ACGT")) for i in range(40)]


@pytest.mark.parametrize("k, step", [(3, 64), (8, 1 << 20), (12, 64), (31, 64), (33, 64)])
def test_counts_and_prevalence(spark, records, monkeypatch, k, step):
    """Ids that repeat or are null are one record, over pieces of any size."""
    monkeypatch.setattr(codes, "STEP_LETTERS", step)
    df = spark.createDataFrame(records, "seq_id STRING, seq STRING")
    want = {}
    for name, text in records:
        want.setdefault(name, Counter()).update(canonical(text or "", k))
    got = kmers.record_counts(df, k, False, ["seq_id"]).collect()
    assert sorted((str(r.seq_id), r.lo, r.n) for r in got) == sorted((str(s), w, n) for s, c in want.items() for w, n in c.items())
    assert all(r.hi == r.lo.translate(PAIRS)[::-1] for r in got)
    holding = Counter(w for c in want.values() for w in c)
    both = Counter({w: n for lo, n in holding.items() for w in (lo, lo.translate(PAIRS)[::-1])})
    clean = {w: n for w, n in both.items() if not set(w) & set("HVYWDKBNMSR")}
    assert {r.kmer: r.prevalence for r in kmers.sequence_prevalence(df, k).collect()} == clean


def test_windows_are_counted_in_their_task(spark, records):
    """No aggregate before the shuffle has a row a window of each record."""
    df = spark.createDataFrame(records, "seq_id STRING, seq STRING")
    for counted in (kmers.sequence_prevalence(df, 8), kmers.record_counts(df, 8, False, ["seq_id"])):
        text = counted._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "Generate" not in text.split("MapInArrow")[-1]


def test_steps_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(codes, "STEP_LETTERS", 50)
    text = "".join(random.Random(1).choices("ACGT", k=1003))
    records = spark.createDataFrame([(1, "s", "x", text, 3), (1, "s", "y", text[:70], 2), (2, "s", "x", text, 5)],
                                    "bin BIGINT, draw_id STRING, seq_id STRING, seq STRING, weight BIGINT")
    got = {(r.bin, r.kmer): r.prevalence for r in kmers.weighted_prevalence(records, "bin", 6).collect()}
    whole, head = canonical(text, 6), canonical(text[:70], 6)
    assert all(got[1, w] == 3 + 2 * (w in head) and got[2, w] == 5 for w in whole)


@pytest.mark.parametrize("step", [70, 1 << 20])
def test_look_up_of_motifs(spark, motif_table, monkeypatch, step):
    """Tasks hand on the windows that a motif's code finds; long motifs, other letters, nulls, repeats."""
    monkeypatch.setattr(codes, "STEP_LETTERS", step)
    r = random.Random(5)
    texts = ["".join(r.choices("ACGTN" if i % 3 else "ACGT", k=n)) for i, n in enumerate([0, 2, 900, 333, 90, 90, 12])]
    long = texts[2][100:140].replace("N", "A")
    data = [*((f"s{i}", t) for i, t in enumerate(texts)), ("s3", texts[3]), (None, texts[4] + long), ("z", None)]
    names = {"ACR": "AC[AG]", "ANNNNNNNNNNT": "A[ACGT]{10}T", long[:12] + "Y": long[:12] + "[CT]", long: long}
    found = hits.motif_hits(spark.createDataFrame(data, "seq_id STRING, seq STRING"), motif_table(*names))
    want = [(str(s), m, x.start()) for s, t in data for m, p in names.items() for x in re.finditer(f"(?={p})", t or "")]
    assert sorted((str(x.seq_id), x.motif, x.pos) for x in found.collect()) == sorted(want)
    assert any(m == long for _, m, _ in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan


@pytest.mark.parametrize("strands", [False, True])
def test_counts_leave_a_task_in_small_batches(records, monkeypatch, strands):
    """What many records or one long one hold is not handed on as one batch."""
    for name, value in {"COUNT_LETTERS": 300, "COUNT_ROWS": 16}.items():
        monkeypatch.setattr(codes, name, value, raising=False)
    monkeypatch.setattr(codes, "_sorted_by_record", lambda *_: SimpleNamespace(mapInArrow=lambda f, _: f))
    monkeypatch.setattr(codes, "_schema", lambda *_: None)
    rows = [(f"{i}", t or "") for i, (_, t) in enumerate(records)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array([1] * len(rows), pa.int32())], names=["seq_id", "seq", "_n"]
    )
    out = list(codes.record_counts(None, 6, False, ["seq_id"], **({"strands": True} if strands else {}))(iter([batch])))
    assert max(b.num_rows for b in out) <= (32 if strands else 16)
    got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    want = []
    for name, text in rows:
        for lo, n in canonical(text, 6).items():
            hi = lo.translate(PAIRS)[::-1]
            if not strands:
                want.append((name, lo, hi, n))
            elif lo == hi:
                want.append((name, lo, 2 * n - 1))
            else:
                want += [(name, lo, n), (name, hi, n)]
    assert got == sorted(want)


@pytest.mark.parametrize("k", [1, 5, 8])
def test_numbers_order_windows_as_texts(spark, records, k):
    df = spark.createDataFrame(records, "seq_id STRING, seq STRING")
    counts = kmers.kmer_counts(df, k, number=True)
    got = counts.groupBy("seq_id").agg(number_text(F.min("number")).alias("first"), number_text(F.max("number")).alias("last"))
    want = counts.groupBy("seq_id").agg(F.min("kmer"), F.max("kmer"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.count() > 20 and counts.where("kmer rlike '[^ACGT]'").count()


def test_long_windows_have_no_number(spark, records):
    with pytest.raises(ValueError, match="longer than 8"):
        kmers.kmer_counts(spark.createDataFrame(records, "seq_id STRING, seq STRING"), 9, number=True)
