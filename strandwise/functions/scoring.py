"""Scalar expressions for scores and model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import _col


def bed_score(share: Column | str) -> Column:
    """Share scaled to 0..1000, rounded half to even."""
    return F.bround(_col(share) * 1000, 0).cast("int")


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-_col(c)))


def binarize(c: Column | str) -> Column:
    return F.when(_col(c) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def negative_brier(p: Column | str, label: Column | str) -> Column:
    """Aggregate: minus the mean squared error of a probability (higher is better)."""
    return -F.avg(F.pow(_col(p) - _col(label), 2))


def accuracy(label: Column | str, predict: Column | str) -> Column:
    """Aggregate: share of rows whose label was predicted."""
    return F.avg((_col(label) == _col(predict)).cast("double"))
