"""Precision, recall and F1 with the conventions of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Rounded to six places; precision and recall are 1 without a case, F1 is 0 if both are 0."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)}
