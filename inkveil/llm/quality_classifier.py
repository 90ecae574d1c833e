"""Quality of texts: hashed word and character n-gram vectors averaged over the whole document, into a softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.subword_model import Model, Settings, fit_labelled, score_column

THRESHOLD = 0.3
SETTINGS = Settings(letters_only=False, window=0, repeats=True)
FOLDS, HELD_OUT = 5, 0


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", settings: Settings = SETTINGS) -> Model:
    """Fit on labelled rows outside the held-out fold (``crc32(id as text) mod 5 = 0``); see ``Settings`` for the bounds."""
    return fit_labelled(docs, labels, label, settings, FOLDS, HELD_OUT, id_col, text_col)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score in 0 to 1 for every whole text and predicted = 1 from THRESHOLD on.

    Null and empty texts get the score of an empty bag; nothing else of a row is looked at, repeated rows and null ids
    are scored like any other, and an empty table stays empty. Columns already called ``score`` or ``predicted`` would be
    replaced: name others to keep them.
    """
    scored = docs.withColumn(score, score_column(model, F.col(text_col)))
    return scored.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))
