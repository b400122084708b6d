"""Quality classifier: supervised subword embeddings averaged over the whole document under a softmax.

Cases: null and empty texts get the model's bias as score; repeated rows get equal scores; null doc_id is
scored (its fold is that of the empty text); an empty table gives no rows; without labels of both classes
the score is constant.  Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftjoin.llm import labelled, subword

FOLD = (4, 2)
THRESHOLD = 0.7
SETTINGS = subword.Settings()


def fit(documents: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS) -> subword.Model:
    return labelled.fitted(documents, labels, "quality", FOLD, settings)


def score_quality(documents: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    return labelled.score_documents(documents, fit(documents, labels, settings), FOLD, threshold)


def keep_good(documents: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts."""
    return labelled.keep_scored(documents, fit(documents, labels, settings), threshold)
