"""Toxicity: subword-bag embeddings averaged per passage under a linear softmax, trained jointly.

A toxic word or two in a long text would vanish in the mean of the whole, so the mean is taken over
passages of some dozen words, and a document's score is that of its highest passage.  Training steps
on that passage too, so a clean document pushes down what looks worst in it.  A misspelling that was
never seen shares character n-grams, and so vectors, with the words that were.

Cases: as for the quality classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftjoin.llm import labelled, subword

FOLD = (3, 1)
THRESHOLD = 0.7
SETTINGS = subword.Settings(dim=4, passage=8, least=40, epochs=5, warm_epochs=2, adaptive=True, seed=11)


def fit(documents: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS) -> subword.Model:
    return labelled.fitted(documents, labels, "toxic", FOLD, settings)


def score_toxicity(documents: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    return labelled.score_documents(documents, fit(documents, labels, settings), FOLD, threshold)
