"""Training and scoring of a subword model over Spark tables; quality and toxicity are two settings of it."""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.llm import subword
from weftjoin.llm.support import crc_mod, give_back, python_rows, rows_by_text, utf8


def training_sample(documents: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], s: subword.Settings) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``per_class`` rows per class, the first by a hash of doc_id.

    Rows in the held-out fold (crc32 of doc_id modulo ``fold[0]`` equal to ``fold[1]``) are never read
    for training.  Texts over ``longest_bytes`` are not drawn.  A doc_id labelled both ways is left out.
    """
    divisor, held = fold
    good = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", divisor) != held))
    one = good.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2").select("doc_id", "y")
    order = [F.xxhash64("doc_id", F.lit(s.seed)), F.col("doc_id")]
    drawn = [one.filter(F.col("y") == c).orderBy(*order).limit(s.per_class).collect() for c in (0, 1)]
    spark = documents.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["y"]) for rows in drawn for r in rows], "doc_id bigint, y int")
    text = F.coalesce("text", F.lit(""))
    found = documents.filter(F.octet_length(text) <= s.longest_bytes).select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in found.dropDuplicates(["doc_id", "text"]).collect())
    return [utf8(t) for _, t, _ in rows], [y for _, _, y in rows]


def fitted(documents: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], s: subword.Settings) -> subword.Model:
    """A model trained on the driver, which hands the memory of the training back to the system."""
    texts, y = training_sample(documents, labels, label, fold, s)
    model = subword.train(texts, y, s)
    del texts, y
    gc.collect()
    give_back()
    return model


def score_documents(documents: DataFrame, model: subword.Model, fold: tuple[int, int], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the model goes out as one broadcast table of fixed size."""
    s, bias = model.settings, model.bias
    table = documents.sparkSession.sparkContext.broadcast(model.logits())
    divisor, held = fold

    def run(batches):
        for b in batches:
            scores = np.array([subword.score(utf8(t), table.value, bias, s) for t in b["text"]], dtype=float)
            ids = b["doc_id"]
            yield pd.DataFrame({"doc_id": ids, "score": scores, "predicted": (scores >= threshold).astype(np.int32)})

    held_out = (crc_mod("doc_id", divisor) == held).alias("held_out")
    return python_rows(documents.select("doc_id", "text"), run, "doc_id bigint, score double, predicted int").select("doc_id", held_out, "score", "predicted")


def keep_scored(documents: DataFrame, model: subword.Model, threshold: float) -> DataFrame:
    """The rows that score ``threshold`` or more, all columns as they are."""
    s, bias = model.settings, model.bias
    table = documents.sparkSession.sparkContext.broadcast(model.logits())
    return rows_by_text(documents, lambda texts: [subword.score(utf8(t), table.value, bias, s) >= threshold for t in texts])


def held_out_auc(scored: DataFrame, labels: DataFrame, label: str) -> float:
    rows = scored.filter("held_out").join(labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y")), "doc_id").select("score", "y").toPandas()
    return subword.evaluate(rows["score"].to_numpy(), rows["y"].to_numpy())
