"""Token counts through a digest cache.

The cache is a Parquet folder of (version, digest, n_tokens): ``digest`` is the SHA-256 of the
normalised text (null becomes empty; nothing else may change, as the counts are of the text as it
is), ``version`` that of the tokenizer's file.  Stored counts of the documents' distinct digests are joined, only distinct missing
digests are encoded, and their counts are appended.  Appending is one committed write, so a lost
executor or a failed run leaves no partial counts; a digest stored twice by two runs at once counts once.

Cases: null text counts as empty (0 bytes, 0 tokens); null doc_id and repeated rows are kept as rows;
an empty table gives no rows; other columns of the input are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftjoin.llm.support import python_rows, stored

LIMIT = 4096
_CACHE = "version string, digest binary, n_tokens bigint"
#: Entries of a worker's memory of segment counts, and the longest segment that it keeps.
MEMO_ENTRIES, MEMO_LENGTH = 300_000, 48
_SPACE = "▁"
_SEGMENT = re.compile(r" +[^ ]*")


class PieceCounter:
    """Counts of a SentencePiece BPE model, segment by segment where that is exact.

    Merges only ever form pieces of the vocabulary.  If no piece has the space mark after another
    character, no merge crosses the end of a word, and a text's count is the sum over its runs of
    spaces with the word behind them.  A model or text for which this isn't sure is encoded whole.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m, ids = self.model, range(self.model.get_piece_size())
        plain = [m.id_to_piece(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        probe = "aﬁ  b①\n c "
        self.by_segment = all(_SPACE not in p.lstrip(_SPACE) for p in plain) and m.normalize(probe) == _SPACE + probe.replace(" ", _SPACE)
        self.memo: dict[str, int] = {}

    def _segments(self, text: str) -> list[str] | None:
        if not self.by_segment or _SPACE in text or "\0" in text or text.endswith(" "):
            return None
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [s[1:] for s in _SEGMENT.findall(f" {text}")]

    def counts(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = []
        for text in texts:
            parts = self._segments(text) if text else []
            if parts is None:
                out.append(len(self.model.encode(text)))
                continue
            new = [p for p in set(parts) if p not in memo]
            found = dict(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True)) if new else {}
            kept = {p: n for p, n in found.items() if len(p) <= MEMO_LENGTH}
            memo.update(kept)
            if len(kept) == len(found):
                out.append(sum(map(memo.__getitem__, parts)))
            else:
                out.append(sum(memo[p] if p in memo else found[p] for p in parts))
            if len(memo) > 2 * MEMO_ENTRIES:
                memo.clear()
        return out


_counters: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
    return _counters[model_path]


def tokenizer_version(model_path: str) -> str:
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def count_tokens(documents: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.  Counts not yet in ``cache_path`` are appended to it."""
    spark = documents.sparkSession
    version = tokenizer_version(model_path)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")

    texts = documents.select(digest, text.alias("text"))
    counts = None
    if _exists(spark, cache_path):
        cache = spark.read.schema(_CACHE).parquet(cache_path).filter(F.col("version") == version)
        wanted = texts.select("digest").distinct()
        counts = stored(cache.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
        texts = texts.join(counts, "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"version": version, "digest": b["digest"], "n_tokens": counter(model_path).counts(b["text"].tolist())})

    fresh = stored(python_rows(misses, encode, _CACHE))
    if fresh.take(1):
        fresh.write.mode("append").parquet(cache_path)
    fresh = fresh.select("digest", "n_tokens")
    counts = fresh if counts is None else counts.unionByName(fresh)
    keyed = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest)
    # a row for each digest on one side: the rows of a text that many documents have can be split
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
