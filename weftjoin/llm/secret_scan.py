r"""Secret scans: base patterns, and weak parts that count only where complementary parts co-occur.

A base span is an assigned secret, an access identifier or a long hex run.  The parts of a multipart
credential are weak alone: an identifier (an access identifier, or a named account or client id), a
secret (an assigned value, or a lone 40-character key) and an endpoint.  Parts are linked by an
interval join inside a document: the identifier's scope is its span widened by ``scope`` code points,
and a secret part that meets the scope makes a credential; endpoints that meet the scope of a
credential are reported with it.  Buckets of the scope's width make that an equality join, so no
pairs of distant spans arise, and a bucket holds few spans, as each is several code points long.

All of it is DataFrame expressions.  Positions come from the pieces between the matches, as code
points, end exclusive.  Cases:

* null text: empty, no spans; null doc_id: kept, compared as equal to null.
* repeated rows (same doc_id and text): each gets the same result; same doc_id with another text: its own result.
* an empty table: no rows; other columns are passed through by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftjoin.llm.support import durable

#: The base patterns.  The length conditions are applied to the matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hex digits of 32 or more is the whole maximal run, as the plain pattern with a length condition gives it.
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")

#: A name may have a prefix that ends in ``_`` or ``-``, as in env files (AWS_ACCESS_KEY_ID=, db_username=).
IDENT = r"""(?i)(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|account_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
#: A whole run of the key's alphabet; any other character, as ``=``, ``_`` or punctuation, may be next to it.
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"(?i)\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:@_-]{3,}"
SCOPE = 200

DIGEST_KEYS = ("doc_id", "text_hash")


def _matches(kind: str, pattern: str, text: Column, good) -> Column:
    """An array of (kind, pos, skipped, size, ok) for all matches, failing ones included, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(
        text.rlike(pattern),
        F.transform(
            F.arrays_zip(F.sequence(F.lit(0), F.size(found) - 1).alias("pos"), found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gap")),
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x["pos"].alias("pos"), F.char_length(x["gap"]).alias("skipped"), F.char_length(x["found"]).alias("size"), good(x["found"]).alias("ok")
            ),
        ),
    )


def _keyed(documents: DataFrame) -> tuple[DataFrame, Column]:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text, F.char_length(text)).alias("text_hash"), text.alias("text")), F.col("text")


def candidate_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, stop) of base spans and of weak candidates."""
    keyed, text = _keyed(documents)
    fine = lambda x: F.lit(True)
    patterns = [
        _matches("assign", ASSIGN, text, lambda x: F.char_length(F.regexp_extract(x, ASSIGN, 2)) >= ASSIGN_LEAST),
        _matches("access", ACCESS, text, lambda x: F.char_length(x) >= ACCESS_LEAST),
        _matches("hex", HEX, text, fine),
        _matches("ident", IDENT, text, fine),
        _matches("key", KEY, text, lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")),
        _matches("endpoint", ENDPOINT, text, fine),
    ]
    rows = keyed.select(*DIGEST_KEYS, F.explode(F.flatten(F.filter(F.array(*patterns), lambda a: a.isNotNull()))).alias("m"))
    rows = rows.select(*DIGEST_KEYS, "m.*").dropDuplicates([*DIGEST_KEYS, "kind", "pos"])
    before = Window.partitionBy(*DIGEST_KEYS, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("skipped") + F.col("size")).over(before)
    return rows.withColumn("stop", stop).filter("ok").select(*DIGEST_KEYS, "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def linked_spans(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and the weak parts of credentials whose complementary parts are in one scope."""
    width = 2 * scope
    near = F.explode(F.sequence(F.floor((F.col("start") - scope) / width), F.floor((F.col("stop") + scope) / width))).alias("bucket")
    own = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bucket")
    keys = [*DIGEST_KEYS, "kind", "start", "stop"]
    anchors = spans.filter(F.col("kind").isin("access", "ident")).select(*DIGEST_KEYS, *[F.col(c).alias(f"a_{c}") for c in keys[2:]], near)
    parts = spans.filter(F.col("kind").isin("assign", "key", "endpoint")).select(*keys, own)
    a, p = anchors.alias("a"), parts.alias("p")
    met = a.join(
        p,
        F.col("a.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("a.text_hash") == F.col("p.text_hash"))
        & (F.col("a.bucket") == F.col("p.bucket"))
        & (F.col("p.start") <= F.col("a_stop") + scope)
        & (F.col("p.stop") >= F.col("a_start") - scope),
    ).select("a.doc_id", "a.text_hash", "a_kind", "a_start", "a_stop", "kind", "start", "stop")
    by_anchor = met.groupBy(*DIGEST_KEYS, "a_kind", "a_start", "a_stop").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("parts"))
    whole = by_anchor.filter(F.exists("parts", lambda x: x["kind"] != "endpoint"))
    weak = whole.select(*DIGEST_KEYS, F.explode(F.array_append("parts", F.struct(F.col("a_kind").alias("kind"), F.col("a_start").alias("start"), F.col("a_stop").alias("stop")))).alias("x"))
    weak = weak.select(*DIGEST_KEYS, "x.*").filter(F.col("kind").isin("ident", "key", "endpoint"))
    return spans.filter(F.col("kind").isin("assign", "access", "hex")).unionByName(weak)


def spans_by_document(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash and spans (start, rank, stop, kind; by start, then kind as in KINDS) of the texts that have any."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    spans = linked_spans(durable(candidate_spans(documents)), scope)
    return spans.groupBy(*DIGEST_KEYS).agg(F.sort_array(F.collect_set(F.struct("start", order[F.col("kind")].alias("rank"), "stop", "kind"))).alias("spans"))


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, text_hash, spans."""
    d, s = _keyed(documents)[0].select(*DIGEST_KEYS).alias("d"), spans_by_document(documents, scope).alias("s")
    joined = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    return joined.select("d.doc_id", "d.text_hash", F.coalesce("s.spans", F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")).alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_digest(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    return scan(documents, scope).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"),
        _said(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_linked"),
    )


def redact(documents: DataFrame, scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; overlapping spans get one mark, and n_chars, if there, is the new length."""
    found = spans_by_document(documents, scope).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "spans")
    text = F.coalesce("text", F.lit(""))
    # the input's columns travel in one, so that none can clash with those made here
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(text, F.char_length(text)).alias("own_hash"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("of_hash")), "left")
    start, text = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), F.col("row.text")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.when(fresh, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], kept).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    changed = F.col("spans").isNotNull()
    out = joined.select("row", changed.alias("changed"), F.when(changed, clean).otherwise(text).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("changed"), F.char_length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
