"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Vectors with equal components are one class, carried once with its size; a second digest keeps unlike vectors with one digest apart.  On a bounded sample of classes
principal directions and a rotation are learned that make balanced binary codes; each of several tables
takes one substring of the code, and vectors whose substring in some table is equal are compared.  The
substrings are as long as the number of classes asks for, so that a table's buckets hold few unlike
vectors at any size, and there are as many tables as the wanted recall of a pair just at the threshold
then takes.  That number is measured, not computed: vectors of the sample are paired with vectors at exactly the
threshold from them, off in random directions and towards other (near, if there are) vectors of the sample, and tables are
added until those pairs meet, also for the tenth of the vectors that fares worst.  So a common mean or a
large group that the cuts go through gets more tables.  Of the lengths of substrings the one with the least work
is taken; where tables don't pay, all vectors are one bucket.  In a bucket the cosine is computed from the original vectors in double precision, so no
pair below the threshold is linked.

A pair that meets in several tables counts in the first of them, which both rows' keys tell, so links
are summed without ever being listed: a bucket gives one row per member with its number of links and
one member it is linked with.  A large bucket is split into blocks, and each pair of blocks is a task's
group of bounded size; that is exact.

Cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing, and
neither do vectors of different lengths; null vec_id is a row with component null; repeated rows are rows of their own and
link with each other; an empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftjoin.llm.components import components
from weftjoin.llm.support import durable, python_rows

THRESHOLD = 0.95
SAMPLE = 4000
RECALL = 0.95
BLOCK = 512
#: Vectors of the sample that recall is measured at, and pairs of each.
ANCHORS, PARTNERS = 256, 16
#: So many pairs in a bucket are as much work as one row that is brought there.
PAIRS_A_ROW = 512


@dataclass(frozen=True)
class Tables:
    """Projections of one vector length: (tables x bits) directions and offsets."""

    bits: int
    directions: np.ndarray  # dim x (tables * bits)
    offsets: np.ndarray

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """n x tables substrings of the codes."""
        signs = unit @ self.directions > self.offsets
        weights = np.left_shift(np.int64(1), np.arange(self.bits, dtype=np.int64))
        return (signs.reshape(len(unit), -1, self.bits) * weights).sum(axis=2)


def size_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring, at most, and number of tables for ``n`` vectors whose bits are cut through the origin."""
    bits = min(40, max(8, math.ceil(math.log2(max(n, 2))) + 1))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _cuts(sample: np.ndarray, dim: int, rounds: int, rng: np.random.Generator):
    """Iterative quantisation: alternately the nearest binary codes and the rotation that fits them best.

    Gives (directions, offsets) without end; a rotation gives as many bits as there are directions, and further ones start
    from other rotations.
    """
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    basis = np.linalg.svd(centred, full_matrices=True)[2].T if len(sample) > dim else np.eye(dim)
    while True:
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        projected = centred @ basis
        for _ in range(rounds if len(sample) > dim else 0):
            codes = np.where(projected @ rotation > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(codes.T @ projected)
            rotation = (u @ w).T
        turned = basis @ rotation
        turned = turned[:, rng.permutation(dim)]
        yield turned, np.median(sample @ turned, axis=0) if len(sample) else np.zeros(dim)


def _pairs_at(threshold: float, sample: np.ndarray, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (m x dim), and for each ``PARTNERS`` unit vectors (m x PARTNERS x dim) at the cosine ``threshold`` from it."""
    if len(sample):
        anchors = sample[rng.permutation(len(sample))[:ANCHORS]]
    else:
        anchors = rng.standard_normal((ANCHORS, dim))
        anchors /= np.linalg.norm(anchors, axis=1, keepdims=True)
    off = rng.standard_normal((2, len(anchors), PARTNERS, dim))
    if len(sample) > PARTNERS:
        cosine = anchors @ sample.T
        order = rng.random(cosine.shape) + (cosine >= threshold) - 3 * (cosine > 1 - 1e-9)  # near ones first, itself last
        towards = sample[np.argpartition(-order, PARTNERS, axis=1)[:, :PARTNERS]] - anchors[:, None]
        across = towards - (towards * anchors[:, None]).sum(axis=2, keepdims=True) * anchors[:, None]
        off[1] = np.where(np.linalg.norm(across, axis=2, keepdims=True) > 1e-6, across, off[1])
    anchors, off = np.concatenate((anchors, anchors)), off.reshape(-1, PARTNERS, dim)
    off -= (off * anchors[:, None]).sum(axis=2, keepdims=True) * anchors[:, None]
    off /= np.maximum(np.linalg.norm(off, axis=2, keepdims=True), 1e-300)
    return anchors, threshold * anchors[:, None] + math.sqrt(1 - threshold * threshold) * off


def _worst_recall(met: np.ndarray) -> float:
    """Share of pairs (m x PARTNERS) that met, of the tenth of the anchors that fares worst as the other half of their pairs tells."""
    told = np.argsort(met[:, ::2].mean(axis=1), kind="stable")[: max(1, len(met) // 10)]
    return float(met[told, 1::2].mean())


def learn(sample: np.ndarray, dim: int, n: int, threshold: float, recall: float, rounds: int = 15, seed: int = 5) -> Tables:
    """Tables for ``n`` vectors, by the recall and the size of buckets that they have on the sample.

    Substrings are tried from short to long, until the tables that the next would take are more work than the best of them.
    """
    rng = np.random.default_rng(seed)
    anchors, partners = _pairs_at(threshold, sample, dim, rng)
    cuts = _cuts(sample, dim, rounds, rng)
    directions, offsets = np.zeros((dim, 0)), np.zeros(0)
    same, signs = np.zeros((*partners.shape[:2], 0), dtype=bool), np.zeros((len(sample), 0), dtype=bool)
    best, least = Tables(1, np.zeros((dim, 1)), np.zeros(1)), 1 + n / PAIRS_A_ROW  # one bucket
    for bits in range(1, size_tables(n, threshold, recall)[0] + 1):
        met, tables, shared = np.zeros(partners.shape[:2], dtype=bool), 0, 0.0
        while (reached := _worst_recall(met) >= recall) is False and tables < least:
            lo, tables = tables * bits, tables + 1
            while directions.shape[1] < tables * bits:
                turned, cut = next(cuts)
                directions, offsets = np.concatenate((directions, turned), axis=1), np.concatenate((offsets, cut))
                same = np.concatenate((same, (anchors @ turned > cut)[:, None] == (partners @ turned > cut)), axis=2)
                signs = np.concatenate((signs, sample @ turned > cut), axis=1)
            met |= same[:, :, lo : tables * bits].all(axis=2)
            sizes = np.unique(np.packbits(signs[:, lo : tables * bits], axis=1), axis=0, return_counts=True)[1] if len(sample) > 1 else np.zeros(1)
            shared += max(0.5**bits, (sizes * (sizes - 1)).sum() / max(1, len(sample) * (len(sample) - 1)))
        if not reached:
            break
        if (work := tables + shared * n / PAIRS_A_ROW) < least:
            best, least = Tables(bits, directions[:, : tables * bits], offsets[: tables * bits]), work
    return best


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _tree(linked: np.ndarray) -> np.ndarray:
    """For each row a row that roots its tree in a spanning forest of the links, itself if it is a root."""
    root = np.full(len(linked), -1)
    for r in range(len(linked)):
        if root[r] < 0:
            root[r] = r
            front = [r]
            while front:
                near = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[near] = r
                front = near.tolist()
    return root


def _block_links(rows: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Links of one pair of blocks in one bucket, of those pairs that meet in no earlier table: cls, links, root."""
    unit = _unit(rows["vector"].tolist(), kind)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if rows["i"].iat[0] != rows["j"].iat[0]:
        own = rows["own"].to_numpy()
        linked &= own[:, None] != own[None, :]
    if linked.any():
        keys = np.stack(rows["keys"].tolist())
        for t in range(int(rows["t"].iat[0])):
            linked &= keys[:, t][:, None] != keys[:, t][None, :]
    cls = rows["cls"].to_numpy()
    out = pd.DataFrame({"cls": cls, "links": (linked * rows["size"].to_numpy()).sum(axis=1).astype(np.int64), "root": cls[_tree(linked)]})
    return out[out["links"] > 0]


_GROUP = ["dim", "t", "key", "i", "j"]


def _stream_blocks(batches, threshold: float, kind: str):
    """Rows come sorted by group; the last group of a batch waits for the next batch."""
    held = None
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        g = b[_GROUP].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1, [len(b)]))
        out = [_block_links(b.iloc[lo:hi], threshold, kind) for lo, hi in zip(starts[:-2], starts[1:-1], strict=True) if hi - lo > 1]
        held = b.iloc[starts[-2] :]
        if out:
            yield pd.concat(out, ignore_index=True)
    if held is not None and len(held) > 1:
        yield _block_links(held, threshold, kind)


def digest(column: str) -> Column:
    return F.xxhash64(column)


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    item = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    second = F.xxhash64(F.lit(1), "embedding")

    def classed(cls) -> tuple[DataFrame, DataFrame]:
        rows = embeddings.select("vec_id", F.when(good, cls).alias("cls"), "embedding")
        facts = [F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"), F.min(second).alias("low"), F.max(second).alias("high")]
        return rows, durable(rows.filter("cls IS NOT NULL").groupBy("cls").agg(*facts))

    rows, classes = classed(digest("embedding"))
    shared = [r["cls"] for r in classes.filter("low != high").select("cls").collect()]  # unlike vectors of one digest: about n^2 / 2^65
    if shared:
        rows, classes = classed(F.when(digest("embedding").isin(*shared), second).otherwise(digest("embedding")))
    n = classes.count()
    drawn = [np.asarray(r["embedding"], dtype=kind) for r in classes.orderBy("cls").limit(sample).select("embedding").collect()]
    lengths = [len(v) for v in drawn]
    common = max(set(lengths), key=lengths.count) if lengths else 1
    same = [v.tobytes() for v in drawn if len(v) == common]
    model = spark.sparkContext.broadcast(learn(_unit(same, kind) if same else np.zeros((0, common)), common, n, threshold, recall))

    def encode(batches):
        learned = {common: model.value}
        for b in batches:
            vectors = [np.asarray(v, dtype=kind) for v in b["embedding"]]
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in learned:
                    learned[dim] = learn(np.zeros((0, dim)), int(dim), n, threshold, recall)
                raw = [vectors[i].tobytes() for i in at]
                keys = learned[dim].keys(_unit(raw, kind))
                yield pd.DataFrame({"cls": b["cls"].to_numpy()[at], "size": b["size"].to_numpy()[at], "dim": int(dim), "vector": raw, "keys": list(keys)})

    coded = durable(python_rows(classes.select("cls", "size", "embedding"), encode, "cls bigint, size bigint, dim int, vector binary, keys array<bigint>"))
    short = coded.select("cls", "dim", F.posexplode("keys").alias("t", "key"))
    full = short.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("dim", "t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = short.join(full, ["dim", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cls", "dim", "t", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    gathered = members.join(coded.select("cls", "size", "vector", "keys"), "cls").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    links = durable(python_rows(gathered, lambda batches: _stream_blocks(batches, threshold, kind), "cls bigint, links bigint, root bigint"))
    joined = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("cls"), "component")
    facts = classes.select("cls", "size", "first_id").join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(joined, "cls", "left")
    lowest = facts.filter("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("lowest"))
    facts = facts.join(lowest, "component", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("lowest", "first_id").alias("lowest"))
    out = rows.select("vec_id", "cls").join(facts, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
