r"""Benchmark decontamination: shared seeds, then greedy string tiling, then a threshold on the item's coverage.

Words are maximal runs of ASCII letters, digits, underscores and any other characters outside ASCII,
lower-cased, so case and punctuation don't hide a passage; a word is compared by its 64-bit hash.  A document and a benchmark item that share a seed (a run of ``least`` words) are tiled: the
longest common runs of unmarked words are found by running Karp-Rabin at a decreasing length, verified and
marked where they don't overlap, until none of ``least`` words is left.  The share of the item's words under
tiles is its coverage; a document that covers ``threshold`` of an item is contaminated.  Tiles may come in any
order, so a passage whose sentences were moved about is still covered.

The benchmark is the stated query set.  It is measured first.  Up to ``block_bytes`` of text, its words and seeds are
broadcast, about three times the text's bytes, and joined to all documents.  A larger one is taken in blocks of that size: a filter of
all seeds, of ``FILTER_BYTES`` at most, picks the documents with a seed in one scan, and each block meets those alone.

Cases: null and empty texts, and items, match nothing; rows without a doc_id are judged as any other; items of fewer than ``least`` words can't be told
from chance and match nothing; a text of any length is searched whole; repeated rows get equal results;
ties between items go to the smallest item_id; texts that share an item_id are each searched; an empty table on either side is fine; other columns are kept
by ``remove_contaminated`` and ignored by ``find_contaminated``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.llm.support import python_rows, rows_by_text, stored, utf8, window_hashes, words_of

LEAST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8_000_000
FILTER_BYTES = 1 << 26
_PARTS = np.array([c < 128 and not (chr(c).isalnum() or c == 95) for c in range(256)])
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def words(text: str | None) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    return words_of(utf8(text.lower()), _PARTS)[2] if text else np.zeros(0, dtype=np.uint64)


def _rolling(row: list[int], free: bytearray, size: int):
    """(hash, start) of every run of ``size`` unmarked words, each hash from the one before."""
    drop = pow(_BASE, size, _MOD)
    value = run = 0
    for i, w in enumerate(row):
        if not free[i]:
            value = run = 0
            continue
        value, run = (value * _BASE + w + 1) % _MOD, run + 1
        if run > size:
            value, run = (value - (row[i - size] + 1) * drop) % _MOD, size
        if run == size:
            yield value, i - size + 1


def _free_runs(free_t: bytearray, free_i: bytearray, i: int, j: int, n: int):
    """(offset, length) of the stretches of a match in which neither side is taken."""
    at = 0
    while at < n:
        if not (free_t[i + at] and free_i[j + at]):
            at += 1
            continue
        ends = (free_t.find(0, i + at, i + n) - i, free_i.find(0, j + at, j + n) - j)
        end = min((e for e in ends if e >= 0), default=n)
        yield at, end - at
        at = end


def greedy_tiles(text: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, length): longest first, no word in two of them, each of ``least`` words or more.

    A match is noted once, where it begins, so texts of repeated words have no more of them than positions in both; when
    its turn comes and earlier tiles took a part of it, what is left goes back to wait for its own turn.
    """
    free_t, free_i, tiles = bytearray(b"\1" * len(text)), bytearray(b"\1" * len(item)), []
    size = max(least, len(item))
    while size >= least:
        table = defaultdict(list)
        for h, j in _rolling(item, free_i, size):
            table[h].append(j)
        found = []
        for h, i in _rolling(text, free_t, size) if table else ():
            for j in table.get(h, ()):
                if i and j and free_t[i - 1] and free_i[j - 1] and text[i - 1] == item[j - 1]:
                    continue  # it begins further to the left
                if text[i : i + size] == item[j : j + size]:
                    n = size
                    while i + n < len(text) and j + n < len(item) and free_t[i + n] and free_i[j + n] and text[i + n] == item[j + n]:
                        n += 1
                    found.append((-n, i, j))
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            for at, run in _free_runs(free_t, free_i, i, j, -n):
                if run == -n:
                    free_t[i : i - n] = free_i[j : j - n] = bytes(-n)
                    tiles.append((i, j, -n))
                elif run >= size:
                    heapq.heappush(found, (-run, i + at, j + at))
        if 1 not in free_i or size == least:
            break
        size = max(least, size // 2)
    return tiles


class Seeds:
    """A block of the benchmark in flat arrays: the items' words, and for each seed, sorted by hash, the items that have it.

    Texts that share an item_id are items of their own.
    """

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        rows = [(item_id, words(text)) for item_id, text in sorted(set(items))]
        rows = [(item_id, row) for item_id, row in rows if len(row) >= least]
        self.ids = [item_id for item_id, _ in rows]
        self.words = np.concatenate([row for _, row in rows]) if rows else np.zeros(0, dtype=np.uint64)
        self.starts = np.cumsum([0, *(len(row) for _, row in rows)])
        seeds = [np.unique(window_hashes(row, least)) for _, row in rows]
        hashes = np.concatenate(seeds) if rows else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h in seeds])
        order = np.argsort(hashes, kind="stable")
        self.owner = owner[order]
        self.known, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))

    def coverages(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item_id, coverage, tiles) of the items that share a seed with ``text``."""
        row = words(text)
        if not len(self.known) or len(row) < self.least:
            return []
        hashes = window_hashes(row, self.least)
        seed = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = np.flatnonzero(self.known[seed] == hashes)
        places = defaultdict(list)
        for i, s in zip(at.tolist(), seed[at].tolist(), strict=True):
            for k in self.owner[self.first[s] : self.first[s + 1]].tolist():
                places[k].append(i)
        out = []
        for k, starts in places.items():
            stretch: list[int] = []  # only stretches under seeds can hold a tile; -1 keeps them apart
            end = -1
            for i in starts:
                if i > end:
                    stretch.append(-1)
                    end = i
                stretch.extend(row[end : i + self.least].tolist())
                end = i + self.least
            item = self.words[self.starts[k] : self.starts[k + 1]].tolist()
            tiles = greedy_tiles(stretch, item, self.least)
            out.append((self.ids[k], sum(n for _, _, n in tiles) / len(item), len(tiles)))
        return out


class SeedFilter:
    """Bits of the seeds of all blocks: a text that hits none shares a seed with no item.  Too few bits only let more texts through."""

    def __init__(self, n_words: int):
        self.bits = np.zeros(min(FILTER_BYTES, max(1 << 10, 1 << (2 * n_words).bit_length())), dtype=np.uint8)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = hashes & np.uint64(8 * len(self.bits) - 1)
        return (place >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8))

    def add(self, seeds: Seeds) -> None:
        byte, bit = self._places(seeds.known)
        np.bitwise_or.at(self.bits, byte, bit)

    def hits(self, text: str | None, least: int) -> bool:
        row = words(text)
        if len(row) < least:
            return False
        byte, bit = self._places(window_hashes(row, least))
        return bool((self.bits[byte] & bit).any())


RESULT = "contaminated boolean, item_id bigint, coverage double, n_tiles int, items array<bigint>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    good = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = good.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes) or 1
    return [good.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def _judged(documents: DataFrame, block: DataFrame, least: int, threshold: float) -> DataFrame:
    seeds = documents.sparkSession.sparkContext.broadcast(Seeds(sorted((r["item_id"], r["text"]) for r in block.collect()), least))

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                found = seeds.value.coverages(text)
                best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, 0.0, 0))
                over = sorted({i for i, c, _ in found if c >= threshold})
                rows.append((bool(over), best[0], best[1], best[2], over))
            out = pd.DataFrame(rows, columns=["contaminated", "item_id", "coverage", "n_tiles", "items"])
            out["item_id"] = out["item_id"].astype("Int64")
            yield pd.concat([b.drop(columns=["text"]).reset_index(drop=True), out], axis=1)

    keys = [f for f in documents.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), RESULT])
    return python_rows(documents, run, schema)


def _keyed(documents: DataFrame, *more) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size"), *more)


def _same(k: str, m: str):
    return F.col(f"{k}.doc_id").eqNullSafe(F.col(f"{m}.doc_id")) & (F.col(f"{k}.hash") == F.col(f"{m}.hash")) & (F.col(f"{k}.size") == F.col(f"{m}.size"))


def _over_blocks(documents: DataFrame, blocks: list[DataFrame], least: int, threshold: float) -> DataFrame:
    """What the blocks tell of documents with a seed: doc_id, hash, size, contaminated, b (best item), items.

    One scan sends the texts that hit the filter of all seeds to the shared folder; only those are judged, block by block.
    """
    of_all = SeedFilter(sum(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for b in blocks))
    for block in blocks:  # one at a time on the driver
        of_all.add(Seeds([(r["item_id"], r["text"]) for r in block.collect()], least))
    shared = documents.sparkSession.sparkContext.broadcast(of_all)
    keyed = _keyed(documents, "text")
    candidates = stored(rows_by_text(keyed, lambda texts: [shared.value.hits(t, least) for t in texts]))
    union = None
    for block in blocks:
        found = _judged(candidates, block, least, threshold).filter("item_id IS NOT NULL")
        union = found if union is None else union.unionByName(found)
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", (-F.col("item_id")).alias("i")))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    return union.groupBy("doc_id", "hash", "size").agg(F.max("contaminated").alias("contaminated"), best.alias("b"), items)


def find_contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id and coverage of the most covered item, n_tiles, items (all at the threshold)."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return _judged(documents.select("doc_id", "text"), blocks[0], least, threshold)
    k, m = _keyed(documents).alias("k"), _over_blocks(documents, blocks, least, threshold).alias("m")
    joined = k.join(m, _same("k", "m"), "left")
    return joined.select(
        "k.doc_id", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), "b.item_id", F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("b.n_tiles", F.lit(0)).alias("n_tiles"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that cover no item to the threshold, all columns kept."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        bad = _over_blocks(documents, blocks, least, threshold).filter("contaminated").alias("m")
        rows = _keyed(documents, F.struct("*").alias("row")).alias("k")  # in one column, so that no name can clash
        return rows.join(bad, _same("k", "m"), "left_anti").select("k.row.*")
    seeds = documents.sparkSession.sparkContext.broadcast(Seeds(sorted((r["item_id"], r["text"]) for r in blocks[0].collect()), least))
    return rows_by_text(documents, lambda texts: [all(c < threshold for _, c, _ in seeds.value.coverages(t)) for t in texts])
