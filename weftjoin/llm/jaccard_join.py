r"""N-gram Jaccard join with set-relation skipping, exact: classes and numbers of links.

A document's set is its distinct ``k``-word shingles, kept as 64-bit hashes; texts with equal sets are one
set.  Two sets link when their intersection is at least ``percent`` hundredths of their union.  A set's id has 64 bits; a second
digest tells whether unlike sets share an id, and then serves as theirs.

*Highly similar sets.*  Every set has a few band keys of minimum hashes.  The set of a band group whose groups are the largest is the leader of
those that follow it; a leader and its verified followers, which all link with it, are a family.  Sets that found no
leader try again among what is left while that pays.  A missed follower costs time, never a link.

*Block skip.*  Shingles are ordered by (how frequent, hash), the rare ones first, and by the prefix principle two sets that link share a shingle
among the first ``n - ceil(percent * n) + 1`` of each.  These prefixes are an inverted index whose entries are families: sizes from and to,
first position.  A list is sorted by size and position and cut into blocks; two blocks whose sizes and positions rule a link out
are skipped whole, else the pairs of entries that may link by theirs are candidates.  Texts with a common passage meet in the list of each of
its shingles, so the entries of long lists carry the first long lists of their family, and a pair is given by the first that both
know of and whose sizes and positions let it pass.

*Verification.*  Candidates meet bitmaps of their leaders' sets first, which bound the intersection from above, and what may still link
meets whole sets.  Families whose leaders are too far apart for any of their members to link are dropped by the triangle inequality of
the Jaccard distance; leaders that link join their families; what stays open between two families is compared member by member.

*Derived answers.*  Inside a class the answers of a set, its intersections with all others, are derived from those of the most
similar set that was computed before it: only the lists of the shingles that one of both has and the other has not are
read, and added or taken off.  ``jaccard_links`` does that for every class and counts the links; ``jaccard_components`` only
where families are left open.  Classes are dealt out as pairs of blocks of at most ``LINK_BLOCK`` sets or ``BLOCK_SHINGLES`` shingles.

*Scale.*  Shingles that reach ``REPORTED`` documents in a chunk of the input are reported, and the most frequent of these, ``MOST_FREQUENT``
at most, are broadcast and come last in the order, the most frequent last of all, so lists are short but for sets that consist of frequent shingles
mostly.  Any order gives the same result.  Entries of frequent shingles are spread over ``SALTS`` parts and aggregated by family
before a list meets in one task.  Candidates of a list of mutually unlike families grow with the square of its
length, given once and not for each list that they share, and counting the links of a class of unlike sets with the square of its sets; nothing is capped.

Cases: null and empty texts, and texts without words, have no set and link with nothing; with fewer than ``k``
words the whole sequence is the one shingle; null doc_id is a row of its own (component null unless linked);
repeated rows link as equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.llm.components import components
from weftjoin.llm.support import dealt_anew, durable, mix64, python_rows, stored, utf8, window_hashes, words_of

SHINGLE = 5
PERCENT = 75
#: Shingles that are held at once for the reports, documents of a chunk from which on one is reported, and reports that make it frequent.
CHUNK_SHINGLES, REPORTED, LEAST_FREQUENT = 4_000_000, 3, 6
#: Frequent shingles at most (8 bytes each, broadcast), and parts that the entries of one are dealt to.
MOST_FREQUENT, SALTS = 4_000_000, 64
#: Band keys of a set, each of two minimum hashes, and followers in a round from which on another round is worth its jobs.
BANDS, PAYS = 6, 500
#: Entries of a block of an index list, entries from which on a list is long, and long lists of a family that its entries know of.
LIST_BLOCK, LONG_LIST, KNOWN_LISTS = 64, 64, 32
#: Ids of documents whose sets are fetched; up to so many (8 bytes each) go to the executors, more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Sets and shingles of a block of a class, and sets whose answers are kept to derive others from.
LINK_BLOCK, BLOCK_SHINGLES, BASES = 256, 1_000_000, 32


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(window_hashes(words_of(utf8(text))[2], k))


def set_id(shingles: np.ndarray, seed: int = 0x6A09E667F3BCC909) -> int:
    """A signed 64-bit digest of a set, independent of order."""
    total = mix64(shingles + np.uint64(seed)).sum(dtype=np.uint64) ^ (np.uint64(len(shingles)) << np.uint64(40))
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def check_id(shingles: np.ndarray) -> int:
    return set_id(shingles, 0xBB67AE8584CAA73B)


def _named(shingles: np.ndarray, shared_ids: frozenset) -> int:
    """A set's id; of unlike sets that share one, the second digest."""
    sid = set_id(shingles)
    return check_id(shingles) if sid in shared_ids else sid


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's low bits, in a power of two of at least twice as many bits."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, n: int, m: int) -> int:
    """No intersection of sets of ``n`` and ``m`` shingles with these bitmaps is larger: bits in common, and what had no bit of its own."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) if len(z) > size else z for z in (x, y))
    both, own_x, own_y = (int(np.bitwise_count(z).sum()) for z in (x & y, x, y))
    return min(n, m, both + min(n - own_x, m - own_y))


def _band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """``BANDS`` keys of each of some non-empty sets."""
    values, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    odd = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    least = [np.minimum.reduceat(values * f, starts) for f in odd]
    return list(np.stack([mix64(a + (b ^ np.uint64(t))) for t, (a, b) in enumerate(zip(least[::2], least[1::2], strict=True))], axis=1).view(np.int64))


_FACTS = "kind int, doc_id bigint, n bigint, value bigint, second bigint, bands array<bigint>, bits binary"


def _sets_and_reports(batches, k: int):
    """Rows (kind 0: doc_id, n, value = set id, second digest, bands, bits) and reports (kind 1: value = shingle, n = documents of a chunk that have it)."""
    pool, held = [], 0

    def report() -> pd.DataFrame:
        held = np.concatenate(pool)
        pool.clear()
        held.sort()
        values, times = np.unique(held[: -REPORTED + 1][held[: -REPORTED + 1] == held[REPORTED - 1 :]], return_counts=True)  # as often as REPORTED, and how often beyond
        blank = pd.array([None] * len(values), dtype="Int64")
        return pd.DataFrame({"kind": 1, "doc_id": blank, "n": times + (REPORTED - 1), "value": values.view(np.int64), "second": blank, "bands": None, "bits": None})

    for whole in batches:
        for at in range(0, len(whole), 500):
            b = whole.iloc[at : at + 500]
            sets = [shingle_set(text, k) for text in b["text"]]
            full = [s for s in sets if len(s)]
            keys = iter(_band_keys(full) if full else [])
            facts = [(len(s), set_id(s), check_id(s), next(keys), bitmap(s)) if len(s) else (0, 0, 0, None, None) for s in sets]
            n, value, second, bands, bits = zip(*facts, strict=True)
            yield pd.DataFrame({"kind": 0, "doc_id": b["doc_id"].astype("Int64").to_numpy(), "n": n, "value": value, "second": second, "bands": bands, "bits": bits})
            pool += full
            held += sum(n)
            if held >= CHUNK_SHINGLES:
                yield report()
                held = 0
    if pool:
        yield report()


def _prefixes(batches, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], shared_ids: frozenset):
    """(token, sid, n, pos, hot) of the prefix of every set; sets that a batch has twice are given once."""
    frequent, steps = frequent
    for b in batches:
        out, held, seen = [], 0, set()
        for text in b["text"]:
            s = shingle_set(text, k)
            if not len(s) or (sid := _named(s, shared_ids)) in seen:
                continue
            seen.add(sid)
            m, step = prefix_length(len(s), percent), np.zeros(len(s), dtype=np.uint8)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                step = np.where(frequent[at] == s, steps[at], np.uint8(0))
            early = np.argsort(step, kind="stable")[:m]  # by hash within a step
            out.append((s[early].view(np.int64), np.full(m, sid), np.full(m, len(s), dtype=np.int32), np.arange(m, dtype=np.int32), step[early] > 0))
            held += m
            if held > 100_000:
                yield _columns(out)
                out, held = [], 0
        if out:
            yield _columns(out)


def _columns(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("token", "sid", "n", "pos", "hot"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))


def _met(batches):
    """Of entries sorted by token, those of frequent tokens and those whose token more than one entry has."""
    last, met = None, False  # the entry that waits for the next batch, and whether one like it was given
    for b in batches:
        if not len(b):
            continue
        rows = b if last is None else pd.concat([last, b], ignore_index=True)
        token = rows["token"].to_numpy()
        same = token[1:] == token[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([met], same)) | rows["hot"].to_numpy()
        yield rows[keep[:-1].tolist() + [False]][["token", "sid", "n", "pos"]]
        last, met = rows.iloc[-1:], bool(same[-1]) if len(same) else met
    if last is not None and (met or last["hot"].iat[0]):
        yield last[["token", "sid", "n", "pos"]]


def could_link(n1, p1, n2, p2, percent: int = PERCENT):
    """Whether two sets whose first common entry is at positions ``p1`` and ``p2`` may link; plain arithmetic, on arrays too.

    What they have in common is then at or behind those positions.  A pair that links passes at its first common
    entry, so it may be dropped at any other.
    """
    most = np.minimum(n1 - p1, n2 - p2)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


def may_link(lo1, hi1, p1, lo2, hi2, p2, percent: int = PERCENT):
    """``could_link`` for some sizes from ``lo`` to ``hi``, and positions from ``p`` on."""
    sizes = (100 * hi1 >= percent * lo2) & (100 * hi2 >= percent * lo1)
    return sizes & (100 * hi1 - (100 + percent) * p1 >= percent * lo2) & (100 * hi2 - (100 + percent) * p2 >= percent * lo1)


def _list_pairs(batches, percent: int):
    """Candidates (x, y), x < y, of lists that stream by sorted by token, lo, pos."""
    held = None
    for b in batches:
        if not len(b):
            continue
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        token = rows["token"].to_numpy()
        end = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
        if end:
            yield from _block_pairs(rows.iloc[:end], percent)
        held = rows.iloc[end:]
    if held is not None:
        yield from _block_pairs(held, percent)


class _Known:
    """Of the entries of long lists: token, lo, hi and pos of their families' entries in long lists that come before."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        long = (rows["known"] != "").to_numpy()
        self.percent, self.place, own = percent, np.cumsum(long) - 1, rows["token"].to_numpy()[long]
        facts = [np.array(x.split(","), dtype=np.int64).reshape(-1, 4).T for x in rows["known"].to_numpy()[long]]
        parts = [[x[c] for x in facts] for c in range(4)]
        sizes = np.array([np.searchsorted(x, t) for x, t in zip(parts[0], own, strict=True)], dtype=np.int64)
        self.valid = np.arange(sizes.max(initial=0)) < sizes[:, None]
        self.token, self.lo, self.hi, self.pos = (np.zeros(self.valid.shape, dtype=np.int64) for _ in parts)
        for to, lists in zip((self.token, self.lo, self.hi, self.pos), parts, strict=True):
            if len(lists):
                to[self.valid] = np.concatenate([x[:n] for x, n in zip(lists, sizes, strict=True)])
        self.long = long

    def given(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a list before gives the pair, too."""
        out = np.zeros(len(i), dtype=bool)
        at = np.flatnonzero(self.long[i])
        for part in np.split(at, range(20_000, len(at), 20_000)):
            x, y = self.place[i[part]], self.place[j[part]]
            there, real = self.token[y], self.valid[y]
            for k in range(self.valid.shape[1]):
                same = (there == self.token[x, k][:, None]) & real & self.valid[x, k][:, None]
                w = np.flatnonzero(same.any(axis=1))
                a, b, c = x[w], y[w], same[w].argmax(axis=1)
                out[part[w]] |= may_link(self.lo[a, k], self.hi[a, k], self.pos[a, k], self.lo[b, c], self.hi[b, c], self.pos[b, c], self.percent)
        return out


def _with_known(lists: DataFrame) -> DataFrame:
    """``lists`` (token, fam, lo, hi, pos), and for entries of long ones the first ``KNOWN_LISTS`` of those that the family is in, by token.

    They travel as one text, empty for most: Spark takes the square of a batch's rows for columns of null arrays.
    """
    lists = stored(lists)
    long = stored(lists.groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") >= LONG_LIST).select("token"))
    if not long.take(1):
        return lists
    entry = F.struct("token", "lo", "hi", "pos")
    entries = stored(lists.join(dealt_anew(long, "token"), "token"))
    first = F.slice(F.sort_array(F.collect_list(entry)), 1, KNOWN_LISTS)
    known = entries.groupBy("fam").agg(F.array_join(F.transform(first, lambda x: F.concat_ws(",", x["token"], x["lo"], x["hi"], x["pos"])), ",").alias("known"))
    rest = lists.join(dealt_anew(long, "token"), "token", "left_anti").withColumn("known", F.lit(""))
    return rest.unionByName(entries.join(dealt_anew(known, "fam"), "fam"))


def _block_pairs(rows: pd.DataFrame, percent: int):
    """Candidates of whole lists: blocks of up to ``LIST_BLOCK`` entries of one list, each with itself and those before it that aren't skipped."""
    known = _Known(rows, percent) if "known" in rows and (rows["known"] != "").any() else None
    token, fam, lo, hi, pos = (rows[c].to_numpy() for c in ("token", "fam", "lo", "hi", "pos"))
    first = np.concatenate(([True], token[1:] != token[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    heads = np.flatnonzero((np.arange(len(rows)) - start) % LIST_BLOCK == 0)
    ends = np.append(heads[1:], len(rows))
    least, most, front = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), np.minimum.reduceat(pos, heads)
    opening = np.flatnonzero(start[heads] == heads)  # the first block of each list
    out, made = [], 0

    def pairs(i: np.ndarray, j: np.ndarray) -> int:
        ok = may_link(lo[i], hi[i], pos[i], lo[j], hi[j], pos[j], percent)
        if known is not None and ok.any():
            ok[ok] = ~known.given(i[ok], j[ok])
        if ok.any():
            a, b = fam[i[ok]], fam[j[ok]]
            out.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
            return int(ok.sum())
        return 0

    def taken() -> pd.DataFrame:
        got = np.unique(np.concatenate(out), axis=0)
        out.clear()
        return pd.DataFrame({"x": got[:, 0], "y": got[:, 1]})

    at = np.arange(len(rows))  # within blocks, all at once, by distance
    stop = np.repeat(ends, ends - heads)
    for step in range(1, LIST_BLOCK):
        at = at[at + step < stop[at]]
        if not len(at):
            break
        made += pairs(at, at + step)
        if made > 200_000:
            yield taken()
            made = 0
    for a, b in zip(opening, np.append(opening[1:], len(heads)), strict=True):
        for j in range(a + 1, b):
            near = a + np.flatnonzero(may_link(least[a:j], most[a:j], front[a:j], least[j], most[j], front[j], percent))
            for i in near:
                x, y = np.arange(heads[i], ends[i]), np.arange(heads[j], ends[j])
                made += pairs(np.repeat(x, len(y)), np.tile(y, len(x)))
                if made > 200_000:
                    yield taken()
                    made = 0
    if out:
        yield taken()


def _possible(pairs: DataFrame, reps: DataFrame, percent: int, reach: bool = False) -> DataFrame:
    """Pairs (x, y) of sets that may link by their bitmaps; with ``reach``, of families any members of which may."""
    side = lambda c: reps.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.lit(reach) | (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
    extra = ["radius"] if reach else []

    def run(batches):
        for b in batches:
            n, m = b["n_x"].to_numpy(), b["n_y"].to_numpy()
            o = np.array([most_shared(*row) for row in zip(b["bits_x"], b["bits_y"], n.tolist(), m.tolist(), strict=True)], dtype=np.int64)
            ok = 100 * o >= percent * (n + m - o)
            if reach:
                ok |= _within(n + m - o, o, b["radius"].to_numpy(), percent)
            yield b[ok][["x", "y", *extra]]

    return python_rows(both, run, "x bigint, y bigint" + ", radius double" * reach)


def _within(union, shared, radius, percent: int):
    """Whether the distance leaves room for a link between members; radius 0 stands for sets without followers."""
    return (radius > 0) & (1 - shared / union <= 1 - percent / 100 + radius + 1e-9)


def _fetch(documents: DataFrame, reps: DataFrame, wanted: DataFrame, k: int, shared_ids: frozenset) -> DataFrame:
    """(sid, shingles) of the sets with an id in ``wanted`` (sid)."""
    chosen = stored(wanted.distinct().join(reps.select("sid", "first_id"), "sid"))
    asked = chosen.count()
    ids = chosen.select("first_id").distinct()
    t, c = documents.select("doc_id", "text").alias("t"), (F.broadcast(ids) if asked <= BROADCAST_IDS else ids).alias("c")
    found = t.join(c, F.col("t.doc_id").eqNullSafe(F.col("c.first_id")), "left_semi").select("text")

    def whole(batches):
        for b in batches:
            sets = [s for s in (shingle_set(x, k) for x in b["text"]) if len(s)]
            yield pd.DataFrame({"sid": np.array([_named(s, shared_ids) for s in sets], dtype=np.int64), "shingles": [s.view(np.int64) for s in sets]})

    sets = stored(python_rows(found, whole, "sid bigint, shingles array<bigint>"))
    if sets.count() == asked:
        return sets
    return stored(sets.join(chosen.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))  # rows that share a doc_id


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with n (sizes added up) and o (shingles in common)."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return both.select(*pairs.columns, F.size(F.array_intersect("s_x", "s_y")).alias("o"), (F.size("s_x") + F.size("s_y")).alias("n"))


def _followers(reps: DataFrame, percent: int) -> DataFrame | None:
    """(x, y): sets and the leaders that they may link with; no set is in both columns, nor twice in the first."""
    keyed, found = stored(reps.select("sid", F.posexplode("bands").alias("t", "key"))), None
    while True:
        groups = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
        sized = keyed.join(dealt_anew(groups, "key"), ["t", "key"])
        central = sized.groupBy("sid").agg(F.sum("size").alias("weight"))
        keyed = stored(sized.select("sid", "t", "key").join(central, "sid"))
        leads = keyed.groupBy("t", "key").agg(F.max(F.struct("weight", "sid")).alias("lead")).select("t", "key", "lead.weight", F.col("lead.sid").alias("lead"))
        votes = keyed.drop("weight").join(dealt_anew(leads, "key"), ["t", "key"]).filter("sid != lead").groupBy("sid", "lead").agg(F.max("weight").alias("weight"), F.count("*").alias("votes"))
        tried = stored(votes.groupBy("sid").agg(F.max_by("lead", F.struct("weight", "votes", "lead")).alias("lead")))
        heads = tried.select(F.col("lead").alias("sid")).distinct()
        pairs = tried.join(heads, "sid", "left_anti").select(F.col("sid").alias("x"), F.col("lead").alias("y"))
        fresh = stored(_possible(pairs, reps, percent))
        found = fresh if found is None else found.unionByName(fresh)
        many, of = fresh.count(), tried.count()
        if many * 16 <= of or many < PAYS:
            return found
        gone = fresh.select(F.col("x").alias("sid")).unionByName(heads)
        keyed = stored(keyed.drop("weight").join(gone, "sid", "left_anti"))


def answers(sets: list[np.ndarray]) -> np.ndarray:
    """Intersections of all sets with all others, each set's derived from those of a similar one.

    The first set's are counted from the lists of its shingles.  A further set starts from the answers of that
    earlier one, of up to ``BASES``, with which it has most in common: lists of shingles that it has beyond it are added, lists of those that
    it lacks are taken off.  If its own lists are shorter than those, it is counted from them and is a base for others.
    """
    n = len(sets)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    place = np.cumsum(times > 1) - 1
    kept = times[at] > 1  # a shingle of one set alone is in no intersection
    owner, at, universe = owner[kept], place[at[kept]], int((times > 1).sum())
    own = np.split(at, np.searchsorted(owner, np.arange(1, n)))
    lengths = times[times > 1]
    ends = np.cumsum(lengths)
    listed = owner[np.argsort(at, kind="stable")]

    def count(elements: np.ndarray) -> np.ndarray:
        size = lengths[elements]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(listed[np.repeat(ends[elements] - size, size) + within], minlength=n)

    shared, bases, has = np.zeros((n, n), dtype=np.int64), [], np.zeros(universe, dtype=bool)
    for i, mine in enumerate(own):
        if bases:
            base = max(bases, key=lambda j: shared[j, i])
            has[own[base]] = True
            more = mine[~has[mine]]
            has[own[base]] = False
            has[mine] = True
            less = own[base][~has[own[base]]]
            has[mine] = False
            if lengths[more].sum() + lengths[less].sum() < lengths[mine].sum():
                shared[i] = shared[base] + count(more) - count(less)
                continue
        shared[i] = count(mine)
        if len(bases) < BASES:
            bases.append(i)
    return shared


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row a row that roots its tree in a spanning forest of the links, itself if it is a root."""
    root = np.full(len(linked), -1)
    for r in range(len(linked)):
        if root[r] < 0:
            root[r], front = r, [r]
            while front:
                near = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[near] = r
                front = near.tolist()
    return root


def _class_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the sets of one pair of blocks, each link counted by the size of the other set, and a spanning forest: sid, links, root."""
    sets = rows["shingles"].tolist()
    n, sid = np.array([len(s) for s in sets]), rows["sid"].to_numpy()
    shared = answers(sets)
    linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(linked, False)
    if rows["i"].iat[0] != rows["j"].iat[0]:
        own = rows["own"].to_numpy()
        linked &= own[:, None] != own[None, :]
    out = pd.DataFrame({"sid": sid, "links": linked.astype(np.int64) @ rows["set_size"].to_numpy(), "root": sid[_roots(linked)]})
    return out[out["links"] > 0]


_GROUP = ["cid", "i", "j"]


def _stream_links(batches, percent: int):
    """Rows come sorted by group; the last group of a batch waits for the next batch."""
    held = None
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        g = b[_GROUP].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1, [len(b)]))
        for lo, hi in zip(starts[:-2], starts[1:-1], strict=True):
            yield _class_links(b.iloc[lo:hi], percent)
        held = b.iloc[starts[-2] :]
    if held is not None and len(held):
        yield _class_links(held, percent)


def _inside(classes: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, links, root) of every pair of blocks of the classes (id, component): all pairs inside them."""
    inside = classes.select(F.col("id").alias("sid"), F.col("component").alias("cid")).join(reps.select("sid", "n", "set_size"), "sid")
    blocks = inside.groupBy("cid").agg(F.ceil(F.greatest(F.count("*") / LINK_BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = inside.join(blocks, "cid").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("sid", "set_size", "cid", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    gathered = placed.join(sets, "sid").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return stored(python_rows(gathered, lambda batches: _stream_links(batches, percent), "sid bigint, links bigint, root bigint"))


def _most_frequent(reports: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles with most reports, ``MOST_FREQUENT`` at most, and their steps: quarters of doublings of the reports, from 1."""
    step = F.greatest(F.floor(4 * F.log2("n")), F.lit(1)).cast("int").alias("step")
    total = stored(reports.groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_FREQUENT).select("value", step))
    left, least = MOST_FREQUENT, None
    for r in sorted(total.groupBy("step").agg(F.count("*").alias("many")).collect(), key=lambda r: -r["step"]):
        left -= r["many"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8)
    rows = total.filter(F.col("step") >= least).toArrow()
    values, steps = rows.column("value").to_numpy().astype(np.int64).view(np.uint64), rows.column("step").to_numpy().astype(np.uint8)
    order = np.argsort(values)
    return values[order], steps[order]


def _resolved(documents: DataFrame, k: int, percent: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sid), and what is known of each set: sid, set_size, component (null without links), lowest, and n_links if asked for."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    first = stored(python_rows(texts, lambda bs: _sets_and_reports(bs, k), _FACTS))
    rows = first.filter("kind = 0").select("doc_id", "n", F.col("value").alias("sid"), "second", "bands", "bits")

    def by_set(rows: DataFrame) -> DataFrame:
        facts = [F.min("doc_id").alias("first_id"), F.count("*").alias("set_size"), F.min("second").alias("low"), F.max("second").alias("high"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")]
        return stored(rows.filter("n > 0").groupBy("sid").agg(*facts))

    reps = by_set(rows)
    shared_ids = frozenset(r["sid"] for r in reps.filter("low != high").select("sid").collect())  # about N^2 / 2^65
    if shared_ids:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(*shared_ids), F.col("second")).otherwise(F.col("sid")))
        reps = by_set(rows)
    rows = rows.select("doc_id", "n", "sid")
    frequent = spark.sparkContext.broadcast(_most_frequent(first.filter("kind = 1")))

    led = _followers(reps, percent)
    sets = _fetch(texts, reps, led.select(F.col("x").alias("sid")).unionByName(led.select(F.col("y").alias("sid"))), k, shared_ids)
    families = stored(_overlap(led, sets).filter(100 * F.col("o") >= percent * (F.col("n") - F.col("o"))).withColumn("radius", 1 - F.col("o") / (F.col("n") - F.col("o"))))
    radius = families.groupBy(F.col("y").alias("fam")).agg(F.greatest(F.max("radius"), F.lit(1e-9)).alias("radius"))

    entries = python_rows(texts, lambda bs: _prefixes(bs, k, percent, frequent.value, shared_ids), "token bigint, sid bigint, n int, pos int, hot boolean")
    dealt = entries.repartition("token", F.when(F.col("hot"), F.pmod("sid", F.lit(SALTS))).otherwise(0)).sortWithinPartitions("token")
    met = python_rows(dealt, _met, "token bigint, sid bigint, n int, pos int")
    met = met.join(families.select(F.col("x").alias("sid"), F.col("y").alias("lead")), "sid", "left").withColumn("fam", F.coalesce("lead", "sid"))
    lists = met.groupBy("token", "fam").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"))
    lists = _with_known(lists).repartition("token").sortWithinPartitions("token", "lo", "pos", "fam")
    pairs = python_rows(lists, lambda bs: _list_pairs(bs, percent), "x bigint, y bigint").distinct()
    for c in ("x", "y"):
        pairs = pairs.join(radius.select(F.col("fam").alias(c), F.col("radius").alias(f"r_{c}")), c, "left").fillna(0.0, [f"r_{c}"])
    pairs = stored(pairs.select("x", "y", (F.col("r_x") + F.col("r_y")).alias("radius")))
    pairs = stored(_possible(pairs, reps, percent, reach=True))
    ends = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid")))
    sets = sets.unionByName(_fetch(texts, reps, ends.join(sets.select("sid"), "sid", "left_anti"), k, shared_ids))
    union = F.col("n") - F.col("o")
    judged = _overlap(pairs, sets).withColumn("linked", 100 * F.col("o") >= percent * union)
    near = (F.col("radius") > 0) & (1 - F.col("o") / union <= 1 - percent / 100 + F.col("radius") + 1e-9)
    judged = stored(judged.filter(F.col("linked") | near).select("x", "y", "linked"))

    edge = lambda df: df.select(F.col("x").alias("u"), F.col("y").alias("v"))
    sure = edge(families).unionByName(edge(judged.filter("linked")))
    left = edge(judged.filter("NOT linked"))
    if count_links:  # all pairs inside classes that any link may join; their links tell the classes
        wide = components(sure.unionByName(left))
        within = _inside(wide, reps, sets, percent)
        member = components(within.select(F.col("sid").alias("u"), F.col("root").alias("v"))) if left.take(1) else wide
    else:
        member, within = components(sure), None
        if left.take(1):
            for c in ("u", "v"):
                left = left.join(member.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")), c, "left")
            left = stored(left.filter("c_u IS NULL OR c_v IS NULL OR c_u != c_v").select("u", "v"))
        if left.take(1):
            wide = components(member.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(left))
            touched = left.select(F.col("u").alias("id")).unionByName(left.select(F.col("v").alias("id"))).join(wide, "id").select("component").distinct()
            within = _inside(wide.join(touched, "component", "left_semi"), reps, sets, percent)
            member = components(sure.unionByName(within.select(F.col("sid").alias("u"), F.col("root").alias("v"))))

    known = reps.select("sid", "first_id", "set_size").join(member.withColumnRenamed("id", "sid"), "sid", "left")
    lowest = known.filter("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("lowest"))
    known = known.join(lowest, "component", "left").select("sid", "set_size", "component", F.coalesce("lowest", "first_id").alias("lowest"))
    if count_links:
        known = known.join(within.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left")
        known = known.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("set_size") - 1).drop("links")
    return rows, known


def _by_document(rows: DataFrame, known: DataFrame, *more) -> DataFrame:
    known = dealt_anew(known, "sid")
    out = rows.join(known, (rows["sid"] == known["sid"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"), F.coalesce("set_size", F.lit(1)).alias("set_size"), *more)


def jaccard_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_size (documents with an equal set)."""
    return _by_document(*_resolved(documents, k, percent, count_links=False))


def jaccard_links(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: what ``jaccard_components`` gives, and n_links, the number of other documents that it links with."""
    return _by_document(*_resolved(documents, k, percent, count_links=True), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component of sets, that of the smallest (doc_id, set), all columns kept.

    Of rows that have both in common the one with the smallest text stays.  Rows without a set, which link
    with nothing, and rows without a doc_id stay.
    """
    rows, known = _resolved(documents, k, percent, count_links=False)
    rows = rows.filter("doc_id IS NOT NULL")
    joined = rows.join(dealt_anew(known.select("sid", F.coalesce("component", "sid").alias("component")), "sid"), "sid")
    first = joined.filter("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "sid")).alias("x")).select("x.doc_id", F.col("x.sid").alias("_set"))
    bare = rows.filter("n = 0").select("doc_id", F.lit(None).cast("bigint").alias("_set"))
    leads = durable(first.unionByName(bare))
    out = documents.filter("doc_id IS NULL")
    again = durable(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not again.take(1):
        return documents.join(leads, "doc_id", "left_semi").unionByName(out)

    def named(batches):
        for b in batches:
            ids = [set_id(s) if len(s) else None for s in (shingle_set(x, k) for x in b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "_set": pd.array(ids, dtype="Int64")})

    alike = documents.join(again, "doc_id", "left_semi")
    sets = durable(python_rows(alike.select("doc_id", "text").distinct(), named, "doc_id bigint, text string, _set bigint"))
    lowest = sets.join(leads, ["doc_id", "_set"], "left_semi").groupBy("doc_id", "_set").agg(F.min("text").alias("text")).select("doc_id", "text")
    once = alike.join(lowest, ["doc_id", "text"], "left_semi").dropDuplicates(["doc_id", "text"])
    d, e = alike.alias("d"), sets.filter("_set IS NULL").alias("e")
    empty = d.join(e, (F.col("d.doc_id") == F.col("e.doc_id")) & F.col("d.text").eqNullSafe(F.col("e.text")), "left_semi")
    single = documents.join(again, "doc_id", "left_anti").join(leads, "doc_id", "left_semi")
    return single.select(*documents.columns).unionByName(once.select(*documents.columns)).unionByName(empty).unionByName(out)
