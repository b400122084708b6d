"""Best-fit packing: best-two-fit over the histogram of piece lengths.

Documents are tokenised, ended with an end id and cut into pieces of the capacity at most.  Which lengths
go together depends on how many pieces of each length there are, not on which pieces, so the plan is made
on that histogram, which has no more rows than the capacity has tokens, whatever the corpus.  The plan is a
list of patterns, each used for a number of sequences: a bin takes the longest length left and then, again
and again, the longest that fits; if a gap stays, its smallest piece is exchanged for two unpacked ones
that fill the widened gap better.  A pattern is used as often as its lengths last, so each use runs a
length out and the plan stays short.  Then every piece gets its rank among the pieces of its length,
counted in salted parts of about ``RANKED`` pieces, as many as its pieces ask for, and the rank gives its place.

Cases: null and empty texts are the end id alone; null doc_id and repeated rows are packed as rows of their
own; an empty table gives no rows; a text of any length is tokenised whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftjoin.llm.support import durable, mix64, python_rows

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks, about.
RANKED = 200_000
MEMO_ENTRIES, MEMO_LENGTH = 400_000, 48
#: Characters of texts that are encoded together at once.
BATCH_CHARACTERS = 500_000
_SPACES = r" \t\n\x0b\x0c\r"
#: Any character but ASCII and the letters for which lower-casing is one character to one and no normalisation applies.
_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
#: Parts of texts with other characters: a stretch that has one is one part.
_MIXED_PARTS = re.compile(rf"[^{_SPACES}]*{_OTHER.pattern}[^{_SPACES}]*|(?i:'s|'t|'re|'ve|'m|'ll|'d)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^{_SPACES}0-9A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
#: Slots of a worker's table of parts, of two for each part, and the longest part in it (bytes).
SLOTS, LONGEST = 1 << 21, 16


def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, lower = np.full(256, _MARK, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for first, last, k in ((65, 90, _LETTER), (97, 122, _LETTER), (128, 255, _LETTER), (48, 57, _DIGIT), (9, 13, _SPACE), (32, 32, _SPACE)):
        kind[first : last + 1] = k
    lower[65:91] += 32
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    return kind, lower, masks


_KIND, _LOWER, _MASKS = _byte_kinds()


def parts_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (and 16 zeros), starts and ends of the tokenizer's parts of a text of ASCII and Latin letters.

    Runs of letters, single digits, runs of marks; an apostrophe that begins a run of marks is one part with an s, t, m, d, re, ve or
    ll behind it.
    """
    data = np.zeros(len(raw) + 16, dtype=np.uint8)
    data[: len(raw)] = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    after = np.flatnonzero(data[: len(raw)] == 0xC3) + 1  # capitals of two bytes are 32 below the small ones
    data[after] += np.where(data[after] < 0x9F, np.uint8(32), np.uint8(0))
    kind = _KIND[data[: len(raw)]]
    cut = np.ones(len(raw) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero((data[: len(raw)] == 39) & cut[:-1])
    if len(quote):
        one, two = data[quote + 1], data[quote + 2]
        single = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        cut[quote[single | double] + 1] = False
        cut[quote[single] + 2] = True
        cut[quote[double & ~single] + 3] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    said = kind[starts] != _SPACE
    return data, starts[said], ends[said]


#: Texts on which a tokenizer must agree with its parts before it is trusted to split as they do.
_PROBES = ["It's We'LL, don't'd '' 're\n12x3 \tÀÉß ÿy... (a_b)!'s", "", " ", "Word word wordword", "\x1c\x00 a\x0bb"]


class WordEncoder:
    """Ids of a word-end BPE whose pre-tokeniser lower-cases, drops white space and splits words, digits and marks, kept per part.

    Texts of ASCII and Latin letters are split by ``parts_of``, which says the same as the tokenizer, and parts of up to ``LONGEST`` bytes
    are looked up all at once in a table by their bytes.  In other texts, stretches between ASCII white space that hold any
    other character go to the library whole, and so do texts with a special string of the tokenizer.  All ids come from the library: many
    parts in one call, with spaces between, told apart by the one token that ends each.  A full table starts over.  A tokenizer that
    splits ``_PROBES`` in another way encodes every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        self.by_parts = all(x.tolist() == y.tolist() for x, y in zip(self._plain(_PROBES), self._whole(_PROBES), strict=True))

    def clear(self) -> None:
        self.memo: dict[str, np.ndarray] = {}  # parts of mixed texts
        self.slot = np.zeros(SLOTS, dtype=np.int32)  # number of the part that is kept there; 0: none
        self.low, self.high, self.first, self.size = (np.zeros(1, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.flat = np.zeros(0, dtype="<u4")

    def _whole(self, new: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _encoded(self, plain: list[str]) -> list[np.ndarray]:
        """Ids of parts as they stand between spaces."""
        out = []
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            out += np.split(ids, stops[:-1]) if len(stops) == len(part) else self._whole(part)
        return out

    def _mixed(self, text: str) -> np.ndarray:
        if "<|" in text and any(s in text for s in self.special):
            return self._whole([text])[0]
        parts = [p if _OTHER.search(p) else p.lower() for p in _MIXED_PARTS.findall(text)]
        new = [p for p in dict.fromkeys(parts) if p not in self.memo]
        other = [p for p in new if _OTHER.search(p)]
        plain = [p for p in new if not _OTHER.search(p)]
        found = dict(zip(other + plain, self._whole(other) + self._encoded(plain), strict=True))
        self.memo.update((p, x) for p, x in found.items() if len(p) <= MEMO_LENGTH)
        return np.concatenate([self.memo[p] if p in self.memo else found[p] for p in parts]) if parts else np.zeros(0, dtype="<u4")

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(low ^ mix64(high))
        return (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode() for t in texts]
        data, starts, ends = parts_of(b"\n".join(raws))
        length = ends - starts
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        low = words[starts] & _MASKS[np.minimum(length, 8)]
        high = words[starts + 8] & _MASKS[np.clip(length - 8, 0, 8)] if len(starts) else low
        short = (length <= LONGEST) & (data[ends - 1] != 0)  # a zero at the end would look like none
        one, two = self._places(low, high)
        at = self.slot[one]
        for place in (None, two):
            if place is not None:
                missed = np.flatnonzero(at == 0)
                at[missed] = self.slot[place[missed]]
            at[(self.low[at] != low) | (self.high[at] != high) | ~short] = 0
        missed = np.flatnonzero(at == 0)
        first, size, flat = self.first, self.size, self.flat
        first, size = first[at], size[at]
        if len(missed):
            raw = data.tobytes()
            own = [raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
            names = {c: i for i, c in enumerate(dict.fromkeys(own))}
            ids = self._encoded([c.decode() for c in names])
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            firsts = len(flat) + np.cumsum(sizes) - sizes
            which = np.fromiter(map(names.__getitem__, own), dtype=np.int64, count=len(own))
            first[missed], size[missed] = firsts[which], sizes[which]
            flat = np.concatenate((flat, *ids))
            once = missed[np.unique(which, return_index=True)[1]]
            self._keep(low[once], high[once], firsts, sizes, short[once], flat)
        stops = np.cumsum(size)
        out = flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - stops + size, size)]
        text_ends = np.cumsum([len(r) + 1 for r in raws])
        until = np.concatenate(([0], stops))[np.searchsorted(starts, text_ends)]
        return np.split(out, until[:-1])

    def _keep(self, low, high, first, size, short, flat) -> None:
        """Put new parts of up to ``LONGEST`` bytes into free slots; one that finds none is encoded again when it is met."""
        number = len(self.low) + np.arange(len(low), dtype=np.int32)
        for place in self._places(low, high):
            free = np.flatnonzero(short & (self.slot[place] == 0))
            self.slot[place[free]] = number[free]
            short = short & (self.slot[place] != number)
        self.low, self.high = np.concatenate((self.low, low)), np.concatenate((self.high, high))
        self.first, self.size, self.flat = np.concatenate((self.first, first)), np.concatenate((self.size, size)), flat

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_parts:
            return self._whole(texts)
        plain = [i for i, t in enumerate(texts) if not ("<|" in t and any(s in t for s in self.special)) and (t.isascii() or not _OTHER.search(t))]
        out = dict(zip(plain, self._plain([texts[i] for i in plain]) if plain else [], strict=True))
        result = [out[i] if i in out else self._mixed(t) for i, t in enumerate(texts)]
        if len(self.low) + len(self.memo) > MEMO_ENTRIES:
            self.clear()
        return result


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if ``keep_ids``, ids; only documents over the capacity are cut."""
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        for b in batches:
            size = np.cumsum([len(t or "") for t in b["text"]]) // BATCH_CHARACTERS
            for _, part in b.groupby(size, sort=False):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                encoded = encoder(tokenizer_path).encode([t or "" for t in part["text"]])
                for row, ids in enumerate(encoded):
                    ids = np.concatenate((ids, end))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        doc.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own.tolist())
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").iloc[doc].to_numpy(), "piece": piece, "start": start, "length": length, "ids_crc32": crc})
                yield out.assign(ids=kept) if keep_ids else out

    return python_rows(documents.select("doc_id", "text"), run, PIECES + (", ids array<int>" if keep_ids else ""))


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]
    times: int


def _largest_at_most(keys: list[int], left: dict[int, int], taken: Counter, limit: int) -> int:
    """The longest available length up to ``limit`` that isn't used up by the bin at hand; 0 if there is none."""
    i = bisect.bisect_right(keys, limit)
    while i:
        i -= 1
        if left[keys[i]] > taken[keys[i]]:
            return keys[i]
    return 0


def _best_two(keys: list[int], left: dict[int, int], taken: Counter, gap: int, least: int) -> tuple[int, int]:
    """Two available lengths of the largest sum in (``least``, ``gap``]; (0, 0) if there are none."""
    best, found = least, (0, 0)
    i = bisect.bisect_right(keys, gap - 1)
    while i:
        i -= 1
        x = keys[i]
        if 2 * x <= best:
            break
        if left[x] <= taken[x]:
            continue
        taken[x] += 1
        y = _largest_at_most(keys, left, taken, min(x, gap - x))
        taken[x] -= 1
        if y and x + y > best:
            best, found = x + y, (x, y)
            if best == gap:
                break
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up the histogram (length -> pieces)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    keys, out = sorted(left), []
    while keys:
        taken: Counter = Counter()
        bin_, gap = [], capacity
        while gap and (n := _largest_at_most(keys, left, taken, gap)):
            bin_.append(n)
            taken[n] += 1
            gap -= n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            taken[small] -= 1
            pair = _best_two(keys, left, taken, gap + small, small)
            if pair[0]:
                bin_[-1:] = pair
                taken[pair[0]] += 1
                taken[pair[1]] += 1
            else:
                taken[small] += 1
        times = min(left[n] // k for n, k in taken.items() if k)
        out.append(Pattern(tuple(bin_), times))
        for n, k in taken.items():
            if k:
                left[n] -= k * times
                if not left[n]:
                    keys.pop(bisect.bisect_left(keys, n))
    return out


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first rank, the pieces of that length in a sequence, the first sequence and offset."""
    rows, ranks, sequence = [], Counter(), 0
    for p in patterns:
        offset = 0
        for n, k in sorted(Counter(p.lengths).items(), reverse=True):
            rows.append((n, ranks[n], k, sequence, offset))
            ranks[n] += k * p.times
            offset += n * k
        sequence += p.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = durable(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = [(n, -(-many // RANKED)) for n, many in histogram.items()]  # a row for each length, no more than the capacity has
    salted = pieces.join(F.broadcast(pieces.sparkSession.createDataFrame(salts, "length long, salts long")), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    where = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))

    def run(batches):
        t = where.value
        firsts = t["length"] * (1 << 48) + t["rank"]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            i = np.searchsorted(firsts, length * (1 << 48) + rank, side="right") - 1
            at = rank - t["rank"][i]
            out = b[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"] = t["sequence"][i] + at // t["each"][i]
            out["offset"] = t["offset"][i] + at % t["each"][i] * length
            yield out

    return python_rows(ranked, run, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(cut_pieces(documents, tokenizer_path, capacity, end_id), capacity)
