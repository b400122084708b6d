"""Components, n-gram Jaccard join, embedding near-duplicates."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftjoin.llm import components, jaccard_join, near_vectors


def by_union(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_noise(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    good = [(a, b) for a, b in edges if a is not None and a != b]
    want = by_union({x for e in good for x in e}, good)
    assert {r["id"]: r["component"] for r in components.components(df).collect()} == want
    assert components.components(df.filter("u < 0")).collect() == []


def sets_of(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def check_jaccard(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string, sid string").repartition(3)).collect()}
    sets = {i: sets_of(t) for i, t in enumerate(texts)}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = by_union(sets, edges)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    return edges


def edited(rnd, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return " ".join(words)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, other, line = fresh(80), fresh(80), " ".join(fresh(20))
    texts = [None, "", "  \n ", "one two", "One  Two", "a b c d e", "A b c d E", "é É"]
    texts += [edited(rnd, base, k % 7, vocabulary) for k in range(60)]  # a large group around the threshold
    texts += [edited(rnd, other, k % 3, vocabulary) for k in range(10)] + [" ".join(other)] * 5
    texts += [" ".join(fresh(rnd.randrange(3, 40))) + " " + line for _ in range(30)]  # a passage that many share
    chain = fresh(60)
    for _ in range(12):  # neighbours link, ends don't
        texts.append(" ".join(chain))
        chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
    assert len(check_jaccard(spark, texts)) > 50


def test_lists_that_hold_several_components_are_taken_up_again(spark):
    """Sets around one core whose leader links with few of them, while others link among themselves."""
    core = [f"c{i}" for i in range(40)]
    texts = [" ".join(core + [f"{g}x{i}" for i in range(12)] + [f"{g}y{j}"]) for g in "abcdef" for j in range(4)]
    check_jaccard(spark, texts)


@pytest.mark.parametrize("block", [256, 8])
def test_links_are_counted_whole(spark, monkeypatch, block):
    """Every link of a group of near copies, equal texts included, not only those that join components."""
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", block)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    texts = [None, "", "one two", "One  Two", "a b c"] + [edited(rnd, base, i % 6, vocabulary) for i in range(50)] + [" ".join(base)] * 3
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_links(df).collect()}
    sets = [sets_of(t) for t in texts]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert sum(want) > 500 and [got[i]["n_links"] for i in range(len(texts))] == want
    plain = {r["doc_id"]: r for r in jaccard_join.jaccard_components(df).collect()}
    assert all(got[i].asDict() == plain[i].asDict() | {"n_links": got[i]["n_links"]} for i in got)


def test_prefix_and_filters():
    for n in range(1, 60):
        assert jaccard_join.prefix_length(n) == n - -(-3 * n // 4) + 1
    assert bool(jaccard_join.could_link(4, 0, 3, 0)) and not bool(jaccard_join.could_link(5, 0, 3, 0)) and not bool(jaccard_join.could_link(100, 30, 100, 0))


@pytest.mark.parametrize("block", [2, 8, 64])
def test_lists_give_the_pairs_that_may_link_in_any_batches_and_blocks(monkeypatch, block):
    import pandas as pd

    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rnd = random.Random(9)
    rows = {(t, f): (t, n := rnd.randrange(4, 90), rnd.randrange(n // 3 + 1), f, n + rnd.choice([0, 0, 5])) for t in (3, -5, 8, 9, 11) for f in range(1, rnd.choice([2, 7, 90]) + 1)}
    df = pd.DataFrame(sorted(rows.values()), columns=["token", "lo", "pos", "fam", "hi"])
    compared = []
    real = jaccard_join.may_link
    monkeypatch.setattr(jaccard_join, "may_link", lambda *x: compared.append(np.size(x[0])) or real(*x))

    def run(cuts):
        parts = list(jaccard_join._list_pairs((df.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(df)], strict=True)), 75))
        return sorted({tuple(r) for p in parts for r in p.to_numpy().tolist()})

    want = set()
    for a in df.itertuples():
        for b in df.itertuples():
            if a.token == b.token and a.fam < b.fam and any(bool(jaccard_join.could_link(n, a.pos, m, b.pos)) for n in range(a.lo, a.hi + 1) for m in range(b.lo, b.hi + 1)):
                want.add((a.fam, b.fam))
    whole = run([])
    in_lists = sum(k * (k - 1) // 2 for k in df.groupby("token").size())
    assert want <= set(whole) and (block == 64 or sum(compared) < 0.8 * in_lists)  # whole blocks were skipped
    for cuts in ([1], [2, 3, 4], list(range(1, len(df))), [len(df) // 2]):
        assert run(cuts) == whole


@pytest.mark.parametrize("first", [2, 32])
def test_pairs_of_long_lists_are_given_once(spark, monkeypatch, first):
    """Families that meet in many lists, of sizes and positions of their own in each: the same pairs, and by the first list only."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 8)
    monkeypatch.setattr(jaccard_join, "KNOWN_LISTS", first)
    rnd = random.Random(4)
    rows = [(t, f, n := rnd.randrange(40, 60), n + rnd.choice([0, 5]), rnd.randrange(12)) for t in range(-6, 6) for f in range(1, 5 if t == 3 else 40) if rnd.random() < 0.8]
    lists = spark.createDataFrame(rows, "token bigint, fam bigint, lo int, hi int, pos int")
    order = ["token", "lo", "pos", "fam"]
    pairs = lambda df: [tuple(r) for p in jaccard_join._list_pairs([df.sort_values(order, ignore_index=True)], 75) for r in p.to_numpy().tolist()]
    by_list = lambda df: [x for _, one in df.groupby("token") for x in pairs(one)]
    plain, known = lists.toPandas(), jaccard_join._with_known(lists).toPandas()
    assert len(known) == len(rows) and (known["known"] == "").sum() == (plain["token"] == 3).sum() > 0
    assert set(pairs(known)) == set(pairs(plain)) and len(by_list(plain)) > 3 * len(set(pairs(plain)))
    long = by_list(known[known["token"] != 3])
    assert len(long) == len(set(long)) if first == 32 else len(set(long)) < len(long) < len(by_list(plain))


def test_entries_that_meet_in_any_batches():
    import pandas as pd

    rnd = random.Random(2)
    df = pd.DataFrame(sorted((rnd.randrange(40), i, 9, i % 4, rnd.random() < 0.1) for i in range(60)), columns=["token", "sid", "n", "pos", "hot"])
    many = df.groupby("token")["sid"].transform("size") > 1
    want = df[many | df["hot"]]["sid"].tolist()
    for cuts in ([], [1], list(range(1, 60)), [7, 7, 30]):
        parts = list(jaccard_join._met(df.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 60], strict=True)))
        assert [x for p in parts for x in p["sid"]] == want


@pytest.mark.parametrize("bases", [1, 32])
def test_derived_answers_are_those_of_all_pairs(monkeypatch, bases):
    monkeypatch.setattr(jaccard_join, "BASES", bases)
    rng = np.random.default_rng(4)
    cores = [rng.integers(0, 1 << 40, 80, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate((rng.choice(cores[i % 3], 70, replace=False), rng.integers(0, 1 << 40, i % 9, dtype=np.uint64)))) for i in range(60)] + [cores[0][:1]]
    lists = []
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, **k: lists.append(len(x)) or real(x, **k))
    got = jaccard_join.answers(sets)
    monkeypatch.undo()
    for i, a in enumerate(sets):
        assert all(got[i, j] == len(np.intersect1d(a, b)) for j, b in enumerate(sets) if i != j)
    read = sum(lists)
    straight = sum(sum(x in set(b.tolist()) for b in sets) for a in sets for x in a.tolist())
    assert bases == 1 or read < 0.7 * straight  # most lists were not read


def test_bitmaps_bound_intersections():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        most, shared = jaccard_join.most_shared(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b)), len(np.intersect1d(a, b))
        assert shared <= most <= min(len(a), len(b))


@pytest.mark.parametrize("never", ["families", "frequent"])
def test_result_is_the_same_without_families_or_frequent_shingles(spark, monkeypatch, never):
    """Both only save work."""
    if never == "families":
        monkeypatch.setattr(jaccard_join, "_followers", lambda reps, percent: reps.select(reps["sid"].alias("x"), reps["sid"].alias("y")).filter("x < y"))
    else:
        monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 10**9)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(200)]
    bases = [[rnd.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    check_jaccard(spark, [edited(rnd, bases[i % 3], i % 5, vocabulary) for i in range(40)] + ["a b"])


def test_unlike_sets_that_share_an_id_stay_apart(spark, monkeypatch):
    one, two = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    ids = frozenset(jaccard_join.set_id(jaccard_join.shingle_set(t)) for t in (one, two))
    facts, prefixes, fetch = jaccard_join._sets_and_reports, jaccard_join._prefixes, jaccard_join._fetch

    def collide(batches, k):
        for out in facts(batches, k):
            yield out.assign(value=out["value"].where(out["n"] != 8, 7))

    monkeypatch.setattr(jaccard_join, "_sets_and_reports", collide)
    monkeypatch.setattr(jaccard_join, "_prefixes", lambda bs, k, p, f, shared: prefixes(bs, k, p, f, shared | (ids if 7 in shared else shared)))
    monkeypatch.setattr(jaccard_join, "_fetch", lambda t, r, w, k, shared: fetch(t, r, w, k, shared | (ids if 7 in shared else shared)))
    df = spark.createDataFrame([(1, one), (2, two), (3, one), (4, two + " c")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_links(df).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (2, 1)}


def test_jaccard_cases(spark):
    """Empty table, rows without or with equal doc_id, one very long text, columns with clashing names."""
    schema = "doc_id bigint, text string, n bigint, sid string, value string, fam string"
    assert jaccard_join.jaccard_links(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{i % 7919}x{i % 104729}" for i in range(200_000))
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    rows = [(1, long), (2, long + " end"), (3, a), (3, b), (3, a), (None, b), (None, "q r s"), (4, None)]
    got = jaccard_join.jaccard_links(spark.createDataFrame([(i, t, 0, "", "", "") for i, t in rows], schema)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in got) == sorted(
        [("1", 199_996, "1", 1), ("2", 199_997, "1", 1), ("3", 8, "3", 1), ("3", 8, "3", 1), ("3", 8, "3", 1), ("None", 8, "3", 1), ("None", 1, "None", 0), ("4", 0, "4", 0)]
    )


def test_one_document_of_each_component(spark):
    text = "a b c d e f g h i j k"
    rows = [(3, text, 1), (1, text, 2), (2, text + " l", 3), (5, "quite another text of more words", 4), (5, "quite another text of more words", 4), (None, text, 6), (9, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "5", "9", "None"]


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a, 1), (1, b, 2), (3, c, 3), (4, c + " d", 4), (4, "e f g", 5), (3, c, 6), (5, None, 7), (5, a + " x", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    out = jaccard_join.one_of_each(df)
    got = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"])
    assert out.columns == df.columns and got == sorted([(1, a), (1, b), (3, c), (4, "e f g")]) and out.filter("text IS NULL").count() == 1


# --- vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")


def check_vectors(spark, rows, **options):
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(vectors(spark, rows), **options).collect()}
    good = {i: np.asarray(v, dtype=np.float32).astype(np.float64) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 - 1e-12}
    return got, links


def test_vectors_edge_cases(spark):
    rows = [(0, None, "x"), (1, [], "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0, None], "x"), (5, [float("inf"), 1.0], "x")]
    rows += [(6, [1.0, 2.0], "x"), (7, [1.0, 2.0], "y"), (8, [1e-30, 2e-30], "x"), (9, [1.0, 2.0, 0.0], "x"), (10, [-1.0, -2.0], "x")]
    got, _ = check_vectors(spark, rows)
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(6)] == [(0, i, True) for i in range(6)]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (6, 7, 8, 9, 10)] == [(2, 6), (2, 6), (2, 6), (0, 9), (0, 10)]
    assert near_vectors.near_vectors(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("block", [512, 16])
def test_vector_recall_and_precision(spark, block):
    rng = np.random.default_rng(8)
    centres, rows = rng.standard_normal((60, 24)), []
    for i in range(600):
        c = centres[i % 60] if i < 400 else centres[0] if i < 480 else rng.standard_normal(24)
        rows.append((i, (c + rng.standard_normal(24) * rng.choice([0.05, 0.15, 0.22])).tolist(), "x"))
    rows += [(1000 + i, rows[0][1], "copy") for i in range(20)]
    got, links = check_vectors(spark, rows, block=block)
    true = defaultdict(int)
    for a, _ in links:
        true[a] += 1
    assert all(got[i]["n_links"] <= true[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * len(links)
    assert all(got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.mark.parametrize("kind", ["common mean", "hot group"])
def test_vector_recall_where_centring_widens_angles(spark, kind):
    """Pairs just over the threshold, of vectors with a mean cosine of 0.7, or in a group that is a third of the rows."""
    rng = np.random.default_rng(3)
    free = unit(rng.standard_normal((4000, 64)))
    if kind == "common mean":
        base = unit(np.sqrt(0.7) * unit(rng.standard_normal(64)) + np.sqrt(0.3) * free)
        off = rng.standard_normal((2000, 64))
        off = unit(off - (off * base[:2000]).sum(axis=1, keepdims=True) * base[:2000])
        cosine = rng.uniform(0.951, 0.955, (2000, 1))
        x = np.concatenate((base, cosine * base[:2000] + np.sqrt(1 - cosine**2) * off))
    else:
        x = np.concatenate((free, unit(unit(rng.standard_normal(64)) + 0.23 * unit(rng.standard_normal((2000, 64))))))
    x = x.astype(np.float32)
    wide = unit(x.astype(np.float64))
    linked = wide @ wide.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    got = near_vectors.near_vectors(vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert (got <= want).all() and want.sum() >= 3900 and got.sum() >= 0.94 * want.sum()


def test_table_sizes_follow_the_data():
    small, large = near_vectors.size_tables(1000, 0.95, 0.95), near_vectors.size_tables(10**9, 0.95, 0.95)
    assert small[0] < large[0] and small[1] < large[1]


def test_vectors_that_share_a_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "digest", lambda c: F.size(c).cast("long"))
    got, _ = check_vectors(spark, [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 0.0], "x"), (4, [1.0, 0.0, 0.0], "x")])
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_vectors_without_id_and_with_clashing_columns(spark):
    rows = [(None, [1.0, 2.0], 1, 1), (5, [1.0, 2.0], 1, 1), (None, None, 1, 1), (6, [1.0, 2.0], 1, 1), (6, [1.0, 2.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links int, cls int")
    got = sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in near_vectors.near_vectors(df).collect())
    assert got == ["(5, 3, 5)", "(6, 3, 5)", "(6, 3, 5)", "(None, 0, None)", "(None, 3, 5)"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_of_pairs_planted_among_the_vectors(spark):
    """Vectors at cosine 0.95 to 0.96 from rows of the table, which the rotation never saw: its sample is other rows."""
    x = unit(np.stack(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toPandas()["embedding"].to_list()).astype(np.float64))
    rng = np.random.default_rng(4)
    model = near_vectors.learn(x[1000:], x.shape[1], 50_000, 0.95, 0.95)
    base = x[:1000]
    off = rng.standard_normal(base.shape)
    off = unit(off - (off * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.95, 0.96, (len(base), 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * off
    assert model.bits > 4 and (model.keys(base) == model.keys(near)).any(axis=1).mean() >= 0.9
