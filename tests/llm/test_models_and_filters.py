"""Subword models, quality and toxicity, URL filters, decontamination, the pipeline and the registry."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftjoin.llm import decontaminate, labelled, queries, quality, subword, toxicity, url_filter
from weftjoin.llm.support import window_hashes, words_of

DATA, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_words_and_windows():
    starts, ends, hashes = words_of("Ab  \tc\x0bÉ ab".encode())
    raw = "Ab  \tc\x0bÉ ab".encode()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["Ab", "c", "É", "ab"]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3
    assert len(words_of(b"")[2]) == 0 and len(words_of(b" \n")[2]) == 0
    assert len(window_hashes(hashes, 5)) == 1 and len(window_hashes(hashes, 2)) == 3
    assert window_hashes(hashes[:2], 2)[0] != window_hashes(hashes[:2][::-1], 2)[0]


def test_scoring_equals_the_embedding_form():
    """The table of numbers per bucket gives what means of embeddings under the softmax give."""
    for s in (subword.Settings(buckets_log2=10, dim=4), subword.Settings(buckets_log2=10, dim=4, passage=3, least=12)):
        rng = np.random.default_rng(1)
        m = subword.Model(s, rng.standard_normal((1 << 10, 4)).astype(np.float32), rng.standard_normal((2, 4)).astype(np.float32), 0.2)
        for text in ("One two two two three é four five six", "x", " a  a "):
            z = []
            for ids in subword.features(text.encode(), s):
                hidden = m.embeddings[ids].sum(axis=0) / max(len(ids), s.least)
                z.append(hidden @ m.weights[1] - hidden @ m.weights[0] + m.bias)
            assert abs(subword.score(text.encode(), m.logits(), m.bias, s) - 1 / (1 + np.exp(-max(z)))) < 1e-5
        assert subword.features(b"", s) == [] and 0 < subword.score(b"", m.logits(), m.bias, s) < 1


def test_misspelt_words_share_vectors():
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choices("abcdefghij", k=7))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 3 == 0:
            words[rnd.randrange(60)] = rnd.choice(["wretched", "scoundrel", "vilest"])
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    m = subword.train(texts, labels, toxicity.SETTINGS)
    score = lambda t: subword.score(t.encode(), m.logits(), m.bias, m.settings)
    plain = " ".join(word() for _ in range(60))
    assert score(plain + " wretchedd") > 0.5 > score(plain) and score(plain + " scoundrell") > 0.5


def test_one_class_or_no_labels():
    assert subword.score(b"x", subword.train([b"a"], [1], subword.Settings()).logits(), 3.0, subword.Settings()) > 0.9
    assert subword.train([], [], subword.Settings()).bias == 0


@pytest.mark.parametrize("mod,label,low", [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
@has_data
def test_held_out_accuracy(spark, mod, label, low):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = {"quality": quality.score_quality, "toxic": toxicity.score_toxicity}[label](docs, labels)
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    divisor, held = mod.FOLD
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == held) for r in rows)
    assert labelled.held_out_auc(scored, labels, label) > low


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (3, "good words here", "c"), (3, "good words here", "c"), (4, "x" * 200_000, "c")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None), (1, 0, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 6 and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == [] and quality.score_quality(docs, labels.limit(0)).count() == 6
    assert quality.keep_good(docs, labels).columns == docs.columns


# --- urls

RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "org", "/es/")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?q#f", "x://example.com/en/8", "x://notexample.com/en/7", "x://É.org/es/?a://b", "x://a.org?x/es/", "x://h#/p", "a://b://c/d", "x://EXAMPLE.com/EN/7"]
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages(spark, [(i, u, None, "x") for i, u in enumerate(urls)]), RULES).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        assert (got[i]["host"], got[i]["path"]) == (host, path)
    assert [got[i]["rule"] for i in (4, 5, 6, 7, 8, 11)] == ["example.com/en/7", "com/en/", "com/en/", "org/es/", None, None]
    assert got[4]["verdict"] == "allow" and got[5]["verdict"] == "block"
    assert url_filter.judge_pages(pages(spark, []), RULES).collect() == []


def test_trust_and_distrust_flow(spark):
    link = lambda *hosts: "".join(f'<p><A class=x HREF="http://{h}/y">z</a>' for h in hosts)
    rows = [
        (1, "x://bad.com/en/1", link("bad2.net"), ""), (2, "x://farm.net/a", link("bad.com", "bad.com"), ""), (3, "x://www.example.com/en/7", link("fine.net"), ""),
        (4, "x://fine.net/a", "<a href='//FINE2.net/q'>", ""), (5, "x://fine2.net/a", '<a href="/own">', ""), (6, "x://lone.net/", None, ""), (7, "x://farm2.net/", link("farm.net"), ""),
    ]
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages(spark, rows), RULES).collect()}
    assert [got[i]["verdict"] for i in range(1, 8)] == ["block", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[4]["trust"] > got[5]["trust"] > 0 == got[6]["trust"] and got[2]["distrust"] > got[7]["distrust"] > 0


def test_propagation_against_dense_matrices(spark):
    rng = np.random.default_rng(2)
    n, edges = 12, {}
    for _ in range(40):
        a, b = rng.integers(0, n, 2)
        if a != b:
            edges[(int(a), int(b))] = edges.get((int(a), int(b)), 0) + 1
    seeds = {0: (3, 0), 1: (1, 2), 5: (0, 1)}
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, links bigint")
    s = spark.createDataFrame([(f"h{k}", *v) for k, v in seeds.items()], "host string, allow bigint, block bigint")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(e, s, iterations=8, tolerance=0).collect()}
    m = np.zeros((n, n))
    for (a, b), w in edges.items():
        m[a, b] = w
    for k, (matrix, col) in enumerate([(m, 0), (m.T, 1)]):
        total = matrix.sum(axis=1, keepdims=True)
        p = np.divide(matrix, total, out=np.zeros_like(matrix), where=total > 0)
        v0 = np.array([seeds.get(i, (0, 0))[col] for i in range(n)], dtype=float)
        v0 /= v0.sum()
        v = 0.15 * v0
        for _ in range(8):
            v = 0.85 * v @ p + 0.15 * v0
        assert np.allclose([got.get(f"h{i}", (0, 0))[k] for i in range(n)], v)


def test_distrust_reaches_as_far_as_it_counts(spark):
    hop = lambda k: f"h{k}.net" if k else "bad.com"
    rows = [(k, f"x://{hop(k)}/en/1", f'<a href="//{hop(k - 1)}/">' if k else None, "") for k in range(29)]
    rows += [(100 + i, f"x://lone{i}.net/", None, "") for i in range(2000)]  # the threshold is 0.25 / 2029
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages(spark, rows), RULES).collect()}
    assert all(abs(got[k]["distrust"] - 0.15 * 0.85**k) < 1e-6 for k in range(29))
    assert all(got[k]["verdict"] == "block" for k in range(29)) and got[100]["verdict"] == "allow"


def test_rules_as_a_table_are_those_of_the_expression(spark):
    rnd = random.Random(5)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "com.net", "é.org"], ["", "/", "/en", "/en/", "/en/7", "/de/7/x", "/En/"]
    rules = [url_filter.Rule(rnd.choice(["allow", "block"]), rnd.choice(hosts), rnd.choice(paths)) for _ in range(25)]
    urls = [None, "", "no scheme", "x://"] + [f"x://{rnd.choice(['', 'www.', 'not'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '7', '/7/x?en', '#a'])}" for _ in range(150)]
    df = pages(spark, [(i % 140, u, None, "x") for i, u in enumerate(urls)])
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    rows = lambda r: sorted(map(str, url_filter.with_rules(df, r).collect()))
    assert rows(table) == rows(rules) and sum(r["rule"] is not None for r in url_filter.with_rules(df, rules).collect()) > 30
    many = rules + [url_filter.Rule("block", f"h{i}.example", "/") for i in range(url_filter.MOST_RULES)]
    assert rows(many) == rows(rules)
    assert url_filter.with_rules(df, table.limit(0)).filter("rule IS NOT NULL").count() == 0 and url_filter.with_rules(df.limit(0), table).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_against_sql_on_graphs(spark, seed):
    """The whole operator, links between hosts included, against the registered SQL and against dense matrices."""
    from weftjoin.llm import oracles

    rng = np.random.default_rng(seed)
    n = (20, 60, 200)[seed]
    host = lambda i: f"h{i}.{('com', 'net', 'org')[i % 3]}"
    rules = queries.url_rules()
    rows = []
    for i in range(2 * n):
        own = int(rng.integers(n))
        html = "".join(f'<a class=l href="http://{host(int(j))}/x">y</a>' for j in rng.integers(0, n, rng.integers(0, 4)))
        rows.append((i, f"http://{host(own)}{rng.choice(['/en/1', '/de/2', '/es/3', '/fr/4', '/fr/5'])}", html or None, "x"))
    df = pages(spark, [*rows, (None, None, None, "x"), (7, "x://alone", "<a href=//h1.com/>", "x")])
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_pages(df, rules).select("page_id", "host", "path", "rule", "verdict").collect())))
    connection = duckdb.connect()
    connection.register("pages", df.toArrow())
    assert got == sorted(map(str, connection.execute(oracles.urls(rules)).fetchall()))
    assert "block" in str(got) and "allow" in str(got)


# --- decontamination


def test_free_front_of_a_match_is_tiled():
    item = list(range(20))
    text = [*item[5:14], 99, *item[0:8]]
    tiles = decontaminate.greedy_tiles(text, item)
    assert sorted(tiles) == [(0, 5, 9), (10, 0, 5)]


def test_texts_that_share_an_item_id(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, a), (7, b), (7, b)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], r["coverage"], r["items"]) for r in decontaminate.find_contaminated(docs, items).collect()}
    assert got == {i: (True, 1.0, [7]) for i in (1, 2, 3)}


def brute_coverage(text, item, least=5):
    """Greedy tiling by trying every pair of positions."""
    free_t, free_i, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and free_t[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        free_t[i : i + n] = free_i[j : j + n] = [False] * n
        covered += n


def test_tiles_against_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        item = [rnd.randrange(12) for _ in range(rnd.randrange(5, 40))]
        cuts = sorted(rnd.sample(range(len(item)), min(3, len(item) - 1)))
        pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        rnd.shuffle(pieces)
        text = [x for p in pieces for x in [rnd.randrange(12), *p]]
        tiles = decontaminate.greedy_tiles(text, item)
        assert sum(n for *_, n in tiles) == brute_coverage(text, item)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == len({x for _, j, n in tiles for x in range(j, j + n)}) == sum(n for *_, n in tiles)


def test_tiles_of_short_vocabularies_against_brute_force():
    text = [15, 5, 27, 25, 23, 17, 22, 15, 4, 9, 6, 28, 22, 5, 15, 5, 27, 25, 23, 17, 22, 15, 2]
    item = [5, 12, 28, 3, 4, 9, 6, 28, 22, 5, 27, 25, 23, 17, 22, 15]
    assert sum(n for *_, n in decontaminate.greedy_tiles(text, item)) == brute_coverage(text, item) == 12
    rnd = random.Random(1)
    for _ in range(3000):
        v = rnd.randrange(1, 31)
        item, text = [rnd.randrange(v) for _ in range(rnd.randrange(5, 24))], []
        for _ in range(rnd.randrange(1, 4)):
            a = rnd.randrange(len(item))
            text += item[a : a + rnd.randrange(3, 16)] + [rnd.randrange(v) for _ in range(rnd.randrange(4))]
        assert sum(n for *_, n in decontaminate.greedy_tiles(text, item)) == brute_coverage(text, item), (text, item)


def test_tiles_of_repeated_words_stay_few():
    assert decontaminate.greedy_tiles([1] * 20_000, [1] * 300 + [2] * 300) == [(0, 0, 300)]


def test_seeds_are_flat_and_small():
    rnd = random.Random(2)
    items = [(i, " ".join(f"w{rnd.randrange(50_000)}" for _ in range(400))) for i in range(200)]
    seeds = decontaminate.Seeds(items, 5)
    size = sum(x.nbytes for x in (seeds.words, seeds.starts, seeds.known, seeds.first, seeds.owner))
    assert size <= 4.5 * sum(len(t) for _, t in items)
    of_all = decontaminate.SeedFilter(80_000)
    of_all.add(seeds)
    assert all(of_all.hits(t, 5) for _, t in items) and not of_all.hits(None, 5) and not of_all.hits("a b c d", 5)
    assert sum(of_all.hits(" ".join(f"x{rnd.randrange(10**9)}" for _ in range(9)), 5) for _ in range(100)) < 60


def test_contaminated_rows_without_doc_id_and_clashing_columns(spark):
    item = "the quick brown fox jumps over the lazy dog"
    rows = [(None, item, "a"), (None, "nothing of the kind is said here", "b"), (None, None, "c"), (1, item, "d"), (1, item, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, contaminated string")
    bench = spark.createDataFrame([(i, f"{item} {'x' * i}") for i in range(6)], "item_id bigint, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.find_contaminated(docs, bench, block_bytes=block_bytes).collect()
        assert Counter((r["doc_id"], r["contaminated"]) for r in got) == {(None, True): 1, (None, False): 2, (1, True): 2}
        assert sorted(r["contaminated"] for r in decontaminate.remove_contaminated(docs, bench, block_bytes=block_bytes).collect()) == ["b", "c"]


def test_contaminated_documents(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong tea beside an old river"
    w = item.split()
    moved = " ".join(w[12:] + ["filler"] + w[:12]).upper().replace(" ", ", ")
    texts = [None, "", "nothing of it here at all today", item, f"before {moved} after", " ".join(w[:7]), f"{'pad ' * 20_000}{item}", f"{item} {item}"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, item, "x"), (3, "clean words only in this one", "x")], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, "too short"), (10, None), (11, "unrelated words that nothing else ever holds anywhere")], "item_id bigint, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 120):
        got = decontaminate.find_contaminated(docs, bench, block_bytes=block_bytes).collect()
        assert Counter((r["doc_id"], r["contaminated"]) for r in got) == {(0, False): 1, (1, False): 1, (2, False): 1, (3, True): 2, (3, False): 1, (4, True): 1, (5, False): 1, (6, True): 1, (7, True): 1}
        assert all(r["item_id"] == 7 and list(r["items"]) == [7, 8] for r in got if r["contaminated"])
        kept = decontaminate.remove_contaminated(docs, bench, block_bytes=block_bytes)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5]
    assert decontaminate.find_contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_contaminated(docs.limit(0), bench).collect() == []


def test_a_training_step_follows_the_gradient():
    """One plain step on one text: every touched row moves against the numeric gradient of the loss, all others stay."""
    s = subword.Settings(buckets_log2=8, dim=4, epochs=1, rate=0.4)
    texts, labels = [b"good words here", b"bad stuff"], [1, 0]
    start = np.random.default_rng(s.seed).uniform(-1 / s.dim, 1 / s.dim, (1 << s.buckets_log2, s.dim)).astype(np.float32)
    order = np.random.default_rng(s.seed)
    order.uniform(size=start.shape)
    first = int(order.permutation(2)[0])
    one = subword.train(texts, labels, subword.Settings(**{**s.__dict__, "epochs": 1}))
    weights = np.zeros((2, s.dim))
    weights[0, ::2] = weights[1, 1::2] = 1
    own, share = np.unique(subword.features(texts[first], s)[0], return_counts=True)
    share = share / share.sum()

    def loss(emb):
        z = float(share @ emb[own] @ (weights[1] - weights[0]))
        return float(np.log1p(np.exp(-z if labels[first] else z)))

    other = set(subword.features(texts[1 - first], s)[0].tolist())
    alone = [k for k, b in enumerate(own) if b not in other]
    gradient = np.zeros((len(own), s.dim))
    for k in alone:
        for d in range(s.dim):
            up, down = start.astype(float), start.astype(float)
            up[own[k], d] += 1e-4
            down[own[k], d] -= 1e-4
            gradient[k, d] = (loss(up) - loss(down)) / 2e-4
    moved = (one.embeddings - start)[own]
    for k in alone:
        cosine = moved[k] @ gradient[k] / (np.linalg.norm(moved[k]) * np.linalg.norm(gradient[k]))
        assert cosine < -0.999
    touched = set(own.tolist()) | other
    still = [i for i in range(1 << s.buckets_log2) if i not in touched]
    assert (one.embeddings[still] == start[still]).all() and (subword.train(texts, labels, s).embeddings == one.embeddings).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_cases(spark, module):
    """Null and empty texts, a very long one, null doc_id, repeated rows, clashing names, empty tables."""
    schema = "doc_id bigint, text string, score string, held_out string"
    rows = [(None, "fine words", "", ""), (1, None, "", ""), (2, "", "", ""), (3, "word " * 60_000, "", ""), (4, "same", "", ""), (4, "same", "", "")] + [(10 + i, f"{'good' if i % 2 else 'vile'} text {i}", "", "") for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(10 + i, i % 2, 1 - i % 2) for i in range(40)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    score = module.score_quality if module is quality else module.score_toxicity
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert score(docs.limit(0), labels).collect() == [] and len({r["score"] for r in score(docs, labels.limit(0)).collect()}) == 1


# --- shared folders


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from weftjoin.llm import support

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named or d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None))

    with pytest.raises(ValueError):
        support.shared_dir(session("yarn"))
    assert support.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"


def test_scratch_tables_are_deleted(spark):
    from weftjoin.llm import support

    df = support.stored(spark.range(5))
    path = support._scratch[-1]
    assert df.count() == 5 and os.path.isdir(path)
    kept = support._scratch[:-1]
    support._scratch[:] = [path]
    support._delete_scratch(spark)
    support._scratch[:] = kept
    assert not os.path.exists(path)


# --- registry and pipeline


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query_covers_its_table(spark, name):
    rows = queries.queries()[name](spark, SMALL)
    table = {"op1": "pages", "op7": "conversations", "op10": "embeddings"}.get(name.split("_")[0], "documents")
    key = {"pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}.get(table, "doc_id")
    want = {r[0] for r in duckdb.sql(f"SELECT DISTINCT {key} FROM '{SMALL}/{table}.parquet'").fetchall()} | ({-1} if table == "conversations" else set())
    assert {r[key] for r in rows.select(key).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    item = bench.first()["text"]
    extra = spark.createDataFrame([(10**6, f"{docs.first()['text']} {item}", "en", "s", 1), (10**6 + 1, docs.first()["text"], "en", "s", 1)], docs.schema)
    near = corpus_pipeline.near_duplicates(spark, docs.unionByName(extra), SMALL)
    ids = {r["doc_id"] for r in near.collect()}
    assert near.columns == docs.columns and 10**6 + 1 not in ids and docs.first()["doc_id"] in ids
    clean = corpus_pipeline.decontamination(spark, docs.unionByName(extra), SMALL)
    assert 10**6 not in {r["doc_id"] for r in clean.collect()}
    hidden = corpus_pipeline.secrets(spark, docs, SMALL)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    assert not [r for r in hidden.collect() if re.search(r"token = .[0-9a-f]{40}", r["text"] or "")]
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def jaccard_classes(texts):
    """Smallest index of the component of each text by brute force; -1 without words."""
    lower = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in lower]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) if sets[i] else -1 for i in range(len(texts))]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    """Every stage on what its predecessor kept, with nulls, copies, clashing names and a benchmark passage added to the table."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from weftjoin.llm import secret_scan
    from weftjoin.llm.queries import tokenizer_path

    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    first = base.filter("text IS NOT NULL").orderBy("doc_id").limit(3).collect()
    extra = [(10**6, first[0]["text"]), (10**6 + 1, f"{first[1]['text']} {bench[0]['text']}"), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, first[2]["text"]), (10**6 + 5, f"{first[2]['text']} password = hunter22hunter")]
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], base.schema))
    for name in ("hash", "row", "spans", "_id", "_hash", "sid", "clean", "changed", "size"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.cache()
    model = quality.fit(docs, labels)
    table = model.logits()
    good = {r["doc_id"] for r in docs.collect() if subword.score((r["text"] or "").encode(), table, model.bias, model.settings) >= quality.THRESHOLD}
    kept = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(good)

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None) + [(10**6 + 2, None)]
    classes = jaccard_classes([t for _, t in rows])
    want = {i for k, (i, _) in enumerate(rows) if classes[k] in (k, -1)}
    near = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == want and near.count() == len(want) < len(rows)

    items = [w for w in (decontaminate.words(r["text"]).tolist() for r in bench) if len(w) >= decontaminate.LEAST]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def covered(text):
        w = decontaminate.words(text).tolist()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(own & r and brute_coverage(w, i) / len(i) >= decontaminate.THRESHOLD for r, i in zip(runs, items, strict=True))

    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, t in rows if not covered(t)}

    spans = {(r["doc_id"]): [s.split(":") for s in r["spans"].split(",") if s] for r in secret_scan.secret_digest(docs).collect()}
    hidden = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, SMALL).collect()}
    for i, t in rows:
        out, at = "", 0
        for _, a, b in spans[i]:
            if int(a) >= at:
                out += t[at : int(a)] + "[REDACTED]"
            at = max(at, int(b))
        assert hidden[i]["text"] == (None if t is None else out + t[at:]) and hidden[i]["_hash"] == "_hash"

    library, pieces = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for r in corpus_pipeline.packed(spark, docs, SMALL).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
