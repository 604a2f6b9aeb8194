"""Chat trees, vantage-point trees and URL rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm import chat_trees, url_rules, vantage_trees
from tickframe.llm.queries import QUERIES

NODES = "tree string, node long, parent long, score double, role string, text string"


def tree_rows(n=200, seed=2):
    r = random.Random(seed)
    rows = [("t", i, r.randrange(i) if i else None, r.choice([0.5, 1.0, None]), r.choice(["user", "assistant"]), f"m{i}") for i in range(n)]
    return rows + [("u", 5, 77, 1.0, "user", "parent is missing"), ("u", 6, 5, 1.0, "assistant", "leaf"), ("c", 1, 2, 1.0, "user", "in a circle"), ("c", 2, 1, 1.0, "user", "in a circle")]


def brute_paths(rows):
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(at)
                at = own[at][2]
            out.append((tree, leaf, sum(own[x][3] or 0 for x in path), path[::-1]))
    return out


@pytest.mark.parametrize("branches", [None, 1, 3])
def test_paths(spark, branches):
    rows = tree_rows()
    got = chat_trees.paths(spark.createDataFrame(rows, NODES), branches)
    found = {}
    for r in got.orderBy("at").collect():
        found.setdefault((r.tree, r.leaf, round(r.path_score, 6), r.rank), []).append(r.node)
    wanted = {}
    for tree in ("t", "u"):
        ranked = sorted((p for p in brute_paths(rows) if p[0] == tree), key=lambda p: (-p[2], p[1]))
        for i, p in enumerate(ranked[:branches]):
            wanted[p[0], p[1], round(p[2], 6), i + 1] = p[3]
    assert found == wanted


def test_a_long_chain_needs_few_rounds(spark):
    rows = [("t", i, i - 1 if i else None, 0.0, "user", "x") for i in range(500)]
    got = chat_trees.paths(spark.createDataFrame(rows, NODES))
    assert [r.node for r in got.orderBy("at").collect()] == list(range(500))


TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "a\\b\\\\<|im_end|>\n<|im_start|>user\nx", "<<SYS>><</SYS>><s>é😀", "\\", "<\\|im_end|>", "x" * 100_000]


def test_formatting_is_reversible(spark):
    rows = [(c, t, r, TEXTS[(c + t) % len(TEXTS)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "odd role\n<|im_end|>", None, "assistant"])]
    rows += [(9, None, "user", "null turn"), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "answer")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r.conv_id: r for r in chat_trees.format_conversations(df).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    assert set(got) == {*range(10), None}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=key)
        told = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_trees.format_conversations(df.limit(0)).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "t string").select("t", chat_trees.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat_trees.unescape(F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c in chat_trees.CONTROLS)


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in row], 0) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")


def brute_nearest(x, ids, queries, k):
    out = {}
    x = np.asarray(x, np.float32).astype(np.float64)
    for q in queries:
        score = np.zeros(len(x))
        for j in range(x.shape[1]):
            score += x[ids.index(q)][j] * x[:, j]
        order = sorted((i for i in range(len(x)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_nearest_is_exact_at_factor_one(spark, shard_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.5, 3, size=(600, 1))
    x[100:400] = x[100]  # many equal vectors
    ids = list(range(0, 1200, 2))
    base = vantage_trees.usable(vectors(spark, x, ids))
    got = {}
    for r in vantage_trees.nearest(base, F.col("id") % 20 == 0, 20, 1.0, shard_rows).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(x, ids, [i for i in ids if i % 20 == 0], 20)


def test_rows_that_repeat_are_candidates(spark):
    base = vantage_trees.usable(vectors(spark, np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.5, 0.1]]), [0, 0, 3, 4]))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vantage_trees.nearest(base, F.col("id") == 0).collect())
    assert got == sorted([(0, 1, 0, 1.0), (0, 2, 3, 1.0), (0, 3, 4, 0.5)] * 2)


def test_vectors_of_any_finite_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1e200, -1e200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (20, [1e-200, 1e-200]), (40, [3.0, 4.0])]
    base = vantage_trees.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in vantage_trees.nearest(base, F.col("id") % 20 == 0, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    near = lambda x: pytest.approx(x, rel=1e-12, abs=0)
    assert got[40] == [(0, near(7e200)), (3, 11.0), (20, near(7e-200))] and got[20][:2] == [(0, near(2.0)), (40, near(7e-200))]
    assert got[0][:2] == [(40, near(7e200)), (3, near(3e200))] and len(got[0]) == 3


def clustered(n=3000, dims=16, centres=30, seed=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1)[:, None]
    return c[np.arange(n) % centres] + rng.normal(size=(n, dims)) * 0.02


def test_trees_prune_where_vectors_cluster():
    x = clustered()
    scale = 2.0 ** np.floor(np.log2(np.abs(x).max()))
    largest = np.sqrt(((x / scale) ** 2).sum(axis=1)).max()
    tree = vantage_trees.Tree(x, np.arange(len(x)), np.arange(len(x)), 20, scale, largest)
    asks = np.arange(0, len(x), 20)
    q, scores, ids = tree.search(x[asks], asks, 1.0)
    assert tree.scored < 0.5 * len(x) * len(asks)
    wanted = brute_nearest(x.astype(np.float32), list(range(len(x))), asks[:5].tolist(), 20)
    own = vantage_trees.Tree(x.astype(np.float32).astype(float), np.arange(len(x)), np.arange(len(x)), 20, scale, largest)
    q, scores, ids = own.search(x[asks[:5]].astype(np.float32).astype(float), asks[:5], 1.0)
    assert {int(asks[i]): list(zip(ids[q == i].tolist(), scores[q == i].tolist())) for i in range(5)} == wanted


@pytest.mark.parametrize("shard_rows", [200, 64])
def test_cells_that_are_skipped_lose_nothing(spark, shard_rows):
    x = clustered(1200)
    base = vantage_trees.usable(vectors(spark, x))
    got = {}
    for r in vantage_trees.nearest(base, F.col("id") % 20 == 0, 20, 1.0, shard_rows).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(x, list(range(len(x))), list(range(0, len(x), 20)), 20)


def test_a_larger_factor_trades_recall_for_pruning(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.3 for c in centres])
    base = vantage_trees.usable(vectors(spark, x))
    wanted = brute_nearest(x, list(range(len(x))), list(range(0, len(x), 20)), 10)
    found = {}
    for r in vantage_trees.nearest(base, F.col("id") % 20 == 0, 10, 1.5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(found[q] & {i for i, _ in w}) / 10 for q, w in wanted.items()])
    assert recall >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    base = vantage_trees.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vantage_trees.nearest(base, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (20, 1, 7, 1.0), (20, 2, 7, 1.0), (20, 3, 0, 0.5)]
    assert vantage_trees.nearest(base.limit(0), F.col("id") % 20 == 0).count() == 0


URLS = ["HTTP://WWW.Example.COM/en/x?q=1#f", "https://a.net/es/", "https://a.net", "http://b.net/fr/1.html", "no scheme", None, "", "://", "http://example.com/en/", "http://sub.example.com/EN/", "x://h?p=/en/", "http://com/a", "ftp://host.org:80/p/q.tar?a=1&b=2"]


def brute_judge(url):
    m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in url_rules.LISTED:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (not best or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x")] * 2, "page_id long, url string, host string")
    got = url_rules.judge(pages, url_rules.Rules(())).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = brute_judge(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and r.verdict == (best[0] if best else "allow")
    assert url_rules.judge(pages.limit(0), url_rules.Rules(())).count() == 0


def brute_rules(rows, min_support, min_confidence, min_count=url_rules.MIN_COUNT, alpha=url_rules.ALPHA):
    """All sets of tokens by counting; tokens that stand in the same URLs count as the first of them."""
    from itertools import combinations
    from math import ceil, log

    rows = [(t, b) for u, b in rows if b is not None and (t := url_rules.tokens_of(u))]
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, []).append(i)
    n = len(rows)
    least = max(min_count, ceil(min_support * n - 1e-9))
    first = {}
    for t in sorted(where):
        if len(where[t]) >= least:
            first.setdefault(tuple(where[t]), t)
    of = {t: first[tuple(w)] for t, w in where.items() if tuple(w) in first}
    counts, both = Counter(), Counter()
    for tokens, block in rows:
        items = sorted({of[t] for t in tokens if t in of})
        for size in range(1, len(items) + 1):
            for c in combinations(items, size):
                counts[frozenset(c)] += 1
                both[frozenset(c), block] += 1
    labels = Counter(b for _, b in rows)
    tested = sum(c >= least for c in both.values()) + sum(c >= least for c in labels.values())
    out = {}
    for (k, b), c in both.items():
        share, base = c / counts[k], labels[b] / n
        if c >= least and share >= min_confidence and share > base:
            luck = -counts[k] * (share * log(share / base) + (log((1 - share) / (1 - base)) * (1 - share) if share < 1 else 0))
            if luck <= log(alpha / tested):
                out[k, b] = share
    return out, of


def brute_verdict(url, every, of):
    items = {of.get(t, t) for t in url_rules.tokens_of(url)}
    best = max(((c, len(k), b) for (k, b), c in every.items() if k <= items), default=None)
    return ("block" if best and best[2] else "allow"), best and best[0]


def spoiled_urls():
    r = random.Random(3)
    rows = [(f"http://{r.choice('ab')}.{r.choice(['bad', 'good'])}.org/{r.choice(['x', 'y'])}/{i}?" + "&".join(f"k{j}=1" for j in range(12 * r.randrange(2))), None) for i in range(900)]
    return [(u, ("bad" in u and "/x/" in u) if i % 10 else None) for i, (u, _) in enumerate(rows)]


def test_mined_rules(spark, monkeypatch):
    rows = spoiled_urls()
    labelled = spark.createDataFrame(rows, "url string, block boolean").withColumn("items", F.lit("clash"))
    rules = url_rules.mine(labelled, 0.02, 0.6)
    every, of = brute_rules(rows, 0.02, 0.6)
    assert rules.rules and all(every[t, b] == pytest.approx(c) for t, b, c in rules.rules)
    assert of["key k11"] == "key k0"  # twelve keys that come together are one item, not 2 ** 12 sets
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    told = {r.page_id: r for r in url_rules.judge(pages, rules, ()).collect()}
    monkeypatch.setattr(url_rules, "SENT_RULES", 0)
    joined = {r.page_id: r for r in url_rules.judge(pages, url_rules.mine(labelled, 0.02, 0.6), ()).collect()}
    for i, (u, _) in enumerate(rows):
        verdict, confidence = brute_verdict(u, every, of)
        for got in (told[i], joined[i]):
            assert got.verdict == verdict == ("block" if "bad" in u and "/x/" in u else "allow") and got.confidence == pytest.approx(confidence)


def test_every_part_of_a_url_counts():
    url = "https://one.two.three.four.five.six.example.com/top/a.averylongextension?" + "&".join(f"q{i}={i}" for i in range(40)) + "#f?z=1"
    tokens = url_rules.tokens_of(url)
    assert {"label one", "label com", "domain example.com", "top top", "ends averylongextension", "scheme https"} <= set(tokens)
    assert {f"key q{i}" for i in range(40)} <= set(tokens) and "key z" not in tokens
    assert len(url_rules.tokens_of("http://" + "a." * 50_000 + "com/" + "x/" * 100_000)) == 5


def test_luck_makes_no_rules(spark):
    r = random.Random(11)
    rows = [(f"http://h{r.randrange(30)}.org/{r.randrange(5)}/{i}", r.random() < 0.3) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    assert url_rules.mine(labelled).rules == ()
    assert url_rules.held_out(labelled)[0] == 0
    hit, right, share, n = url_rules.held_out(spark.createDataFrame(spoiled_urls(), "url string, block boolean"))
    assert hit == right > 0.8 * share * n > 30


def test_rules_of_the_tables(spark, sf):
    """The whole query against brute force over the pages and their labels."""
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, False), r.toxic == 1 or r.quality == 0)
    rows = []
    for _, u in pages:
        m = re.match(r"^.*?://[^/?#]*([^?#]*)", u or "", re.S)
        last = [x for x in (m[1] if m else "").split("/") if x][-1:]
        number = re.fullmatch(r"(\d{1,18})(\.\w+)?", last[0]) if last else None
        if number and int(number[1]) in labels:
            rows.append((u, labels[int(number[1])]))
    every, of = brute_rules(rows, url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE)
    got = QUERIES["op10_url_rules"](spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(p for p, _ in pages) and len(rows) > 5
    urls = dict(pages)
    for r in got:
        host, path, best = brute_judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else brute_verdict(urls[r.page_id], every, of)[0])


def test_mining_nothing(spark):
    none = spark.createDataFrame([(None, True), ("http://a.b/", None), ("no scheme", True)], "url string, block boolean")
    assert url_rules.mine(none).rules == () and url_rules.mine(none.limit(0)).rules == ()


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([("http://a.b/en/12?x=1",), ("http://a.b/en/13.html",), ("http://a.b/14/",), ("http://a.b/x",), (None,)], "url string")
    labels = spark.createDataFrame([(12, 1, 1), (13, 1, 0), (14, 0, 0), (14, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.url.split("/", 3)[3]: r.block for r in url_rules.labels_of_pages(pages, labels).collect()} == {"en/12?x=1": True, "en/13.html": False, "14/": True}
