"""Prefix trie, whitening and quality scores against brute force and held-out labels."""

import hashlib
import random
import time
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.llm import html_main, mixing, prefixes, scoring, whitening
from groundloom.llm.common import load

TURNS = "conv_id bigint, turn bigint, role string, text string, id bigint, pos int, unit string, part int"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows, shared=True):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    convs = {c: [z[3] for z in sorted(v, key=lambda z: z[:3])] for c, v in convs.items()}
    whole = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = convs.get(base, [])[:h] + v[h:]
    nodes, children = {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(whole[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    long_start = [("user", f"line {k} é漢") for k in range(40)]
    for c in range(60):
        kind = c % 5
        turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ccc"])) for _ in range(r.randint(1, 7))]
        if kind == 1:  # copies
            turns = [("user", "same"), ("assistant", "copy"), ("user", None)]
        if kind == 2:  # a long shared start, then a fork or an end
            turns = long_start[: 40 - c % 3] + turns[: c % 2]
        rows += [(c * 37 - 300, t if t else None, a, b) for t, (a, b) in enumerate(turns)]
    rows += [(None, 1, "user", "no conversation"), (-900, 3, "user", "tie"), (-900, 3, "user", "tie 2"), (-900, None, None, None)]
    r.shuffle(rows)
    return [(*x, 1, 2, "u", 3) for x in rows]


@pytest.mark.parametrize(("local", "shared"), [(12, False), (40, True), (1 << 18, True)])
def test_trie_equals_brute_force(spark, local, shared):
    rows = conversations()
    got = prefixes.conversation_trie(spark.createDataFrame(rows, TURNS), local, shared).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie(rows, shared)


def test_trie_of_small_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefixes.conversation_trie(empty).collect() == []
    one = [(7, 1, "user", "only", 1, 2, "u", 3)]
    got = prefixes.conversation_trie(spark.createDataFrame(one, TURNS)).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie(one)
    turnless = [(c, 1, "user", "x", 1, 2, "u", 3) for c in range(101, 140)]
    got = prefixes.conversation_trie(spark.createDataFrame(turnless, TURNS)).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie(turnless)


def test_running_counts_across_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id % 50) as k", "id % 100 as o", "id as v").repartition(7)
    got = prefixes.running(rows, "k", [F.col("o")], "v").toPandas().sort_values(["k", "at"])
    for _, group in got.groupby("k"):
        assert group["at"].tolist() == list(range(len(group)))
        assert group["o"].is_monotonic_increasing
        assert (group["before"] == group["v"].cumsum() - group["v"]).all()


def test_the_query_over_its_table(spark):
    df = load(spark, "/root/testdata/sf0.01", "conversations")
    got = prefixes.conversation_trie(df).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_symmetric_qr():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        a = r.standard_normal((n, n + 3))
        a = a @ a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(values[0], 1))
    assert whitening.symmetric_qr(np.diag([1.0, 3.0, 2.0]))[0].tolist() == [3, 2, 1]
    assert whitening.symmetric_qr(np.zeros((4, 4)))[0].tolist() == [0] * 4


def brute_whitening(vectors, components=16):
    x = np.floor(64 * np.array(vectors, dtype="float64")).astype("int64") + 1_000_000
    each = np.unique(x, axis=0)
    n, sums = len(each), each.sum(0)
    apart = n * each - sums
    v = (apart / n).T @ (apart / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    apart = n * x - sums
    return n, (apart**2).sum(1), (apart / n) @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(2)
    good = (r.standard_normal((300, 8)) * np.arange(1, 9) + 5).astype("float32").tolist()
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(None, good[0], 1, "x"), (5, good[5], 1, "x")] * 20
    bad = [(900, None, 1, "x"), (901, [1.0, None] + [0.0] * 6, 1, "x"), (902, [float("nan")] * 8, 1, "x"), (903, [float("inf")] * 8, 1, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, n int, x string").repartition(9)
    out = whitening.digest(whitening.whiten(df, components=5)).toPandas()
    assert len(out) == 5 * len(rows) and not out["vec_id"].isin([900, 901, 902, 903]).any()
    n, deviation, whitened, explained = brute_whitening(good, 5)
    assert set(out["n"]) == {n} and (out["identity_error"] < 1e-9).all()
    for k in range(5):
        part = out[(out["component"] == k + 1) & out["vec_id"].notna()].drop_duplicates("vec_id").sort_values("vec_id")
        assert part["deviation"].tolist() == deviation.tolist()
        assert np.allclose(np.abs(part["whitened"]), np.abs(whitened[:, k]), atol=1e-9)
        assert np.allclose(part["explained"], explained[k], rtol=1e-9)
    assert out.groupby(out["vec_id"].fillna(-1))["whitened"].count().loc[-1] == 100


def test_whitening_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert whiten([]) == [] and whiten([(1, None)]) == [] and whiten([(1, []), (2, [])]) == []
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    flat = whiten([(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [])])  # one live dimension; a short vector is filled up
    assert [(r.vec_id, r.component) for r in sorted(flat)] == [(1, 1), (2, 1), (3, 1)]
    huge = whiten([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 5.0])])
    assert len(huge) == 3 and all(isinstance(r.deviation, Decimal) for r in huge)


def test_pooled_is_isotonic():
    r = np.random.default_rng(4)
    n = r.integers(1, 9, 60).astype(float)
    total = np.minimum(n, np.round(n * np.clip(np.linspace(0, 1, 60) + r.normal(0, 0.3, 60), 0, 1)))
    edges, levels = scoring.pooled(np.arange(60.0), total, n)
    assert (np.diff(levels) >= 0).all() and (np.diff(edges) >= 0).all()
    # The greatest least bound of means (min-max formula) at each point.
    mean = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    for i in range(60):
        best = max(min(mean(a, b) for b in range(i, 60)) for a in range(i + 1))
        assert np.isclose(np.interp(i, edges, levels), best)


def test_features_approximate_a_gaussian_kernel():
    model = scoring.Quality(np.zeros(5), np.ones(5), 8192, 1, 2.0)
    x = np.random.default_rng(0).uniform(-2, 2, (20, 5))
    z = model.mapped(x)[:, :-1]
    wanted = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - wanted).max() < 0.06


def test_scores_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = scoring.score(load(spark, d, "documents"), load(spark, d, "labels"))
    both = out.join(load(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert out.count() == 10000 and len(both) > 500
    assert (both["predicted"] == both["quality"]).mean() > 0.97
    good, bad = both[both["quality"] == 1], both[both["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.98 and (bad["predicted"] == 0).mean() > 0.95
    ids = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(10000)}
    assert all(ids[r.doc_id] == r.held_out for r in out.select("doc_id", "held_out").collect())


def test_scores_of_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string, x int, fold int, score double"
    rows = [(None, "no id at all", "en", 1, 2, 0.5), (1, None, "en", 1, 2, 0.5), (2, "", "en", 1, 2, 0.5), (3, "퟿ word " * 3000, "en", 1, 2, 0.5)]
    rows += [(k, "Plain words stand here, in lines." if k % 2 else "##%% $$$ @@@ ## " * 3, "en", 1, 2, 0.5) for k in range(10, 90)] * 2
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 90)] + [(None, 1, 0), (11, None, 0), (11, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = scoring.score(docs, labels).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    known = out[out["doc_id"] >= 10]
    assert (known["predicted"] == known["doc_id"] % 2).all()
    assert out[out["doc_id"].isna()]["held_out"].tolist() == [False]
    none = scoring.score(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and scoring.score(docs.limit(0), labels).count() == 0
    one_class = scoring.score(docs, labels.where("quality = 1")).toPandas()
    assert (one_class["predicted"] == 1).all()
    # Labels of held-out rows change nothing.
    held = [k for k in range(10, 90) if zlib.crc32(str(k).encode()) % 5 == 0]
    again = scoring.score(docs, labels.where(~labels["doc_id"].isin(held))).toPandas()
    assert np.allclose(again["score"].sort_values(), out["score"].sort_values())


def test_rows_alike_of_several_sources_are_taken_as_mixed(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "same words in each of them", k, s, 0) for s, n in (("a", 200), ("b", 150), (None, 50)) for k in (["x"] * (n // 2) + ["y"] * (n - n // 2))]
    rows += [(i, " ".join(["w"] * (3 + i % 9)), "z", "abc"[i % 3], 0) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, kind).repartition(5)
    got = mixing.mix(docs, chunk=40, fan_in=4).toPandas()
    taken = mixing.take(docs, chunk=40, fan_in=4).toPandas()
    words = taken.assign(n=taken["text"].str.split().str.len(), source=taken["source"].fillna("-")).groupby("source")["n"].sum()
    goal = mixing.targets(docs.selectExpr("source", "cast(size(split(text, ' ')) as bigint) as size")).toPandas().assign(source=lambda f: f["source"].fillna("-")).set_index("source")["target"]
    assert len(taken) == got["copies"].sum() and set(words.index) == set(goal.index)
    assert ((words - goal).abs() <= 12).all()


@pytest.mark.parametrize("broken", ["<a ", "<a href=\"", "<", "</b ", "<p class='x", "<!", "a<b "])
def test_broken_markup_takes_time_in_proportion(broken):
    n = 100_000
    began = time.perf_counter()
    lines = html_main.lines_of("<article><p>Some text here.</p></article>" + broken * n)
    assert time.perf_counter() - began < 10 and lines[0] == ("Some text here.", 2)
    assert html_main.lines_of("<p>1 &lt; 2 <b") == [("1 < 2 <b", 1)]


def test_articles_lose_template_lines_and_keep_quotations(spark):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    quotes = [words(20) for _ in range(6)]
    top, bottom = "Our shop sends every order within two days.", "Written by the team of this site, all rights kept."
    rows, expected, planted = [], {}, 0
    for i in range(120):
        body = [words(25) for _ in range(r.randint(3, 9))]
        for q in r.sample(quotes, 2):
            body.insert(r.randint(0, len(body)), q)
        lines = [top, *body, bottom]
        planted += 2
        page = "<html><body><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"
        rows.append((i, f"https://host.example/a/{i:04d}", page))
        expected[i] = body
    got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    lost_true = sum(len(set(expected[g.page_id]) - set(g.text.split("\n\n"))) for g in got)
    left = sum((top in g.text) + (bottom in g.text) for g in got)
    assert lost_true == 0 and left <= 0.1 * planted


def test_given_pages_keep_every_line_of_their_articles(spark):
    pages = load(spark, "/root/testdata/sf0.1", "pages")
    got = {g.page_id: g.text for g in html_main.extract_main(pages).collect()}
    for p in pages.collect():
        assert got[p.page_id] == html_main.main_text(html_main.lines_of(p.html), set())
