import random
import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundloom.llm import bpe, components, html_main, images, mixing, pii, quality, repeats, secrets, shingles, simhash, urls

from .texts import SCHEMA, WORD, awkward, brute_personal, brute_print, brute_quality, brute_repeats, brute_secrets, same_rows, sha

ROWS = awkward()
TEXTS = [r[1] or "" for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def joined(spans, names):
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.digest(repeats.drop_repeats(none)).count() == 0
    assert secrets.digest(secrets.scan_secrets(none)).count() == 0
    assert pii.digest(pii.find_personal(none)).count() == 0
    assert quality.judge_quality(none).count() == quality.keep_good(none).count() == 0
    assert simhash.digest(simhash.near_copies(none)).count() == simhash.one_of_each(none).count() == 0
    assert mixing.mix(none).count() == mixing.take(none).count() == 0
    assert bpe.digest(bpe.round_trip(none)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_main.extract_main(pages).count() == urls.filter_urls(pages).count() == 0
    assert images.image_copies(spark.createDataFrame([], "image_id bigint, height int, width int, pixels binary")).count() == 0


@pytest.mark.parametrize("least, gram, group", [(400, 100, 20_000), (40, 10, 20_000), (40, 10, 1)])
def test_repeats(docs, least, gram, group):
    got = repeats.digest(repeats.drop_repeats(docs, least, gram, group)).drop("n_passages")
    same_rows(got, [(r[0], *b) for r, b in zip(ROWS, brute_repeats(TEXTS, least), strict=True)])


@pytest.mark.parametrize("group", [20_000, 3])
def test_passages_are_reported_and_stay(spark, group):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short, line = text(51), text(50), text(12)
    assert repeats.PASSAGE <= len(passage) < 400
    rows = [(i, f"{text(80)}. {(passage, short, line, text(60))[i % 4]} .{text(80)}") for i in range(24)]
    rows += [(100, passage), (101, "x" + passage[1:]), (102, None)]
    got = {r.doc_id: r for r in repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group=group).collect()}
    for i, t in rows:
        assert got[i].spans == [] and got[i].kept == (t or "").encode()
        assert got[i].n_passages == (i == 100 or i < 24 and i % 4 == 0)


def test_reaches_agree_with_pairs():
    for seed in range(30):
        draw = random.Random(seed)
        n = draw.choice([2, 3, 9, 40])
        sides = [("".join(draw.choice("ab") for _ in range(draw.randint(0, 9))), "g" * 3 + "".join(draw.choice("ab") for _ in range(draw.randint(0, 7)))) for _ in range(n)]
        sides.sort(key=lambda x: x[1])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        left, n_left = repeats._matrix([a.encode() for a, _ in sides], 9)
        right, n_right = repeats._matrix([b.encode() for _, b in sides], 10)
        got = repeats.scan_group(left, n_left, right, n_right, (8, 5), 3)
        for limit, (to_left, to_right) in zip((8, 5), got, strict=True):
            for i, (a, b) in enumerate(sides):
                met = [(common(a, c), common(b, d)) for j, (c, d) in enumerate(sides) if j != i]
                # What is covered to the left and right is what pairs cover; only the longest of each side counts.
                good = [(x, y) for x, y in met if x + y >= limit]
                assert to_left[i] == max((x for x, _ in good), default=0)
                assert to_right[i] == max((y for _, y in good), default=0)


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeat_groups_have_all_occurrences(docs, group):
    got: dict = {}
    raw = [(r[0], t.encode()) for r, t in zip(ROWS, TEXTS, strict=True)]
    by_id = dict(raw)
    for r in repeats.repeat_groups(docs.where("length(text) < 2500"), 40, 10, group).collect():
        got.setdefault(r.group, set()).add((r.doc_id, r.begin, r.stop))
    assert got
    for places_ in got.values():
        strings = {by_id[d][a:b] for d, a, b in places_}
        assert len(strings) == 1
        s = strings.pop()
        places = {(d, m.start(), m.start() + len(s)) for d, t in raw if len(t.decode()) < 2500 for m in re.finditer(b"(?=" + re.escape(s) + b")", t)}
        assert len(s) >= 40 and places_ == places
    covered: dict = {}
    for places_ in got.values():
        for d, a, b in places_:
            covered.setdefault(d, set()).update(range(a, b))
    expected = {r.doc_id: r.n_removed for r in repeats.digest(repeats.drop_repeats(docs.where("length(text) < 2500"), 40, 10)).collect()}
    assert {d: len(c) for d, c in covered.items()} == {d: n for d, n in expected.items() if n}


def test_intervals_are_those_of_sorted_strings():
    rows = sorted("".join(random.Random(i).choice("ab") for _ in range(8)) for i in range(40))
    lcp = [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(rows, rows[1:], strict=False)]
    got = {(p, rows[i][:p], j - i + 1) for p, i, j in repeats.intervals(lcp, 2)}
    expected = set()
    for p in range(2, 9):
        for head in {r[:p] for r in rows}:
            group = [r for r in rows if r[:p] == head]
            if len(group) > 1 and (p == 8 or len({r[: p + 1] for r in group}) > 1):
                expected.add((p, head, len(group)))
    assert got == expected


def test_secrets(docs):
    got = secrets.digest(secrets.scan_secrets(docs)).toPandas()
    for r in got.itertuples():
        if pd.isna(r.doc_id):
            continue
        base = brute_secrets(TEXTS[int(r.doc_id)])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(text)
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}
    weak = {int(r.doc_id): r.spans for r in got.itertuples() if not pd.isna(r.doc_id) and re.search("token|account|endpoint", r.spans)}
    linked, alone = (next(i for i, t in enumerate(TEXTS) if t.startswith(s)) for s in ("login:", "aB3dEfGh1jKlMn0pQrStUv alone"))
    assert {k.split(":")[0] for k in weak[linked].split(",")} == {"account", "endpoint", "token"}
    assert alone not in weak
    assert len(got) == len(ROWS)


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    found = [t for t in out.select("text").toPandas().text if t and "[SECRET]" in t]
    assert found and not any("hunter22" in t or "deadbeef" in t for t in found)
    assert out.where("text is null").count() == 1


def test_personal_data(docs):
    got = pii.digest(pii.find_personal(docs)).toPandas()
    names = ("email", "ip", "card", "phone")
    for r in got.itertuples():
        if pd.isna(r.doc_id):
            continue
        base = brute_personal(TEXTS[int(r.doc_id)])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert r.base_sha256 == sha(joined(base, names))
        assert set(joined(base, names).split(",")) <= set(r.spans.split(",")) | {""}
    told = [r for r in got.itertuples() if "term" in r.spans]
    assert len(told) == 6, "the word beside one address in six contexts gives it away"
    for r in told:
        a, b = map(int, re.findall(r"term:(\d+):(\d+)", r.spans)[0])
        assert TEXTS[int(r.doc_id)][a:b] in ("Zanzibarius", "reaches")


def test_copies_hide_no_disclosure(spark):
    rows = [(i, f"{w} wrote from q@r.st about the {i}th matter") for i, w in enumerate(["Quixotina today", "Then Quixotina", "Later on Quixotina"])]
    rows += [(10 + i, rows[0][1]) for i in range(200)]
    rows += [(300 + i, f"plain text number {i}") for i in range(300)]
    got = pii.digest(pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).toPandas().set_index("doc_id").spans
    for i, text in rows[:203]:
        assert f"term:{text.index('Quixotina')}:{text.index('Quixotina') + 9}" in got[i].split(",")
    assert not got[got.index >= 300].any()


def test_sanitised_text(spark):
    # Beside one address a word that is nowhere else, and one that is in more texts without the address than with it.
    rows = [(i, f"the {i}th by Quixotina\nq@r.st for Umbrellia today {i}, +49 30 1234567{i % 10}", "kept") for i in range(6)]
    rows += [(100 + i, f"note {i} says Umbrellia", "kept") for i in range(8)]
    rows += [(300 + i, f"the plain text by number {i} for today", None) for i in range(3000)]
    rows += [(9000, None, "null"), (0, rows[0][1], "kept"), (9001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hide string").repartition(4)
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "row": F.lit(1), "mark": F.lit("m"), "of_id": F.lit(2)})
    out = pii.sanitise(docs, threshold=0.7)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    for i in range(6):
        assert got[i].text == f"the {i}th by \n[EMAIL] for [WORD] today {i}, [PHONE]"
        assert got[i].n_chars == len(got[i].text) and (got[i].hide, got[i].row, got[i].mark, got[i].of_id) == ("kept", 1, "m", 2)
    for i, text, hide in rows[6:]:
        assert i < 6 or (got[i].text, got[i].hide) == (text, hide)


def test_clashing_columns_stay(docs):
    names = ("_id", "_mark", "_hide", "_gone", "_n", "_i", "_copies", "_rows", "row", "id", "of_id", "of_mark", "hide", "gone", "copies", "n", "col", "rows", "put")
    more = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    for change in (secrets.redact_secrets, pii.sanitise, quality.without_common_lines, quality.clean_good, quality.keep_good, mixing.take, simhash.one_of_each):
        out = change(more)
        assert out.columns == more.columns
        rows = [r for r in out.collect() if r.doc_id is not None]
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), change
        same = change(docs).drop("mark")
        assert sorted(map(repr, out.select(same.columns).collect())) == sorted(map(repr, same.collect())), change


def test_words_elsewhere_in_the_text_count(spark):
    # The name stands beside the address three times, else on another line of a text that holds the address.
    rows = [(i, f"note {i} by Quixotina at q@r.st now" if i < 3 else f"by Quixotina again {i}\n\nq@r.st\n") for i in range(30)]
    rows += [(300 + i, f"plain text number {i}") for i in range(70)]
    got = pii.digest(pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).toPandas().set_index("doc_id").spans
    for i, text in rows[:3]:
        assert f"term:{text.index('Quixotina')}:{text.index('Quixotina') + 9}" in got[i].split(",")


def test_quality(docs):
    got = quality.judge_quality(docs, least=2).toPandas()
    assert len(got) == len(ROWS)
    for r in got.itertuples():
        if pd.isna(r.doc_id):
            continue
        m = brute_quality(TEXTS[int(r.doc_id)])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
    license_ids = [i for i, t in enumerate(TEXTS) if "Licensed" in t]
    left = {int(r.doc_id): r.n_words - r.n_left_words for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert all(left[i] == 6 for i in license_ids) and sum(left.values()) == 6 * len(license_ids)
    kept = quality.keep_good(docs, least=2)
    assert kept.columns == docs.columns and kept.count() == int(got.kept.sum())


def test_common_lines_are_cut(docs):
    out = quality.without_common_lines(docs, least=2)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        t = before[r.doc_id]
        assert r.text == (t if t is None or "Licensed" not in t else "\n".join(x for x in t.split("\n") if "Licensed" not in x))


def test_depleted_documents_go_and_copies_are_one(spark):
    line = "this line stands in every single document of the host and says nothing at all to anyone who reads it here today"
    rows = [(i, f"{line}\nunique{i * 7919}longword", "s") for i in range(60)]
    same = " ".join(f"copy{i}" for i in range(40))
    rows += [(100 + i, same + (" x" if i % 2 else ""), "s") for i in range(60)]
    got = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert not got.kept[got.index < 100].any()
    assert got.kept[got.index >= 100].all()


def test_a_common_line_may_hold_the_longest_word(spark):
    line = "see https://example.org/a/long/address/that/all/pages/of/the/host/repeat for the terms of use of this page and of all the others that stand beside it and are found here"
    rows = [(i, f"{line}\nown{i}", "s") for i in range(60)] + [(100, " ".join(f"w{i}" for i in range(40)), "s")]
    rows += [(200 + i, f"{line.replace('here', 'there')}\nown", "s") for i in range(60)]  # exact copies count once
    got = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert not got.kept[got.index < 100].any() and (got.n_left_words[got.index < 100] == 1).all()
    assert got.kept[got.index >= 100].all()


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme.com/": ("", "", None, "allow"), "http://a.COM": ("a.com", "", None, "allow"), "http://a.com/": ("a.com", "/", "com/", "allow"),
        "https://x.example.com/en/1?q=/": ("x.example.com", "/en/1", "example.com/en/", "block"), "https://WWW.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.www.example.com/en/a": ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"), "http://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://b.net/fr/x#y": ("b.net", "/fr/x", "net/fr/", "block"), "http://b.net/frx/": ("b.net", "/frx/", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.com?x://b.net/fr/": ("a.com", "", None, "allow"), "http://": ("", "", None, "allow"), "http://com/": ("com", "/", "com/", "allow"), "x\nhttp://a.com/\n/b": ("a.com", "/\n/b", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    same_rows(urls.filter_urls(df), [(i, *v) for i, v in enumerate(cases.values())])


def test_trie_prefers_deeper_hosts_then_longer_paths():
    t = urls.Trie([("a", "com", "/x/y/z"), ("b", "e.com", "/"), ("a", "e.com", "/x/y"), ("b", "e.com", "/x/")])
    assert [t.find("e.com", p) for p in ("/x/yes", "/x/", "/", "/x/y/z")] == [("e.com/x/y", "a"), ("e.com/x/", "b"), ("e.com/", "b"), ("e.com/x/y", "a")]
    assert t.find("f.com", "/x/y/zed") == ("com/x/y/z", "a") and t.find("f.com", "/x/y") is None


def brute_components(prints):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in ids]


@pytest.mark.parametrize("bucket", [50_000, 1])
def test_simhash(docs, bucket):
    prints = [brute_print(t) for t in TEXTS]
    group = brute_components(prints)
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None), default=None) for g in set(group)}
    expected = [(ROWS[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(ROWS))]
    same_rows(simhash.digest(simhash.near_copies(docs, bucket=bucket)), expected)
    kept = simhash.one_of_each(docs, similarity=None, bucket=bucket)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


@pytest.mark.parametrize("bucket", [50_000, 4])
def test_links_of_random_prints(spark, bucket):
    r = random.Random(1)
    prints = {r.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:150]:
        for _ in range(3):
            p ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    group = brute_components(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = simhash.print_links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), bucket)
    roots = {r.node: r.root for r in components.components(links).collect()}
    got = [roots.get(signed(p), signed(p)) for p in prints]
    pairs = set(zip(group, got, strict=True))
    assert len(pairs) == len(set(group)) == len(set(got))


def test_golay_neighbours_share_a_key():
    g = simhash.Golay()
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 400)
    keys = [set(k[k >= 0].tolist()) for k in g.keys(words)]
    assert {len(k) for k in keys} <= {1, 6}
    for i in range(23):
        for j in range(i + 1):
            other = g.keys(words ^ (1 << i) ^ (1 << j if i != j else 0))
            assert all(keys[n] & set(o.tolist()) - {-1} for n, o in enumerate(other))


def test_forest_of_a_large_bucket_agrees_with_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base[r.integers(0, 200, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    assert len(prints) > 256
    a, b = simhash.forest(prints)
    place = {int(p): i for i, p in enumerate(prints)}
    got = simhash._labels(np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]), len(prints))
    assert len(set(got)) == len(set(brute_components([int(p) for p in prints])))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 502), (500, 502)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {501: 500, 502: 500}


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        goal = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if goal[s] > most * sizes[s]}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("chunk, fan_in", [(4096, 64), (4, 2)])
def test_mix(spark, chunk, fan_in):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["b", "a", "é", "c", None, "z", "b", "b", "b"])) for i in range(900)]
    rows += [(None, "x y z", "b"), (5, None, "a"), (6, "same", "lone"), (6, "same", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, chunk=chunk, fan_in=fan_in)
    got = mixed.toPandas()
    again = mixing.mix(docs.repartition(3), chunk=chunk, fan_in=fan_in)
    same_rows(again, [tuple(x) for x in mixed.collect()])
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(WORD, t or ""))
    goal = brute_targets(sizes)
    assert len(got) == len(rows) and (got.taken == got.copies * got["size"]).all() and (got.taken <= 3 * got["size"]).all()
    by_target = got.groupby(["target", "source_size"]).agg(taken=("taken", "sum"))
    expected = sorted((goal[s], sizes[s]) for s in goal)
    assert np.allclose(sorted(by_target.index), expected)
    for (target, _), row in by_target.iterrows():
        assert abs(row.taken - target) <= 60
    taken = mixing.take(docs, chunk=chunk, fan_in=fan_in)
    assert taken.columns == docs.columns and taken.count() == got.copies.sum()


def test_pair_keeps_mass_and_expectation():
    r = random.Random(0)
    for _ in range(200):
        p, q, s, t = r.uniform(0.01, 0.99), r.uniform(0.01, 0.99), r.randint(1, 50), r.randint(1, 50)
        up, down = min(1 - p, q * t / s), min(p, (1 - q) * t / s)
        edge = down / (up + down)
        first, second = mixing.pair(p, s, q, t, edge * 0.999), mixing.pair(p, s, q, t, min(edge * 1.001, 1 - 1e-12))
        for a, b in (first, second):
            assert abs(a * s + b * t - p * s - q * t) < 1e-9 and (min(abs(a), abs(1 - a)) < 1e-9 or min(abs(b), abs(1 - b)) < 1e-9)
        assert abs(edge * first[0] + (1 - edge) * second[0] - p) < 1e-9


def test_byte_pairs(docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    reference = Tokenizer.from_file(path)
    expected = []
    for row, t in zip(ROWS, TEXTS, strict=True):
        ids = reference.encode(t, add_special_tokens=False).ids
        expected.append((row[0], len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    same_rows(bpe.digest(bpe.round_trip(docs)), expected)
    again = bpe.decode(bpe.encode(docs.drop("n_chars"))).select("doc_id", "text")
    assert again.columns == ["doc_id", "text"]
    same_rows(again, [(r[0], t) for r, t in zip(ROWS, TEXTS, strict=True)])


def test_encoder_streams_and_forgets():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    with open(path, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    reference, encoder, r = Tokenizer.from_file(path), bpe.Encoder(vocabulary), random.Random(3)
    for text in ["a" * 20_000, "".join(r.choice("abehintos") for _ in range(20_000)), "é漢" * 3000, "=" * 7777]:
        data, ids, most = text.encode(), [], 0
        for i in range(0, len(data), 50):
            ids += encoder.feed(data[i : i + 50])
            most = max(most, len(encoder.text))
        ids += encoder.close()
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert most < 10 * vocabulary.lookahead
    odd = ["<|endoftext|>a <|endoftext|>", "it's we'LL 12½²Ⅷ٣ \x1c\x1d a\x85b c\u2003\u3000 🙂👩‍👧"]
    odd += ["".join(r.choice("ab 1\n\t'.sé漢½ ") for _ in range(40)) for _ in range(500)]
    pieces = bpe.Pieces(vocabulary)
    for text in odd:
        ids = np.frombuffer(bpe.encode_text(text, vocabulary, pieces), dtype="<i4").tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(ids, vocabulary.bytes) == reference.decode(ids, skip_special_tokens=False)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><article><header><h1>Head &amp; more</h1></header><p>First <b>bold</b>&nbsp; text.<br>Next<p>Second &lt;x&gt; &amp &#233;</p><form><input value=">">Mail</form><div id="comments"><p>Nice</p></div>
<p class="share-this">Share</p></article><aside>Side</aside><div hidden>Gone</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_an_article(spark):
    rows = [(1, "http://a.b/x", ARTICLE), (2, None, None), (3, "http://a.b/y", ""), (1, "http://a.b/x", ARTICLE), (None, "nowhere", "<p>Plain"), (4, "http://c.d/", "<p>" + "word " * 30_000)]
    got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = "Head & more\n\nFirst bold text. Next\n\nSecond <x> & é"
    long = ("word " * 30_000).strip()
    same_rows(got, [(1, "http://a.b/x", text, len(text)), (1, "http://a.b/x", text, len(text)), (2, None, "", 0), (3, "http://a.b/y", "", 0), (None, "nowhere", "Plain", 5), (4, "http://c.d/", long, len(long))])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body class='with-sidebar'><div class='layout sidebar-left'><main><p>Body</p><article class='comment'><p>Me too</p></article></main></div></body>", "Body"),
        ("<article><p>One<p>Two<div class='ad-slot'><p>Buy<b>!</b></div>Three<br/>four</article>", "One\n\nTwo\n\nThree four"),
        ("<p>a<script>x<y</script>b</p><!-- c --><p hidden>d</p><style>e</style><p>f", "ab\n\nf"),
        ("<article><h1>A &lt;b&gt; &#x41;&nbsp;&copy</h1><p>x < y and 3 > 2</p></article>", "A <b> A ©\n\nx < y and 3 > 2"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "one\n\ntwo\n\n1 2\n\n3"),
        ("<article><p>open <b>bold", "open bold"),
        ("<div class='cookie-notice'>We use</div><form><p>Mail</p></form>", ""),
    ],
)
def test_blocks(page, text):
    assert html_main.main_text(html_main.lines_of(page), set()) == text


def test_neighbours_lose_what_they_share(spark):
    page = lambda i: f"<body><div>Welcome to the site</div><p>Story number {i} with words of its own, {i * 7}</p><p>More about {i * 3}</p><div>All rights reserved here</div></body>"
    rows = [(i, f"http://a.b/x/{i:03d}", page(i)) for i in range(90)] + [(500 + i, f"http://c.d/{i}", f"<body><p>The very same page of {9}</p></body>") for i in range(3)]
    for parts in (1, 7):
        got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).toPandas().set_index("page_id").text
        assert all(got[i] == f"Story number {i} with words of its own, {i * 7}\n\nMore about {i * 3}" for i in range(90))
        assert all(got[500 + i] == "The very same page of 9" for i in range(3))


def test_articles_lose_what_two_different_neighbours_share(spark):
    share = "<p>Read our newsletter for more of this</p>"
    page = lambda i: f"<article>{share}<p>Story number {i} with words of its own, {i * 7}</p>{f'<p>A passage quoted by pages {i // 2}</p>' if i < 30 else ''}</article>"
    rows = [(i, f"http://a.b/x/{i:03d}", page(i)) for i in range(60)]
    # Copies on all sides of a page neither hide its other neighbours nor count as several.
    rows += [(100 + i, f"http://a.b/x/020{'a' * i}", page(20)) for i in range(1, 6)]
    rows += [(200 + i, f"http://e.f/{i // 9}{i % 9}", f"<article>{share}<p>{'Long story of its own ' * 40}{i // 9}</p><p>{'' if i % 9 else 'First'} copy {i % 9}</p></article>") for i in range(18)]
    for parts in (1, 7):
        got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).toPandas().set_index("page_id").text
        own = lambda i: f"Story number {i} with words of its own, {i * 7}" + (f"\n\nA passage quoted by pages {i // 2}" if i < 30 else "")
        assert all(got[i] == own(i) for i in range(60))
        assert all(got[100 + i] == own(20) for i in range(1, 6))
        assert all("newsletter" in got[200 + i] for i in range(18))  # one other article is too little evidence


def test_ends_of_ranges_meet():
    def run(parts):
        diff = [r for k, p in enumerate(parts) for r in html_main._walk((html_main.Page(SimpleNamespace(host="h", path="", form=i, part=k, keys=keys, sizes=[9] * len(keys), needs=2, before=0, after=0)) for i, keys in p), True)]
        ends = sorted((r for r in diff if r[4]), key=lambda r: r[2])
        names = ["host", "path", "form", "part", "end", "shared", "keys", "sizes", "needs", "before", "after"]
        more = html_main._walk((html_main.Page(SimpleNamespace(**dict(zip(names, r, strict=True)))) for r in ends), False)
        return sorted((r[2], r[5]) for r in [*(r for r in diff if not r[4]), *more])

    r = random.Random(8)
    for _ in range(40):
        pages = [(i, [1, 2, *[100 + r.randint(0, 1) if r.random() < 0.1 else 1000 + i * 10 + j for j in range(3)]]) for i in range(12)]
        pages = [p if r.random() < 0.7 or not p[0] else (p[0], pages[p[0] - 1][1]) for p in pages]
        cuts = sorted(r.sample(range(1, 12), 3))
        parts = [pages[a:b] for a, b in zip([0, *cuts], [*cuts, 12], strict=True)]
        assert run([pages]) == run(parts)


@pytest.mark.parametrize("cells", [1, 10, 60])
def test_halved_alignments_are_as_long(cells):
    r = random.Random(7)
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 30))] for _ in "ab")
        got = html_main.matches(a, b, cells)
        assert got == sorted(got) and all(a[i] == b[j] for i, j in got)
        assert all(x < z and y < w for (x, y), (z, w) in zip(got, got[1:]))
        assert len(got) == len(html_main.matches(a, b))


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_main.shared_lines(a, b)
        at = 0
        for i in got:
            at = b.index(a[i], at) + 1
        assert got == sorted(got) and len(got) == table[-1][-1]


def test_image_copies(spark):
    r = np.random.default_rng(3)
    base = [images.resized(r.random((1, 20, 20)), 128, 128)[0] for _ in range(20)]
    rows = []

    def add(i, a):
        a = np.clip(np.rint(a * 255), 0, 255).astype(np.uint8)
        rows.append((i, a.shape[0], a.shape[1], a.tobytes()))

    for k, b in enumerate(base):
        add(k, b)
    for k in range(6):
        add(100 + k, base[k][20:110, 10:100] * 0.8 + 0.1)
    for k in range(6, 10):
        add(100 + k, np.rot90(base[k]))
    for k in range(10, 13):
        add(100 + k, base[k] + r.normal(0, 0.01, (128, 128)))
    for k in range(13, 16):
        add(100 + k, images.resized(base[k][None], 90, 90)[0])
    add(200, base[0])
    rows += [(201, 5, 5, None), (202, 5, 5, b"short"), (203, 20, 20, bytes(400)), (None, 20, 20, bytes(400))]
    got = images.image_copies(spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")).toPandas()
    cls = {r.image_id: r.class_id for r in got.itertuples() if not pd.isna(r.image_id)}
    assert len(got) == len(rows)
    assert [cls[100 + k] for k in range(16)] == list(range(16)) and [cls[k] for k in range(20)] == list(range(20))
    assert cls[200] == 0 and cls[201] == 201 and cls[203] == 203


def test_image_links_are_all_pairs_that_meet_the_threshold(spark):
    """Three versions of each picture are three links, also where smaller ids share keys; blocks and batches change nothing."""
    r = np.random.default_rng(5)
    base = [images.resized(r.random((1, 8, 8)), 64, 64)[0] for _ in range(8)]
    shots = [np.clip(np.rint(b * 255), 0, 255).astype(np.uint8) for _ in range(3) for b in base]
    for k, a in enumerate(shots):
        a[0, 0] = k  # differs, but no corner does: the smallest id has every key of the others
    rows = [(k, 64, 64, a.tobytes()) for k, a in enumerate(shots)]
    df = spark.createDataFrame([*rows, *rows[:3]], "image long, height int, width int, pixels binary")
    want = sorted((b + 8 * k, b + 8 * j) for b in range(8) for k in (1, 2) for j in range(k))
    for block in (images.BLOCK, 200):
        assert sorted(tuple(x) for x in images.image_links(df, block=block).collect()) == want
    got = images.image_copies(df.withColumnRenamed("image", "image_id")).collect()
    assert len(got) == 27 and all(x.n_links == 2 and x.class_id == x.image_id % 8 for x in got)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    words = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, prose(r.randint(30, 200)), "en", f"s{i % 4}", 1) for i in range(200)]
    rows += [(1000 + i, rows[i][1], "en", "s1", 1) for i in range(20)] + [(2000, "short", "en", "s1", 1), (2001, prose(40) + " password=hunter22", "en", "s2", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame(rows, columns)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        steps[name] = now
        if name != "byte pairs":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: [x.doc_id for x in steps[n].select("doc_id").collect()]
    assert sorted(ids("quality rules")) == sorted(x[0] for x in rows if x[0] != 2000)
    assert sorted(ids("near-copies")) == [*range(200), 2001]
    assert sorted(ids("secret scans")) == [*range(200), 2001]
    assert steps["secret scans"].where("doc_id = 2001").first().text.endswith(" [SECRET]")
    counts = steps["source mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert counts <= 3 and len(ids("byte pairs")) == len(ids("source mix"))
    assert steps["byte pairs"].where("size(ids) <> n_tokens").count() == 0


def test_shingles_find_near_copies(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows, next_id = [], 0
    for _ in range(40):  # a source and copies edited by themselves: alike to the source, less so to each other
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        copies = [base]
        for _ in range(r.randint(0, 6)):
            copy = base[:]
            for _ in range(max(1, len(base) // 80)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            copies.append(copy)
        for c in copies:
            rows.append((next_id, " ".join(c)))
            next_id += 1
    rows += [(next_id, None), (next_id + 1, ""), (next_id + 2, "two words"), (next_id + 3, rows[0][1].upper())]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    expected = {i: find(i) for i in ids}
    found = simhash._grouped_with_shingles(docs, simhash.near_copies(docs), 0.8)
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert got == expected
    kept = simhash.one_of_each(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("bucket", [8_000, 4])
def test_followers_meet_without_their_leader(spark, bucket):
    # Many copies of one source, each too far from it and from the others, with a near copy of its own.
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    source = [r.choice(vocabulary) for _ in range(300)]

    def edited(words, n):
        out = words[:]
        for at in r.sample(range(len(out)), n):
            out[at] = r.choice(vocabulary)
        return out

    texts = [source]
    for _ in range(40):
        copy = edited(source, 13)
        texts += [copy, edited(copy, 4)]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string").repartition(3)
    sets = [{" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    similarity = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    near = {(i, j) for i in range(len(sets)) for j in range(i) if similarity(i, j) >= 0.8}
    assert sum(similarity(0, i) < 0.8 for i in range(1, 81, 2)) > 30 and len(near) >= 35
    nodes, links = shingles.similar_texts(docs, bucket=bucket)
    of = {x.node: x.doc_id for x in nodes.collect()}
    got = {(max(of[x.a], of[x.b]), min(of[x.a], of[x.b])) for x in links.collect()}
    assert got <= near and classes(got, len(texts)) == classes(near, len(texts))


def classes(pairs, n):
    """Least member of each one's class."""
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("bucket", [8_000, 5])
def test_chains_of_edits_are_one_class(spark, bucket):
    # Each text is near the one before only, so nobody resembles all: leaders alone would break the chain.
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(4):
        now = [r.choice(vocabulary) for _ in range(200)]
        for step in range(25):
            texts.append(now)
            now = now[:]
            at = (step * 37) % 190
            now[at : at + 8] = [r.choice(vocabulary) for _ in range(8)]
    rows = list(enumerate(" ".join(t) for t in texts)) + [(None, None), (500, ""), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [{" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    near = {(i, j) for i in range(100) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(set(classes(near, 100))) == 4
    nodes, links = shingles.similar_texts(docs, bucket=bucket)
    of = {x.node: x.doc_id for x in nodes.where("doc_id < 100").collect()}
    assert classes({(of[x.a], of[x.b]) for x in links.collect()}, 100) == classes(near, 100)


def test_leaders_give_no_pairs_of_pairs():
    r = np.random.default_rng(5)
    base = r.integers(1, 256, (3, 400)).astype(np.uint8)
    of = r.integers(0, 3, 500)
    sketches = base[of]
    sketches[r.random(sketches.shape) < 0.08] = 7
    links = shingles.led(np.arange(500), sketches)
    assert len(links) == 497 and len({b for _, b in links.tolist()}) == 497


def test_prefixes_lose_no_similar_pair(spark):
    r = np.random.default_rng(7)
    base = r.integers(0, 400, (12, 60))
    sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.08, 0.2]), r.integers(0, 400, 60), base[i % 12])[: r.integers(45, 60)]) for i in range(150)]
    sets += [np.arange(k) + 900 for k in range(1, 12)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "node bigint, hashes array<bigint>")
    rows = shingles._prefixes(df, 0.8).toPandas()
    near = {(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert len(near) > 100
    for groups in (rows["node"], rows["node"] % 5):  # nodes of one group needn't meet
        met = set()
        for _, f in rows.assign(group=groups).groupby("bucket"):
            met |= {(max(p), min(p)) for p in shingles.crossed(0.8)(*(f[c].to_numpy() for c in ("node", "group", "pos", "size"))).tolist()}
        of = dict(zip(rows["node"], groups, strict=True))
        assert {p for p in near if of[p[0]] != of[p[1]]} <= met
        assert len(met) < 0.3 * len(sets) ** 2 / 2


def test_a_template_below_the_threshold_costs_its_size(spark):
    # 20000 pages of 100 shingles, 85 of which all share: 0.74 alike, so no two may be compared.
    n = 20_000
    template = shingles.crossed(0.8)(np.arange(n), np.arange(n), np.full(n, 15), np.full(n, 100))
    assert len(template) == 0
    rows = [(i, [*range(85), *range(1000 + 15 * i, 1015 + 15 * i)]) for i in range(300)]
    prefixes = shingles._prefixes(spark.createDataFrame(rows, "node bigint, hashes array<bigint>"), 0.8).toPandas()
    assert len(prefixes) <= 300 * 6 and prefixes["pos"].min() == 15
    rows = [(i, [*range(70), *range(1000 + 30 * i, 1030 + 30 * i)]) for i in range(300)]
    assert shingles._prefixes(spark.createDataFrame(rows, "node bigint, hashes array<bigint>"), 0.8).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(2)
    for n in (40, 400, 4000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 9 // 10], r.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        got = shingles.resemblance(shingles.sketch(np.unique(a)), np.stack([shingles.sketch(np.unique(b)), np.zeros(400, np.uint8)]))
        assert abs(got[0] - 9 / 11) < 0.06 and got[1] == 0
    assert shingles.resemblance(np.zeros(400, np.uint8), np.zeros((1, 400), np.uint8))[0] == 0
