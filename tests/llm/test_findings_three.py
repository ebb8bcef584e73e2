"""Tests of round three's findings."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from groundloom.llm import images, passages, repeats


def brute_votes(p: np.ndarray, q: np.ndarray) -> int:
    """The most places of p that one turn, scale and shift takes to q, by sets."""
    best = 0
    for half in (0.0, 0.5):
        cells: dict = {}
        for a, b in zip(p, q, strict=True):
            (px, py, ps, pa), (qx, qy, qs, qa) = images.unpacked(a), images.unpacked(b)
            turn, grow = qa - pa, ps / qs
            dx, dy = qx - grow * (px * np.cos(turn) - py * np.sin(turn)), qy - grow * (px * np.sin(turn) + py * np.cos(turn))
            cell = np.floor(turn / (np.pi / 8) + half) % 16, np.floor(np.log2(grow) / 0.5 + half), np.floor(dx / 12 + half), np.floor(dy / 12 + half)
            cells.setdefault(cell, set()).add((px // 4, py // 4))
        best = max([best, *map(len, cells.values())])
    return best


def test_f2_many_pairs_of_images_are_judged_at_once(monkeypatch):
    """Pairs are judged together, not one by one, and to the same result, in one block or two and in small batches."""
    r = np.random.default_rng(12)
    rows, base = [], [(r.integers(0, 200, (9, 2)), r.integers(0, 3, 9), r.random(9) * 6.28) for _ in range(6)]
    for image in range(90):
        (at, scale, angle), moved = base[image % 6], r.integers(0, 30, 2) + r.integers(0, 9, (9, 2))
        spots = np.array([images.spot(x, y, int(s), a) for (x, y), s, a in zip((at + moved).astype(float), scale, angle, strict=True)])
        keys = np.where(r.random((9, 4)) < 0.5, r.integers(0, 4, (9, 4)), 10 + 9 * (image % 6) + np.arange(9)[:, None]).astype(np.int64)
        rows.append((int(r.integers(-1000, 1000)) * 100 + image, 9, spots.tobytes(), keys.tobytes()))
    block = pd.DataFrame(rows, columns=["image", "n", "spots", "keys"])
    want = set()
    for u, _, p, k in rows:
        for v, _, q, m in rows:
            if u < v:
                one, two = (np.frombuffer(x, dtype=np.int64).reshape(9, -1) for x in (k, m))
                a, _, b, _ = np.nonzero(one[:, :, None, None] == two[None, None, :, :])
                if len(a) and brute_votes(np.frombuffer(p, dtype=np.int64)[a], np.frombuffer(q, dtype=np.int64)[b]) >= 6:
                    want.add((v, u))
    assert 100 < len(want) < 2000
    calls, judge = [], images.agreement
    monkeypatch.setattr(images, "agreement", lambda *a: calls.append(1) or judge(*a))
    assert set(images.linked(block, None, 6)) == want
    assert len(calls) * 10 < len(want)
    a, b = block.iloc[:40], block.iloc[40:]
    for matches, counted in ((images.MATCHES, images.COUNTED), (500, 100)):
        monkeypatch.setattr(images, "MATCHES", matches)
        monkeypatch.setattr(images, "COUNTED", counted)
        assert {x for pair in ((a, None), (a, b), (b, None)) for x in images.linked(*pair, 6)} == want


def test_f1_links_of_a_large_group_leave_their_task_as_rows_of_images(spark, monkeypatch):
    """A class of 63 has 1953 links; what leaves the tasks is a row for each of its images and each pair of blocks."""
    r = np.random.default_rng(14)
    base = [np.clip(np.rint(images.resized(r.random((1, 8, 8)), 64, 64)[0] * 255), 0, 255).astype(np.uint8) for _ in range(5)]
    rows = []
    for k in range(72):
        a = base[max(0, k - 59) // 4].copy()  # 63 of the first, 4 each of the next two, 1 of the last
        a[0, 0] = k  # no corner
        rows.append((k, 64, 64, a.tobytes()))
    of = [max(0, k - 59) // 4 for k in range(72)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")
    made, cut = [], images.cut

    def counted(df):
        out = cut(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(images, "cut", counted)
    got = {x.image_id: (x.n_links, x.class_id) for x in images.image_copies(df).collect()}
    assert got == {k: (of.count(of[k]) - 1, of.index(of[k])) for k in range(72)}
    assert made and max(made) <= 72
    small = df.withColumnRenamed("image_id", "image")
    ties, links = images.image_ties(small, block=1500).collect(), images.image_links(small, block=1500).collect()
    assert len(links) == sum(of.count(c) * (of.count(c) - 1) // 2 for c in set(of))
    sums: dict = {}
    for x in ties:
        sums[x.image] = sums.get(x.image, 0) + x.n_links
        assert of[x.image] == of[x.least] and x.least <= x.image
    assert len(ties) > len(sums) and sums == {k: of.count(of[k]) - 1 for k in range(72) if of.count(of[k]) > 1}


def test_f1_ties_give_the_degrees_and_classes_of_all_links():
    """Also where links are no groups but chains, found in any order and a few at a time."""
    r = np.random.default_rng(15)
    for _ in range(30):
        n = int(r.integers(2, 60))
        a, b = r.integers(0, n, (2, int(r.integers(1, n))))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        least = np.arange(n)
        for at in range(0, len(a), 3):
            least = images.united(least, a[at : at + 3], b[at : at + 3])
        assert least.tolist() == want == images.united(np.arange(n), a, b).tolist()


def brute_passages(texts: list[str | None]) -> list[int]:
    """Runs of words that strings of 51 words cover which another text of the list has."""
    words = [(t or "").encode().lower().split() for t in texts]
    where: dict = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(i)
    out = []
    for w in words:
        at = [k for k in range(len(w) - 50) if len(where[tuple(w[k : k + 51])]) > 1]
        out.append(sum(not n or k > at[n - 1] + 51 for n, k in enumerate(at)))
    return out


def test_f1_passages_are_runs_of_words_of_other_documents(spark):
    """Short words, other white space and capitals count; a passage twice in one document only does not, nor do touching pieces of 50 words."""
    draw = random.Random(8)
    text = lambda n, most=7: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, most))) for _ in range(n))
    plain, short, own, fifty, other = text(51), text(55, 3), text(60), text(50), text(50)
    assert len(short) < 250
    spread = plain.replace(" ", "\n ").title()
    texts = [f"{text(20)} {x} {text(30)}" for x in (plain, spread, short, short, f"{own} {text(9)} {own}", f"{fifty} {other}", f"{fifty} x {other}", f"{text(70)} {plain} {text(60)} {short}")]
    texts += [text(80)] * 3 + [text(20)] * 2 + [None, "", text(40), " ".join(["the"] * 70), " ".join(["the"] * 90), text(400), "x" * 900]
    texts += [f"{text(300)} {texts[-2]} {text(300)}"]
    rows = list(enumerate(texts))
    want = brute_passages(texts)
    assert want[:8] == [1, 1, 1, 1, 0, 0, 0, 2] and want[8:13] == [1, 1, 1, 0, 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_passages for r in repeats.drop_repeats(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_f1_windows_of_long_texts_are_found_in_pieces():
    draw = random.Random(9)
    texts = [" ".join("".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(n)).encode() for n in (700, 3, 51, 90)] + [b"y" * 3000 + b" z" * 60]
    every = lambda size: sorted({x for part in passages.described(enumerate(texts), 51, 16, size) for x in zip(*(c.tolist() for c in part), strict=True)})
    assert len(every(1 << 19)) == 650 + 1 + 40 + 11
    assert every(700) == every(1 << 19) == every(1500)
