"""Passages of many words that other documents have too.

A passage is a run of over ``words`` - 1 words, A-Z lower-cased, that another
document also has, whatever white space lies between the words. Of each window
of that many words, the string of GRAM words with the smallest hash is an anchor
(the last of equal ones), so that equal windows have equal anchors at one
offset. Only windows around anchors that different texts share are hashed as a
whole and counted. Texts alike as a whole share all windows, and aren't
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import kept, tidy

WORDS, GRAM = 51, 16
#: Bytes of text described at a time; a longer text is cut into pieces that share WORDS - 1 words.
SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
FOUND = "gram bigint, mark bigint, at bigint"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times powers of BASE, and the inverse powers: hashes of any stretch, wherever it lies."""
    up, down = (np.full(len(values) + 1, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * np.cumprod(up, dtype=np.uint64)[:-1], out=sums[1:])
    return sums, np.cumprod(down, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the byte where it begins."""
    view = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~BLANK[view], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, stop = edges[::2], edges[1::2]
    sums, down = _sums(LOWER[view].astype(np.uint64) + np.uint64(1))
    return mixed((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)), begin


def stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    sums, down = _sums(hashes)
    return mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def pieces(data: bytes, words: int, slice_: int) -> Iterator[tuple[int, bytes]]:
    """(words before, bytes): a text, or pieces of it where it is long; each window of words lies in one of them as a whole."""
    at, before, size = 0, 0, slice_
    while len(data) - at > size:
        cut = at + size
        while cut > at and not BLANK[data[cut]]:
            cut -= 1
        tail = data[at:cut].rsplit(None, words - 1)
        if len(tail) < words:  # hardly any white space
            size *= 2
            continue
        yield before, data[at:cut]
        at, before, size = at + len(tail[0]), before + len(tail[0].split()), slice_
    yield before, data[at:]


def described(texts: Iterator[tuple[int, bytes]], words: int, gram: int, slice_: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, at, anchor, gram's hash, window's hash) arrays of all windows of some texts (row, bytes); at and anchor count words."""

    def run(some: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        hashes, begin = word_hashes(b"\n".join(d for _, _, d in some))
        if len(hashes) < words:
            return
        starts = np.cumsum([0, *(len(d) + 1 for _, _, d in some)])
        of = np.searchsorted(starts, begin, "right") - 1
        first = np.searchsorted(begin, starts[:-1])
        grams, windows = stretches(hashes, gram), stretches(hashes, words)
        low = np.uint64((1 << 21) - 1)
        least = (grams & ~low) | (low - (np.arange(len(grams), dtype=np.uint64) & low))
        size, width = 1, words - gram + 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        good = np.flatnonzero(of[: len(windows)] == of[words - 1 :])
        place = (low - (least[good] & low)).astype(np.int64)
        anchor = good + ((place - good) & int(low))
        to_word = np.array([n for _, n, _ in some])[of[good]] - first[of[good]]
        yield np.array([r for r, _, _ in some])[of[good]], good + to_word, anchor + to_word, grams[anchor].view(np.int64), windows[good].view(np.int64)

    held, size = [], 0
    for row, text in texts:
        for before, piece in pieces(text, words, slice_):
            if held and size + len(piece) > slice_:
                yield from run(held)
                held, size = [], 0
            held.append((row, before, piece))
            size += len(piece) + 1
    if held:
        yield from run(held)


def anchors(words: int, gram: int, slice_: int):
    """FOUND: the anchors of windows of words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            marks = f["mark"].to_numpy()
            for row, _, anchor, grams, _ in described(((i, t.encode()) for i, t in enumerate(f["text"])), words, gram, slice_):
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])[: len(row)]
                yield pd.DataFrame({"gram": grams[new], "mark": marks[row[new]], "at": anchor[new]})

    return run


def wanted_windows(words: int, gram: int, slice_: int):
    """window, mark, at: the windows whose anchor is wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdDecompressor()
        for f in frames:
            marks, wanted = f["mark"].to_numpy(), f["wanted"].to_list()
            sizes = [len(w) for w in wanted]
            keys = np.sort(np.repeat(np.arange(len(f)), sizes) << 40 | np.concatenate([np.asarray(w, dtype=np.int64) for w in wanted])) if len(f) else None
            for row, at, anchor, _, windows in described(((i, tool.decompress(t)) for i, t in enumerate(f["text"])), words, gram, slice_):
                key = row << 40 | anchor
                good = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                yield pd.DataFrame({"window": windows[good], "mark": marks[row[good]], "at": at[good]})

    return run


def runs(begins: list[int], words: int) -> int:
    """Runs that windows cover; those that touch are one."""
    at = np.unique(np.asarray(begins, dtype=np.int64))
    return int(len(at) and 1 + (np.diff(at) > words).sum())


def passages(rows: DataFrame, texts: DataFrame, words: int = WORDS, gram: int = GRAM, slice_: int = SLICE) -> DataFrame:
    """mark, begins, several: one row for each text that shares a window of words with another row.

    begins: the words where such windows begin (null: none that a different
    text has); several: rows have this very text. rows: mark, text; texts: mark,
    text (compressed). Marks tell texts apart.
    """
    copies = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", F.lit(True).alias("several"))
    found = kept(rows.select("mark", "text").mapInPandas(tidy(anchors(words, gram, slice_)), FOUND).distinct(), "word-anchors")
    differ = F.min("mark") != F.max("mark")
    shared = found.groupBy("gram").agg(differ.alias("differ")).where("differ").select("gram")
    wanted = found.join(kept(shared, "word-grams"), "gram").groupBy("mark").agg(F.collect_set("at").alias("wanted"))
    one = texts.join(wanted, "mark").select("mark", "text", "wanted")
    windows = kept(one.mapInPandas(tidy(wanted_windows(words, gram, slice_)), "window bigint, mark bigint, at bigint"), "windows")
    again = windows.groupBy("window").agg(differ.alias("differ")).where("differ").select("window")
    begins = windows.join(kept(again, "shared-windows"), "window").groupBy("mark").agg(F.collect_set("at").alias("begins"))
    return begins.join(copies, "mark", "full_outer")
