"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every whole text is measured (lengths, kinds of characters, repetition, words
and lines); the measures, standardised, are mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Partitions sum their normal
equations, which merge up a tree; the ridge solution scores texts. On labelled
rows set aside for it, scores are counted in bins and pooled until they rise
(isotonic regression), which turns a score into a probability.

All labelled rows are fitted; what reaches the driver are sums of a fixed size.
Only the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, kept, own, tidy
from groundloom.llm.partials import summed

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3
#: Random features, the seed of their directions, the ridge penalty for each row, the kernel's width in standard deviations of a measure.
FEATURES, SEED, PENALTY, WIDTH = 256, 13, 1e-4, 6.0
BINS, SPREAD, CLIP = 4096, (-1.0, 2.0), 4.0
#: Rows measured at once.
ROWS = 64

SYMBOLS = np.frombuffer(b"#*$%&|<>@\\^_`~{}[]+=/", dtype="uint8")
MEASURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper_words", "title_words", "bare_words", "symbols", "symbols_a_word", "digits",
    "calls", "stops", "commas", "blanks", "distinct_words", "commonest_word", "stutter", "distinct_pairs", "words_a_line", "repeated_lines", "other_bytes",
)


def measure(text: str) -> list[float]:
    """The measures of one text, in the order of MEASURES; shares are 0 where there is nothing to share."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype="uint8")
    seen = np.bincount(raw, minlength=256)
    w, size = text.split(), max(len(raw), 1)
    n = max(len(w), 1)
    lengths = np.fromiter(map(len, w), dtype="float64", count=len(w)) if w else np.zeros(1)
    times = Counter(w)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = float(seen[SYMBOLS].sum())
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(w))),
        float(min(lengths.mean(), 40)),
        float(min(lengths.std(), 40)),
        sum(map(str.isupper, w)) / n,
        sum(map(str.istitle, w)) / n,
        sum(map(str.isalpha, w)) / n,
        symbols / size,
        min(symbols / n, 8.0),
        float(seen[48:58].sum()) / size,
        float(seen[33] + seen[63]) / n,
        float(seen[46]) / n,
        float(seen[44]) / n,
        float(seen[32] + seen[9] + seen[13]) / size,
        len(times) / n,
        (max(times.values()) if times else 0) / n,
        sum(map(str.__eq__, w, w[1:])) / n,
        len(set(zip(w, w[1:], strict=False))) / n,
        float(np.log1p(len(w) / max(len(lines), 1))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(seen[128:].sum()) / size,
    ]


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """The crc32 of the id as text, modulo folds; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % folds).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, fold, x (array<double>): one row for each row of docs; a null text is measured as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = np.array([measure(t.as_py()) for t in part.column("text")]).ravel()
                ends = pa.array(np.arange(part.num_rows + 1, dtype="int32") * len(MEASURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc_id", "fold", "x"])

    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("fold"), as_text(F.col("text")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, fold int, x array<double>")


@dataclass
class Quality:
    """What fitting gives. Without labels, weights is None and every score is a half."""

    middle: np.ndarray
    spread: np.ndarray
    features: int
    seed: int
    width: float
    weights: np.ndarray | None = None
    edges: np.ndarray | None = field(default=None)
    levels: np.ndarray | None = field(default=None)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.directions = r.standard_normal((len(self.middle), self.features)) / self.width
        self.phases = r.uniform(0, 2 * np.pi, self.features)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        even = np.clip((x - self.middle) / self.spread, -CLIP, CLIP)
        z = np.sqrt(2 / self.features) * np.cos(even @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.weights is None else self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(raw if self.edges is None else np.interp(raw, self.edges, self.levels), 0.0, 1.0)


def pooled(at: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that fall: where each block begins and ends, and its mean, twice."""
    blocks: list[list[float]] = []  # first, last, total, n
    for a, t, k in zip(at.tolist(), total.tolist(), n.tolist(), strict=True):
        blocks.append([a, a, t, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    edges = np.array([e for b in blocks for e in b[:2]])
    return edges, np.repeat([b[2] / b[3] for b in blocks], 2)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = SEED, penalty: float = PENALTY, width: float = WIDTH) -> Quality:
    """Fits measured rows to labels (doc_id, quality), of all folds but HELD_OUT; CALIBRATION's rows only calibrate.

    Labels without an id or quality are left out; several of one id count as
    their mean. Without rows to calibrate, raw scores are cut to 0 to 1.
    """
    known = own(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("of_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    taught = kept(rows.where(F.col("fold") != HELD_OUT).join(known, F.col("doc_id") == F.col("of_id")).select("fold", "x", "y"), "taught")
    learned = taught.where(F.col("fold") != CALIBRATION)
    d = len(MEASURES)
    sums = learned.agg(F.count(F.lit(1)), *(F.avg(F.get("x", F.lit(k))) for k in range(d)), *(F.stddev_pop(F.get("x", F.lit(k))) for k in range(d))).first()
    n = sums[0]
    if not n:
        return Quality(np.zeros(d), np.ones(d), features, seed, width)
    spread = np.array(sums[1 + d :])
    model = Quality(np.array(sums[1 : 1 + d]), np.where(spread > 1e-9, spread, 1.0), features, seed, width)

    def add(state: list, batch: pa.RecordBatch) -> list:
        x, y = _matrix(batch), batch.column("y").to_numpy(zero_copy_only=False)
        for at in range(0, len(x), 1024):
            z = model.mapped(x[at : at + 1024])
            state[0] += z.T @ z
            state[1] += z.T @ y[at : at + 1024]
        return state

    left, right = summed(learned, lambda: [np.zeros((features + 1, features + 1)), np.zeros(features + 1)], add, lambda a, b: [a[0] + b[0], a[1] + b[1]])
    ridge = np.full(features + 1, penalty * n)
    ridge[-1] = 0  # the constant isn't penalised
    model.weights = np.linalg.lstsq(left + np.diag(ridge), right, rcond=None)[0]
    step = (SPREAD[1] - SPREAD[0]) / BINS

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor((np.clip(model.raw(_matrix(batch)), *SPREAD) - SPREAD[0]) / step).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["at", "y"])

    counts = taught.where(F.col("fold") == CALIBRATION).select("x", "y").mapInArrow(binned, "at bigint, y double").groupBy("at").agg(F.sum("y"), F.count(F.lit(1))).collect()  # BINS rows at most
    if counts:
        at, total, k = np.array(sorted(map(tuple, counts)), dtype="float64").T
        model.edges, model.levels = pooled(SPREAD[0] + (at + 0.5) * step, total, k)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs (doc_id, text; other columns aren't read).

    An empty or null text has a score like any other; repeated rows have equal
    ones. A null id has no fold: its row isn't held out, and as it has no label
    nothing is learned from it. Without any label, scores are a half. An empty
    table gives no rows.
    """
    rows = kept(measured(docs), "measured")
    model = fit(rows, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "fold", "score"])

    scored = rows.mapInArrow(run, "doc_id bigint, fold int, score double")
    held_out = F.coalesce(F.col("fold") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
