"""Byte-pair encoding and decoding as streaming transducers.

The tokens of a prefix are fixed by its last token and the prefix before that,
so one token is kept for each position: the one that ends there in the encoding
of the text so far. Of the vocabulary's entries that end at a position exactly
one goes with the token before it, that is, the two together encode to
themselves. No entry is longer than ``lookahead`` bytes, so only the chains from
the last ``lookahead`` positions can still matter: tokens that all of them share
are stable and are emitted, and the positions before them are forgotten.

Texts are first split at special tokens and into pre-tokens, whose encodings
are kept in a cache of bounded size. Decoding puts the tokens' bytes through an
incremental UTF-8 decoder, a few thousand tokens at a time.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import tidy

#: Entries of each cache, bytes fed at a time, rows of a batch, places told apart in a pre-token.
CACHE, PIECE, ROWS, NEAR = 300_000, 4096, 256, 24
#: Ends of tokens kept for each place; fewer would be worked out again and again.
ENDS = 16_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def letter_classes(top: int) -> tuple[str, str, str]:
    """Regular expression classes of letters, numbers and white space up to a code point, from the character database."""

    def ranges(test) -> str:
        out, start = [], None
        for c in range(top + 2):
            inside = c <= top and test(chr(c))
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    return (
        ranges(lambda c: unicodedata.category(c)[0] == "L"),
        ranges(lambda c: unicodedata.category(c)[0] == "N"),
        ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f"),
    )


def token_bytes(data: dict) -> dict[int, bytes]:
    letters = byte_letters()
    table = {i: bytes(map(letters.__getitem__, t)) for t, i in data["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


def pieces(top: int) -> re.Pattern:
    letter, number, space = letter_classes(top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """What a byte-level vocabulary file of the tokenizers library says."""

    above = (re.compile("[\u0100-\U0010ffff]"), re.compile("[\U00010000-\U0010ffff]"))

    def split(self, text: str) -> list[str]:
        small, middle = self.above
        pattern = 0 if not small.search(text) else 1 if not middle.search(text) else 2
        return self.patterns[pattern].findall(text)

    def __init__(self, source: str):
        data = json.loads(source)
        letters = byte_letters()
        raw = lambda token: bytes(map(letters.__getitem__, token))
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = token_bytes(data)
        self.lookahead = max(map(len, self.ids))
        # Small classes are tested by table, so texts of the first 256 or 65536 characters have patterns of their own.
        self.patterns = [pieces(top) for top in (0xFF, 0xFFFF, sys.maxunicode)]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


def merged(text: bytes, ranks: dict) -> list[bytes]:
    """Encodes by the merge list, step by step: the definition, for short strings."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merge(token: bytes, ranks: dict) -> tuple[int, bytes, bytes] | None:
    """Rank and sides of the merge that ends the token's own encoding; None where it has none."""
    parts = [token[i : i + 1] for i in range(len(token))]
    best = None
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            return None
        best = (rank, parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return best


class Encoder:
    """feed() takes bytes and gives the ids that are stable; close() gives the rest.

    Inside, a token is its place in the list of tokens that encode to themselves.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.most, self.never = vocabulary.lookahead, len(vocabulary.ranks)
        made = {t: last_merge(t, vocabulary.ranks) for t in sorted(vocabulary.ids, key=len)}
        tokens = [t for t, m in made.items() if m or len(t) == 1]
        self.place = {t: i for i, t in enumerate(tokens)}
        self.ids = [vocabulary.ids[t] for t in tokens]
        self.sizes_of = [len(t) for t in tokens]
        self.ranks = {self.place[a] << 20 | self.place[b]: r for (a, b), r in vocabulary.ranks.items() if a in self.place and b in self.place}
        # What stands at a token's right and left edge from its single byte up, each with the rank that takes it in.
        self.right: list[tuple] = []
        self.left: list[tuple] = []
        for i, t in enumerate(tokens):
            if m := made[t]:
                a, b = self.place[m[1]], self.place[m[2]]
                self.right.append((*self.right[b][:-1], (b, m[0]), (i, self.never)))
                self.left.append((*self.left[a][:-1], (a, m[0]), (i, self.never)))
            else:
                self.right.append(((i, self.never),))
                self.left.append(((i, self.never),))
        # Lengths of the tokens with the same last bytes, longest first; and those of them that fit, by place.
        sizes: dict[bytes, set[int]] = {}
        for t in tokens:
            sizes.setdefault(t[-3:], set()).add(len(t))
        self.sizes = sizes
        self.fitting: list[dict[bytes, tuple]] = [{} for _ in range(NEAR + 1)]
        self.known: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.text, self.heads, self.before = b"", [], -1  # from the last emitted token on

    def goes(self, left: int, right: int) -> bool:
        """True if no merge joins the two before both are whole.

        Of the edges, the one with the lower rank is taken in first; with equal
        ranks, which only a run of one token gives, the leftmost merge is first.
        """
        ranks, never = self.ranks, self.never
        xs, ys = self.right[left], self.left[right]
        i = j = 0
        while True:
            (x, p), (y, q) = xs[i], ys[j]
            joins = ranks.get(x << 20 | y, never)
            if joins < p and joins <= q and joins != never:
                return False
            if p == q == never:
                return True
            if p <= q:
                i += 1
            else:
                j += 1

    def lengths(self, end: bytes, stop: int) -> tuple[int, ...]:
        """How long a token that ends with these (up to three) bytes at stop may be, longest first."""
        found = set().union(*(self.sizes.get(end[-n:], ()) for n in (1, 2, 3)))
        return tuple(sorted((n for n in found if n <= stop or stop >= NEAR), reverse=True))

    def feed(self, more: bytes) -> list[int]:
        at, self.text = len(self.text), self.text + more
        text, heads, place, known = self.text, self.heads, self.place, self.known
        for stop in range(at + 1, len(text) + 1):
            end = text[max(0, stop - 3) : stop]
            fitting = self.fitting[min(stop, NEAR)]
            sizes = fitting.get(end)
            if sizes is None:
                if len(fitting) >= ENDS:
                    fitting.clear()
                sizes = fitting[end] = self.lengths(end, stop)
            for n in sizes:
                begin = stop - n
                if begin < 0 or (token := place.get(text[begin:stop])) is None:
                    continue
                left = heads[begin - 1] if begin else self.before
                if left >= 0:
                    pair = left << 20 | token
                    good = known.get(pair)
                    if good is None:
                        if len(known) >= CACHE:
                            known.clear()
                        good = known[pair] = self.goes(left, token)
                    if not good:
                        continue
                heads.append(token)
                break
        return self._stable()

    def _chain(self, stop: int) -> list[int]:
        """Where the tokens before stop begin and end, last first."""
        out = [stop]
        while stop > 0:
            stop -= self.sizes_of[self.heads[stop - 1]]
            out.append(stop)
        return out

    def _stable(self) -> list[int]:
        n = len(self.text)
        if n <= self.most:
            return []
        shared = set(self._chain(n))
        for stop in range(n - self.most + 1, n):
            shared &= set(self._chain(stop))
        return self._emit(max(shared))

    def _emit(self, stop: int) -> list[int]:
        out = []
        if stop:
            self.before, at = self.heads[stop - 1], stop
            while at > 0:
                token = self.heads[at - 1]
                out.append(self.ids[token])
                at -= self.sizes_of[token]
            self.text, self.heads = self.text[stop:], self.heads[stop:]
        return out[::-1]

    def close(self) -> list[int]:
        out = self._emit(len(self.text))
        self.reset()
        return out


class Pieces(dict):
    """Ids of each pre-token, as bytes of int32; bounded: when full, what wasn't used since it was last full goes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.encoder = Encoder(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is not None:
            self[piece] = out
            return out
        text, encoder = piece.encode(), self.encoder
        if (token := encoder.place.get(text)) is not None:  # it encodes to itself
            ids = [encoder.ids[token]]
        else:
            ids = []
            for i in range(0, len(text), PIECE):
                ids += encoder.feed(text[i : i + PIECE])
            ids += encoder.close()
        out = array("i", ids).tobytes()
        if len(text) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


#: What a Python worker keeps from task to task: encoders and decoding tables by vocabulary file.
_HELD: dict = {}


def _held(what: str, source: str, make):
    key = (what, hash(source), len(source))
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def encode_text(text: str, vocabulary: Vocabulary, pieces: Pieces) -> bytes:
    """Ids as bytes of int32."""
    find = vocabulary.split
    if vocabulary.marks is None:
        return b"".join([pieces[p] for p in find(text)])
    out, at = [], 0
    for mark in vocabulary.marks.finditer(text):
        out += [pieces[p] for p in find(text[at : mark.start()])]
        out.append(np.int32(vocabulary.special[mark[0]]).tobytes())
        at = mark.end()
    out += [pieces[p] for p in find(text[at:] if at else text)]
    return b"".join(out)


def decode_ids(ids: Iterable[int], table: dict[int, bytes]) -> str:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    ids, out = list(ids), []
    for i in range(0, len(ids), PIECE):
        out.append(decoder.decode(b"".join(map(table.__getitem__, ids[i : i + PIECE]))))
    out.append(decoder.decode(b"", True))
    return "".join(out)


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file, read once by the driver and sent as text; its size is that of a vocabulary, not of the data."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a worker holds of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _over(df: DataFrame, rest: list[str], reads: str, adds: str, schema, step):
    """df's columns rest, and what step makes of each small batch of the column reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = step(batch.column(reads))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, *adds.split()])

    return df.select(*(f"`{c}`" for c in rest), reads).mapInArrow(tidy(run), schema)


def _ids(texts: pa.Array, source: str) -> tuple[pa.ListArray, list[bytes]]:
    vocabulary, pieces = _held("encoder", source, lambda: ((v := Vocabulary(source)), Pieces(v)))
    each = [encode_text(t or "", vocabulary, pieces) for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(each), dtype="<i4"))), each


def _texts(ids: list[list[int]], source: str) -> pa.Array:
    table = _held("bytes", source, lambda: token_bytes(json.loads(source)))
    return pa.array([decode_ids(i, table) for i in ids], pa.string())


def _columns(df: DataFrame, *but: str) -> list[str]:
    return [c for c in df.columns if c not in but]


def _schema(df: DataFrame, rest: list[str], **more: str):
    return df.select(*(f"`{c}`" for c in rest), *(F.lit(None).cast(k).alias(c) for c, k in more.items())).schema


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a column ids, array<int>, in place of text.

    A null text counts as empty and has no ids. Rows are encoded one by one, in
    place: nothing is shuffled; repeated rows give repeated results; an empty
    table gives no rows; other columns are kept (one named ids is replaced).
    Special tokens' strings in a text are those tokens.
    """
    source, rest = _vocabulary(docs, path), _columns(docs, "text", "ids")
    return _over(docs, rest, "text", "ids", _schema(docs, rest, ids="array<int>"), lambda texts: [_ids(texts, source.value)[0]])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with a column text, decoded from ids, in their place. Null ids give an empty text."""
    source, rest = _vocabulary(rows, path), _columns(rows, "text", "ids")
    return _over(rows, rest, "ids", "text", _schema(rows, rest, text="string"), lambda ids: [_texts([i or [] for i in ids.to_pylist()], source.value)])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids, and the text decoded from them in place of the text: encode() and decode() in one pass, so one worker."""
    source, rest = _vocabulary(docs, path), _columns(docs, "text", "ids")

    def step(texts: pa.Array) -> list[pa.Array]:
        ids, each = _ids(texts, source.value)
        return [ids, _texts([np.frombuffer(x, dtype="<i4").tolist() for x in each], source.value)]

    return _over(docs, rest, "text", "ids text", _schema(docs, rest, ids="array<int>", text="string"), step)


def digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with ids and the text decoded from them."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")]


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", *digests())
