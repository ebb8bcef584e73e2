"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each text is judged by itself first (words, symbols, repeated lines, repeated
8-word windows). Then lines are counted over the whole corpus: a line found in
more than ``share`` of a host's distinct documents (and in more than ``least``
of them) is boilerplate there; a document of whose words under ``keep_percent``
are left without such lines is depleted and is rejected.

Exact copies of one document must not make its lines look like boilerplate, so
a host's documents are counted by their signature, a hash of the whole text as
lines are compared.
Only hashes and counts of lines are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import WORD, as_text, kept, own, whole_rows, with_text, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SHARE, LEAST, KEEP_PERCENT = 0.05, 20, 30


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(w: Column) -> Column:
    """A hash for each window of eight words, by doubling: pairs, fours, eights."""
    none = F.array().cast("array<bigint>")

    def doubled(shift: int):
        def body(a: Column) -> Column:
            n = F.size(a) - shift
            both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))
            return F.when(n > 0, both).otherwise(none)

        return body

    h = F.transform(w, lambda x: F.xxhash64(x))
    for shift in (1, 2, 4):
        h = bound(h, doubled(shift))
    return h


def repeated_words(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        none = F.array(F.lit(None).cast("bigint"))
        hashes = F.transform(s, lambda x: x["h"])
        before = F.concat(none, F.slice(hashes, F.lit(1), n - 1))
        after = F.concat(F.slice(hashes, F.lit(2), n - 1), none)
        zipped = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
        twice = F.filter(zipped, lambda x: F.coalesce(x["s"]["h"] == x["b"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["a"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda x: x["s"]["i"]))
        # Each window adds what the next one doesn't cover.
        return bound(
            at,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda acc, x: acc + x,
            ),
        )

    indexed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(indexed, covered)).otherwise(F.lit(0))


def text_measures(docs: DataFrame) -> DataFrame:
    """The measures of each text by itself. docs: doc_id, mark, text."""
    text = F.col("text")
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    symbols = F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).otherwise(F.lit(0))
    first = docs.select(
        "doc_id",
        "mark",
        words(text).alias("w"),
        symbols.cast("long").alias("n_symbols"),
        bound(filled, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    )
    second = first.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", bound(window_hashes(F.col("w")), repeated_words).cast("long").alias("n_repeat_words"))
    n = F.col("n_words")
    return second.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark, host, signature, pos, line (a hash), n (its words): each line with a word."""
    text = F.col("text")
    low = F.lower(text)
    even = F.btrim(F.when(text.rlike("[\t\x0b\x0c\r]|  "), F.regexp_replace(low, "[ \t\x0b\x0c\r]+", " ")).otherwise(low))
    # In two steps: what stands beside an explode is computed again for each of its rows.
    whole = docs.select("doc_id", "mark", "host", F.xxhash64(even).alias("signature"), F.split(even, " ?\n ?").alias("lines"))
    cut = whole.select("doc_id", "mark", "host", "signature", F.posexplode("lines").alias("pos", "line"))
    return cut.where(F.col("line") != "").select("doc_id", "mark", "host", "signature", "pos", F.xxhash64("line").alias("line"), F.size(F.split("line", " ")).alias("n"))


def common_lines(lines: DataFrame, share: float, least: int) -> DataFrame:
    """host, line: the lines above the limit of their host."""
    each = lines.select("host", "signature", "line").distinct()
    hosts = each.select("host", "signature").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return counts.join(hosts, "host").where(F.col("n") > share * F.col("docs")).select("host", "line")


def _judged(docs: DataFrame, share: float, least: int, keep_percent: int) -> DataFrame:
    rows = own(docs, "doc_id", "text", "source").withColumn("text", as_text(F.col("text")))
    rows = rows.select("doc_id", "text", F.xxhash64("source").alias("host"), F.xxhash64("text", "source").alias("mark"))
    lines = kept(lines_of(rows), "lines")  # read by three branches, computed once
    common = common_lines(lines, share, least)
    removed = lines.join(common, ["host", "line"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    m = text_measures(rows)
    both = m.join(removed, m["doc_id"].eqNullSafe(removed["doc_id"]) & (m["mark"] == removed["mark"]), "left").select(m["*"], "gone")
    n_gone = F.aggregate("gone", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    left = (F.col("n_words") - F.coalesce(n_gone, F.lit(0))).cast("long")
    out = both.select(*m.columns, left.alias("n_left_words"), F.transform("gone", lambda x: x["pos"]).alias("gone"))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_left_words") >= keep_percent * F.col("n_words")))


def judge_quality(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """doc_id, mark, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, kept.

    One row for each row of docs (doc_id, text, source; others are not read). A
    null text counts as empty: no words, so it fails. A null source is a host of
    its own. Repeated rows give repeated results. An empty table gives no rows.
    Lines are compared lower-cased and trimmed, with runs of white space as one
    space. mark is a hash of text and source; rows alike in doc_id and mark have
    the same verdict.
    """
    return _judged(docs, share, least, keep_percent).drop("gone")


def clean_good(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The rows of docs that are kept, with the lines above their host's limit cut from the text.

    Columns stay as they are, whatever their names; n_chars, where present,
    follows a changed text. Verdicts are those of judge_quality().
    """
    good = _judged(docs, share, least, keep_percent).where("kept").select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "gone").dropDuplicates(["of_id", "of_mark"])
    rows = whole_rows(docs, "text", "source").join(good, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    return with_text(rows, docs.columns, _without(F.col("row.text"), F.col("gone")), F.col("gone").isNotNull())


def _without(text: Column, gone: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    good = judge_quality(docs, **limits).where("kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    on = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(as_text(docs["text"]), docs["source"]) == good["_mark"])
    return docs.join(good, on, "left_semi")


def without_common_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """docs with the lines above their host's limit cut from the text; all rows and columns stay, a null text stays null.

    n_chars, where present, follows the new text.
    """
    rows = own(docs, "doc_id", "text", "source").withColumn("text", as_text(F.col("text")))
    rows = rows.select("doc_id", "text", F.xxhash64("source").alias("host"), F.xxhash64("text", "source").alias("mark"))
    lines = kept(lines_of(rows), "lines")
    common = common_lines(lines, share, least)
    gone = lines.join(common, ["host", "line"]).groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.collect_set("pos").alias("gone"))
    rows = whole_rows(docs, "text", "source").join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    return with_text(rows, docs.columns, _without(F.col("row.text"), F.col("gone")), F.col("gone").isNotNull())
