"""Personal data with information-theoretic sanitisation, in DataFrame functions only.

Direct identifiers (e-mail, IP, card, phone) are found by pattern. Then words
that give an identifier away are found from the corpus: for an identifier e and
a word t within ``reach`` words of it (and SPREAD characters, across lines),

    disclosure = log2(P(e | t) / P(e)) / log2(1 / P(e))

is the part of e's surprisal that t takes away. P(e) is the share of distinct
texts that hold e; P(e | t) the share of those with t, anywhere, that hold e too.
Words at or above ``threshold`` with at least ``support`` distinct contexts are
reported next to that identifier. sanitise() masks identifiers, generalises such
words where most texts that have them don't hold the identifier, and removes
them elsewhere. Copies of one text or context count once, so they disclose
nothing new and hide nothing either.

Patterns are run once, into a written table; texts are read once more for the
counts of words, of which only hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import SPAN, WORD, as_text, found, joined, kept, labelled, own, spliced, whole_rows, with_text, words

# The patterns of the contract. Possessive forms and the start
# conditions change no match; they keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

RANKS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "term": 4}
REACH, SUPPORT, THRESHOLD, SPREAD = 5, 3, 0.8, 200
#: What stands in sanitised text for an identifier, and for a disclosing word that is common elsewhere.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[WORD]"}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(d: Column, i: Column) -> Column:
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), ""), weight)
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def base_parts(text: Column) -> dict[str, Column]:
    n = lambda s: F.length(_digits(s["hit"]))
    return {
        "email": found(text, EMAIL, text.contains("@")),
        "ip": F.filter(found(text, IP), lambda s: s["hit"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(found(text, CARD), lambda s: F.when(n(s).between(13, 19), _luhn(_digits(s["hit"]))).otherwise(False)),
        "phone": F.filter(found(text, PHONE, text.contains("+")), lambda s: n(s).between(9, 15)),
    }


def _hits() -> Column:
    named = lambda kind: F.transform(F.col(kind), lambda s: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("begin"), s["begin"], F.lit("stop"), s["stop"], F.lit("hit"), s["hit"]))
    return F.concat(*(named(k) for k in RANKS if k != "term"))


def scanned(rows: DataFrame) -> DataFrame:
    """doc_id, mark, email, ip, card, phone (spans), text: a written table; the text only where there are spans."""
    kinds = base_parts(F.col("text"))
    parts = rows.select("doc_id", "mark", *(c.alias(k) for k, c in kinds.items()), "text")
    none = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") == 0
    return kept(parts.withColumn("text", F.when(~none, F.col("text"))), "personal")


def context_words(held: DataFrame, reach: int) -> DataFrame:
    """doc_id, mark, entity, context, term, begin, stop: the words around each identifier."""
    text = F.col("text")
    each = held.select("doc_id", "mark", "text", F.explode(_hits()).alias("s"))
    begin, stop = F.col("s.begin").cast("int"), F.col("s.stop").cast("int")
    at = F.greatest(begin - SPREAD, F.lit(0))
    before, after = F.substring(text, at + 1, begin - at), F.substring(text, stop + 1, F.lit(SPREAD))
    each = each.select("doc_id", "mark", F.concat_ws(":", "s.kind", F.lower("s.hit")).alias("entity"), at.alias("at"), stop.alias("stop"), (F.length("text") - stop > SPREAD).alias("more"), before.alias("before"), after.alias("after"))
    # A word that the edge may cut is left out.
    left = F.filter(found(F.col("before"), WORD), lambda s: (F.col("at") == 0) | (s["begin"] > 0))
    right = F.filter(found(F.col("after"), WORD), lambda s: ~F.col("more") | (s["stop"] < SPREAD))
    each = each.select("doc_id", "mark", "entity", left.alias("l"), right.alias("r"), "at", "stop")
    shift = lambda spans, by: F.transform(spans, lambda s: F.struct((s["begin"] + by).alias("begin"), (s["stop"] + by).alias("stop"), s["hit"].alias("hit")))
    last = F.slice("l", F.greatest(F.size("l") - reach + 1, F.lit(1)), F.lit(reach))
    near = F.concat(shift(last, F.col("at")), shift(F.slice("r", 1, reach), F.col("stop"))).cast(f"array<{SPAN}>")
    each = each.select("doc_id", "mark", "entity", near.alias("near"))
    context = F.array_join(F.transform("near", lambda s: F.lower(s["hit"])), " ")
    each = each.select("doc_id", "mark", "entity", F.xxhash64(context).alias("context"), F.explode("near").alias("s"))
    each = each.select("doc_id", "mark", "entity", "context", F.lower("s.hit").alias("term"), F.col("s.begin").alias("begin"), F.col("s.stop").alias("stop"))
    return each.where(~F.col("term").rlike("[0-9@]"))


def disclosing(rows: DataFrame, parts: DataFrame, near: DataFrame, support: int, threshold: float) -> DataFrame:
    """entity, term, common: the words that give an identifier away, from counts over all distinct texts.

    Texts with identifiers are counted first: a word that already stands in too
    many of them can't reach the threshold, so only the few others are looked
    for in all texts. common: most of the distinct texts with the word don't
    hold the identifier.
    """
    held = parts.where(F.col("text").isNotNull())
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("n_contexts")).where(F.col("n_contexts") >= support)
    pairs = kept(pairs.select("entity", "term", F.xxhash64("term").alias("word")), "pairs")
    holders = held.select("mark", F.explode(_hits()).alias("s")).select(F.concat_ws(":", "s.kind", F.lower("s.hit")).alias("entity"), "mark").distinct()
    with_entity = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = parts.select("mark").distinct().agg(F.count(F.lit(1)).alias("n"))
    said = lambda some: some.select("mark", F.explode(F.array_distinct(words(F.lower("text")))).alias("term")).select("mark", F.xxhash64("term").alias("word"))
    few = said(held).join(pairs.select("word").distinct(), "word", "left_semi").distinct()
    n_held = few.groupBy("word").agg(F.count(F.lit(1)).alias("n_held"))
    # A text's words meet its own identifiers, so a frequent identifier doesn't meet all its words in all texts.
    both = few.join(holders.join(pairs.select("entity").distinct(), "entity", "left_semi"), "mark").join(pairs, ["entity", "word"])
    n_both = both.groupBy("entity", "term", "word").agg(F.count(F.lit(1)).alias("n_both"))
    surprisal = F.log2(F.col("n") / F.col("n_entity"))
    discloses = lambda n_term: (F.col("n_entity") < F.col("n")) & (F.log2(F.least(F.lit(1.0), F.col("n_both") / n_term)) + surprisal >= threshold * surprisal)
    # Written, so that Spark knows the size: a small table is sent to the texts, a large one is shuffled with their words.
    may = kept(n_both.join(with_entity, "entity").join(n_held, "word").crossJoin(F.broadcast(total)).where(discloses(F.col("n_held"))), "candidates")
    n_term = said(rows).join(may.select("word").distinct(), "word", "left_semi").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_term"))
    return may.join(n_term, "word").where(discloses(F.col("n_term"))).select("entity", "term", (F.col("n_term") > 2 * F.col("n_both")).alias("common"))


def find_personal(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, mark, n_email, n_ip, n_card, n_phone, base, all, common: one row for each row of docs.

    base and all are arrays of struct<begin, rank, stop, kind> with code point
    offsets; all adds the disclosing terms; common has the begins of those terms
    that are common elsewhere. A null text counts as empty. Null ids are values
    like any other; repeated rows give repeated results; an empty table gives no
    rows; only doc_id and text are read. Hot identifiers or terms are counted
    with map-side sums and never gathered.
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    parts = scanned(rows)
    held = parts.where(F.col("text").isNotNull())
    near = context_words(held, reach)
    term = F.struct("begin", F.lit(RANKS["term"]).alias("rank"), "stop", F.lit("term").alias("kind"))
    terms = near.join(disclosing(rows, parts, near, support, threshold), ["entity", "term"]).groupBy("doc_id", "mark").agg(F.collect_set(term).alias("terms"), F.collect_set(F.when(F.col("common"), F.col("begin"))).alias("common"))
    kinds = [k for k in RANKS if k != "term"]
    base = F.concat(*(labelled(F.col(k), k, RANKS[k]) for k in kinds))
    strong = parts.select("doc_id", "mark", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), base.alias("base"))
    on = strong["doc_id"].eqNullSafe(terms["doc_id"]) & (strong["mark"] == terms["mark"])
    both = F.when(terms["terms"].isNull(), strong["base"]).otherwise(F.concat(strong["base"], terms["terms"]))
    return strong.join(terms, on, "left").select(strong["*"], both.alias("all"), F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data masked and disclosing terms generalised or removed; all rows and columns stay.

    A term that discloses one identifier and is common elsewhere is generalised
    to MASKS["term"]; another is removed. Overlapping spans are replaced as one.
    A null text stays null; n_chars, where present, follows a changed text.
    """
    mask = F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv))
    put = lambda s: F.when((s["kind"] == "term") & ~F.array_contains("common", s["begin"]), F.lit("")).otherwise(F.element_at(mask, s["kind"]))
    hide = F.transform("all", lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), put(s).alias("put")))
    hits = find_personal(docs, **options).where(F.size("all") > 0).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), hide.alias("hide")).dropDuplicates(["of_id", "of_mark"])
    rows = whole_rows(docs, "text").join(hits, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    return with_text(rows, docs.columns, spliced(F.col("row.text"), F.col("hide")), F.col("hide").isNotNull())


def digest(found_: DataFrame) -> DataFrame:
    return found_.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base"), True), 256).alias("base_sha256"), joined(F.col("all"), True).alias("spans"))
