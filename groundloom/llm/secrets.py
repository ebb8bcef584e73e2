"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts (assigned secrets, access identifiers, long hex runs) are always
reported. Weak parts (a named account, a mixed token, an endpoint) are reported
only where complementary parts co-occur within ``scope`` characters:

* a weak token needs an identifier (named account or access identifier);
* a named account needs a secret (token, assigned secret or hex run);
* an endpoint needs both.

The interval join is an equi-join on scope-wide bins. Each bin holds, for each
role, the first and last start, so a part meets at most three rows whatever the
number of parts in the document, and no pair of parts is ever made. Two parts
co-occur exactly if their starts differ by at most ``scope``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, every, found, joined, labelled, own, spliced, whole_rows, with_text

# The patterns of the contract, spelled without flags so that every engine reads them alike.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
ACCOUNT = r"([cC]lient_?[iI][dD]|CLIENT_?ID|[uU]ser_?[nN]ame|USER_?NAME|[lL]ogin|[aA]ccount_?[iI][dD])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"

ROLES = {"assign": "secret", "hex": "secret", "token": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
RANKS = {k: i for i, k in enumerate(("assign", "access", "hex", "account", "token", "endpoint"))}
SCOPE = 200


def _mixed(hit: Column) -> Column:
    return hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")


def base_parts(text: Column) -> dict[str, Column]:
    """The strong parts, by kind. Assigned secrets of under 6 characters are dropped."""
    return {
        "assign": F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6),
        "access": F.filter(found(text, ACCESS, text.contains("AKIA")), lambda s: s["stop"] - s["begin"] >= 20),
        "hex": found(text, HEX),
    }


def weak_parts(text: Column) -> dict[str, Column]:
    return {
        "account": found(text, ACCOUNT),
        "token": F.filter(found(text, TOKEN), lambda s: _mixed(s["hit"])),
        "endpoint": found(text, ENDPOINT, text.contains("://")),
    }


def linked_parts(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, mark, weak: the weak parts with their complements nearby.

    docs has doc_id, mark (a hash of the text) and text. Rows alike in both keys
    give one row.
    """
    text = F.col("text")
    may = every([text.rlike(ACCOUNT) | text.contains("AKIA"), text.rlike(ASSIGN) | text.rlike(HEX) | text.rlike(TOKEN)])
    kinds = {**base_parts(text), **weak_parts(text)}
    one = F.concat(*(labelled(c, k, RANKS[k]) for k, c in kinds.items()))
    parts = docs.where(may).select("doc_id", "mark", F.explode(one).alias("s")).select("doc_id", "mark", "s.*")
    parts = parts.withColumn("bin", F.floor(F.col("begin") / scope)).withColumn("role", F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")])
    of = lambda role: F.when(F.col("role") == role, F.col("begin"))
    bins = parts.groupBy("doc_id", "mark", "bin").agg(
        *(f(of(r)).alias(f"{r}_{n}") for r in ("secret", "identifier") for n, f in (("first", F.min), ("last", F.max)))
    )
    weak = parts.where(F.col("kind").isin("account", "token", "endpoint")).distinct()
    near = weak.withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).alias("w")
    same = every([F.col("w.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("w.mark") == F.col("b.mark"), F.col("w.at") == F.col("b.bin")])
    meets = near.join(bins.alias("b"), same)
    # In the bin before, the last start counts; in the bin after, the first; in its own, any.
    close = lambda r: (
        F.when(F.col("w.at") < F.col("w.bin"), F.col("w.begin") - F.col(f"{r}_last") <= scope)
        .when(F.col("w.at") > F.col("w.bin"), F.col(f"{r}_first") - F.col("w.begin") <= scope)
        .otherwise(F.col(f"{r}_first").isNotNull())
    )
    keys = [F.col(f"w.{c}").alias(c) for c in ("doc_id", "mark", "begin", "rank", "stop", "kind")]
    seen = meets.groupBy(*keys).agg(*(F.coalesce(F.max(close(r)), F.lit(False)).alias(r) for r in ("secret", "identifier")))
    wanted = (
        F.when(F.col("kind") == "account", F.col("secret"))
        .when(F.col("kind") == "token", F.col("identifier"))
        .otherwise(F.col("secret") & F.col("identifier"))
    )
    return seen.where(wanted).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "rank", "stop", "kind")).alias("weak"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, mark, n_assign, n_access, n_hex, base, all: one row for each row of docs.

    base and all are arrays of struct<begin, rank, stop, kind> with code point
    offsets. A null text counts as empty and has no spans. A null doc_id is a
    value like any other. Repeated rows give repeated results. An empty table
    gives no rows. Columns other than doc_id and text are not read. In a group
    of copies each copy is scanned by itself, so no group is ever gathered;
    ties in begin are ordered by kind.
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    text = F.col("text")
    strong = rows.select("doc_id", "mark", *(c.alias(k) for k, c in base_parts(text).items()))
    base = F.concat(*(labelled(F.col(k), k, RANKS[k]) for k in ("assign", "access", "hex")))
    strong = strong.select("doc_id", "mark", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base"))
    weak = linked_parts(rows, scope)
    on = strong["doc_id"].eqNullSafe(weak["doc_id"]) & (strong["mark"] == weak["mark"])
    both = F.when(weak["weak"].isNull(), strong["base"]).otherwise(F.concat(strong["base"], weak["weak"]))
    return strong.join(weak, on, "left").select(strong["*"], both.alias("all"))


def digest(found_: DataFrame) -> DataFrame:
    return found_.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans")
    )


def redact_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret of the text replaced by mask; all rows and columns stay.

    Overlapping spans are replaced as one. n_chars, where present, follows the
    new text; a null text stays null. An endpoint is context, not a secret, and
    stays in the text.
    """
    hide = F.transform(F.filter(F.col("all"), lambda s: s["kind"] != "endpoint"), lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), F.lit(mask).alias("put")))
    hits = scan_secrets(docs, scope).where(F.size(hide) > 0).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), hide.alias("hide")).dropDuplicates(["of_id", "of_mark"])
    rows = whole_rows(docs, "text").join(hits, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    return with_text(rows, docs.columns, spliced(F.col("row.text"), F.col("hide")), F.col("hide").isNotNull())
