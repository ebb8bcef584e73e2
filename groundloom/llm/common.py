"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.lineage import released

#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table by its path; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder named by spark.checkpoint.dir. Where it is unset, only a local session may use a folder of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, in the folder the cluster names."""
    _checkpoint_folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, as a plan keeps the setting it was made under


def own(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with working names."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def as_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text. Rare blanks are looked for first, so that most texts are cut by a single character."""
    blanks = F.when(text.rlike("[\t\x0b\x0c\r]"), F.translate(text, BLANK, " " * len(BLANK))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(blanks, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


SPAN = "struct<begin:bigint,stop:bigint,hit:string>"


def found(text: Column, pattern: str, where: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with code point offsets (stop exclusive).

    What lies between matches (split) and the matches themselves alternate, so
    their lengths add up to the offsets. where: a cheap test that the text may
    match at all.
    """
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        one = F.struct(begin.cast("long").alias("begin"), stop.cast("long").alias("stop"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(stop.cast("long").alias("at"), F.concat(acc["all"], F.array(one)).alias("all")))

    spans = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("all")), step, lambda acc: acc["all"])
    test = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    return F.when(test, spans).otherwise(none)


def labelled(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def joined(spans: Column, by_rank: bool = False) -> Column:
    """kind:begin:stop, comma-joined, by begin then kind, or by kind then begin."""
    order = ("rank", "begin") if by_rank else ("begin", "rank")
    keyed = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in order), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")


def whole_rows(docs: DataFrame, *mark: str) -> DataFrame:
    """row (all columns), id, mark (a hash of the named columns): whatever docs' columns are called, they can't clash."""
    values = [as_text(F.col("text")) if c == "text" else F.col(f"`{c}`") for c in mark]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*values).alias("mark"))


def with_text(rows: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of each row, with text where it has changed; n_chars, where present, follows the new text."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    old = {c: F.col("row").getField(c) for c in columns}
    return rows.select(*(F.when(changed, new[c]).otherwise(old[c]).alias(c) if c in new else old[c].alias(c) for c in columns))


def spliced(text: Column, spans: Column) -> Column:
    """text with each span (begin, stop, put) replaced by put; of overlapping spans the first by begin gives put."""

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["put"].alias("put"))
        meets = (F.size(acc) > 0) & (s["begin"] < last["stop"])
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    none = F.array().cast("array<struct<begin:bigint,stop:bigint,put:string>>")
    one = F.transform(spans, lambda s: F.struct(s["begin"].cast("long").alias("begin"), s["stop"].cast("long").alias("stop"), s["put"].alias("put")))
    apart = F.aggregate(F.array_sort(one), none, lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(join(acc, s)))

    def cut_up(a: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), F.transform(a, lambda s: s["stop"]))
        piece = lambda s, i: F.concat(F.substring(text, (F.get(before, i) + 1).cast("int"), (s["begin"] - F.get(before, i)).cast("int")), s["put"])
        return F.concat(F.array_join(F.transform(a, piece), ""), F.substring(text, (F.element_at(before, -1) + 1).cast("int"), F.length(text)))

    return F.get(F.transform(F.array(apart), cut_up), F.lit(0))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, then what the worker has freed goes back to the system: workers live on between tasks and stages."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the checkpoint folder, which all executors share: a cut of lineage that is smaller than a checkpoint."""
    spark = df.sparkSession
    _checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
