"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only.

Each input partition is a run: its texts as (digest, smallest id, count), one entry per different text. In round l the
runs that differ only in digit l of their number (base `fan`) exchange entries: the entry goes to the run whose digit
equals digit l of the digest, where equal digests are merged, keeping the smallest identifier and the sum of the counts.
After as many rounds as a run number has digits, every digest has met all its copies, and each run holds one slice of the
digest space, so nothing is ever gathered in one place. A group of copies, however large, is one entry per run after the
first aggregation. The answers then go back down the same tree, so the join with the rows is spread over the runs too.

Merging is verified: the key of an entry is the SHA-256 of the normalised text together with a second, independent hash
and the length, so texts that collide in one of them stay apart.

Cases: null and empty texts are equal to each other (and to nothing else); a text of white space only equals " ". Rows
that repeat a doc_id are rows of their own: of equal texts exactly one row stays, the one with the smallest doc_id (null
ids come last), the first such row if ids tie. Any other column is ignored, so extra columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import one_row_each, with_row_key
from invoicelake.session import staged

FAN = 16
KEY = ["digest", "check", "size"]


def normalized(text: Column) -> Column:
    """White space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def entries(docs: DataFrame) -> DataFrame:
    """One narrow row per document: run, row number, id and key of its text. Written once, so row numbers are settled."""
    rows = docs.select(F.col("doc_id").alias("id"), normalized(F.col("text")).alias("normal"))
    return staged(rows.select("id", F.sha2("normal", 256).alias("digest"), F.xxhash64("normal").alias("check"), F.octet_length("normal").alias("size"),
                              F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")), "digests")


def _digit(value: Column, place: int, fan: int) -> Column:
    return F.pmod(F.floor(value / F.lit(fan ** place)), F.lit(fan)).cast("long")


def merged(slots: DataFrame, by: list[str]) -> DataFrame:
    """Merge equal keys: the smallest identifier (null ids last, then the first row) and the number of rows."""
    return slots.groupBy(*by).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def groups(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """For every (run, key): the identifier that stays and the size of the whole group."""
    runs = rows.agg(F.max("run").alias("n")).first()["n"]
    rounds = max(1, math.ceil(math.log(max(2, (runs or 0) + 1), fan) - 1e-9))
    best = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    level = merged(rows.select(*KEY, F.col("run").cast("long").alias("slot"), best.alias("best"), F.lit(1).alias("n")), ["slot", *KEY])
    tree = [staged(level, "run")]
    for l in range(rounds):
        own, wanted = F.col("slot"), F.pmod(F.col("check"), F.lit(fan ** rounds))
        move = own + (_digit(wanted, l, fan) - _digit(own, l, fan)) * F.lit(fan ** l)
        tree.append(staged(merged(tree[-1].withColumn("slot", move), ["slot", *KEY]), "run"))
    answers = tree[-1].select("slot", *KEY, F.col("best").alias("stays"), F.col("n").alias("group_size"))
    for l in reversed(range(rounds)):
        own, wanted = F.col("slot"), F.pmod(F.col("check"), F.lit(fan ** rounds))
        move = own + (_digit(wanted, l, fan) - _digit(own, l, fan)) * F.lit(fan ** l)
        below = tree[l].select(F.col("slot").alias("below"), *KEY, move.alias("slot"))
        answers = below.join(answers, ["slot", *KEY]).select(F.col("below").alias("slot"), *KEY, "stays", "group_size")
    return answers.withColumnRenamed("slot", "run")


def exact_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = entries(docs)
    joined = rows.withColumn("run", F.col("run").cast("long")).join(groups(rows, fan), ["run", *KEY])
    return joined.select(F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                         (F.col("stays.row") == F.col("row")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Decided on a written table of digests; a row is known in it by doc_id and a hash of both doc_id and text, and of rows equal
    in these any one stays.
    """
    keyed, key = with_row_key(docs)
    rows = keyed.select(F.col("doc_id").alias("id"), normalized(F.col("text")).alias("normal"), F.col(key).alias("key")).select(
        "id", F.sha2("normal", 256).alias("digest"), F.xxhash64("normal").alias("check"), F.octet_length("normal").alias("size"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), "key")
    rows = staged(rows, "digests")
    winners = groups(rows, fan).select("stays.row").distinct()
    chosen = staged(rows.join(winners, "row", "left_semi").select(F.col("id").alias("doc_id"), F.col("key").alias(key)), "chosen")
    repeated = staged(rows.groupBy(F.col("id").alias("doc_id"), F.col("key").alias(key)).count().where("count > 1"), "repeated")
    return one_row_each(keyed, chosen, repeated, key).select(*docs.columns)
