"""Repeated line runs by a suffix array over line-ID sequences.

Every document is the sequence of its lines that are not blank (white space at both ends does not count). The suffixes of
all sequences are ranked by distributed prefix doubling: the rank of a suffix by its first h lines and the rank of the
suffix h lines further on give its rank by 2h lines. A round groups the pairs of ranks with partial aggregation, sorts
the different pairs by range, and turns running sums of their counts into ranks; no rank is ever computed in one place.
The last round overlaps, so doubling ends at exactly `min_lines`.

Suffixes with one rank at that depth form an interval of the suffix array with a longest common prefix of `min_lines` or
more, that is all copies of one run of lines. The copy in the smallest doc_id (then row, then line) is the first;
the lines of all later copies are deleted. Copies that start in consecutive lines merge into maximal runs, so deeper ranks
would not change what is deleted, and doubling stops there.

A run of one line counts too if the line has `LONE_WORDS` words or more: of equal long lines, known by
their hash, all but the first go. Shorter lines need `min_lines`.

Cases: null and empty texts have no lines; documents of fewer than `min_lines` lines only have runs of
one line; blank lines are kept;
null doc_ids come last; rows that repeat a doc_id are rows of their own, so the second of two equal rows loses its runs.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoicelake.llm.words import mapped
from invoicelake.session import staged

MIN_LINES = 2
LONE_WORDS = 10
BLANKS = " \t\r\x0b\x0c"
BLANK = "[ \\t\\r\\x0B\\x0C]+"
#: A word is a run of visible characters; those of scripts written without white space are words of their own.
WORD = "[\\u3000-\\u9FFF]|[^ \\t\\r\\x0B\\x0C\\u3000-\\u9FFF]+"


def line_ids(text: Column) -> Column:
    """(line, lone): hashes of the lines that are not blank, and if a line is a run by itself."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, f"^{BLANK}|{BLANK}$", ""))
    return F.transform(F.filter(stripped, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(WORD)) >= LONE_WORDS).alias("lone")))


def ranked(pairs: DataFrame) -> DataFrame:
    """(a, b, rank): for every different pair the number of rows with a smaller pair."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(pairs.groupBy("a", "b").count(), "pairs")
    ranges = staged(counts.repartitionByRange(parts, "a", "b").withColumn("part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in ranges.groupBy("part").agg(F.sum("count").alias("n")).orderBy("part").collect():  # one row per partition
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    running = F.sum("count").over(Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.withColumn("running", running).join(offsets, "part").select("a", "b", (F.col("before") + F.col("running") - F.col("count")).alias("rank"))


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """(row, pos, left, rank): suffixes ranked by their first `depth` lines. `lines` has row, pos, left, line."""
    state = lines.select("row", "pos", "left", F.col("line").alias("a"), F.lit(0).cast("long").alias("b"))
    known = 1
    while True:
        state = staged(state.join(ranked(state), ["a", "b"]).select("row", "pos", "left", "rank"), "ranks")
        if known >= depth:
            return state
        step = min(known, depth - known)
        further = F.lead("rank", step).over(Window.partitionBy("row").orderBy("pos"))  # within one document
        state = staged(state.select("row", "pos", "left", F.col("rank").alias("a"), F.coalesce(further, F.lit(-1)).alias("b")), "pairs")
        known += step


def later_copies(docs: DataFrame, min_lines: int) -> DataFrame:
    """(row, check, starts): for every row with later copies of runs, where they start and their lines. `docs` has row."""
    sequences = staged(docs.select("row", F.col("doc_id").alias("doc"), F.xxhash64("text").alias("check"), line_ids(F.col("text")).alias("ids")), "lines")
    lines = sequences.select("row", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "id")).select("row", "pos", (F.col("n") - F.col("pos")).alias("left"), "id.line", "id.lone")
    suffixes = suffix_ranks(lines, min_lines).where(F.col("left") >= min_lines).select("row", "pos", F.lit(min_lines).alias("size"), "rank")
    if min_lines > 1:  # a long line is a run of size 1, known by its hash
        suffixes = suffixes.union(lines.where("lone").select("row", "pos", F.lit(1), "line"))
    intervals = suffixes.groupBy("size", "rank").count().where("count > 1").select("size", "rank")
    copies = suffixes.join(intervals, ["size", "rank"]).join(sequences.select("row", "doc"), "row").withColumn(
        "place", F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "pos"))
    copies = staged(copies.select("size", "rank", "row", "pos", "place"), "copies")
    firsts = copies.groupBy("size", "rank").agg(F.min("place").alias("first"))
    later = copies.join(firsts, ["size", "rank"]).where("not (place <=> first)").groupBy("row").agg(F.collect_list(F.struct("pos", "size")).alias("starts"))
    return later.join(sequences.select("row", "check"), "row")


def without_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines (not blank), n_removed, removed (numbers of lines), text (what is left)."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = later_copies(rows, min_lines)
    same = F.col("check").isNull() | F.col("check").eqNullSafe(F.xxhash64("text"))
    starts = F.when(same, F.col("starts")).otherwise(F.raise_error(F.lit("the documents changed between two scans")))
    joined = rows.join(found, "row", "left").select("doc_id", "text", starts.alias("starts"))

    def run(batches):
        for batch in batches:
            counts, gone, texts = [], [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                full = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
                out = [full[i] for i in sorted({k for s in at or [] for k in range(s["pos"], s["pos"] + s["size"])})]
                drop = set(out)
                counts.append(len(full))
                gone.append(out)
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([len(g) for g in gone], pa.int64()),
                                              pa.array(gone, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "removed", "text"])

    kind = f"doc_id {dict(docs.select('doc_id').dtypes)['doc_id']}, n_lines long, n_removed long, removed array<int>, text string"
    return mapped(joined, run, kind)
