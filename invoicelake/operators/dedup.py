"""Duplicate detection with the result of one-by-one processing.

Two invoices with the same number key match when the supplier key is the same, or when date and gross total are the
same. Documents are taken in arrival order and compared with *stored* invoices only, so a duplicate never blocks a later
invoice. That makes the imported documents a greedy maximal matching: every document occupies a supplier node and an
amount node of its number key, and is imported exactly when both nodes are still free on arrival.

Nothing here pairs documents with each other, and no number key is ever gathered whole:

1. documents equal in all three keys collapse to their first one (partial aggregation); only that one can be imported;
2. number keys with few collapsed documents (at most `fold_rows`) are folded inside one row each, after one shuffle;
3. larger number keys run in rounds of plain aggregations: a document that is the first one at both its nodes is
   imported, everything its nodes touch is out, and the rest goes into the next round. Each round decides at least the
   first document of every number key, in practice most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookup import HOT_ROWS, anti_lookup, hot_keys, left_lookup, union_all

FOLD_ROWS = 256
BROADCAST_KEYS = 100_000

# A candidate: one valid document. gross_total keeps its full scale, the stored table rounds to cents.
CANDIDATE_COLUMNS = ["arrival_seq", "number_key", "supplier_key", "invoice_date", "gross_total"]
IMPORTED_COLUMNS = ["arrival_seq", "number_key", "supplier_key", "invoice_date", "stored_gross"]
_STORED = "decimal(18,2)"


def _stored_gross(gross: Column) -> Column:
    return gross.cast(_STORED)


def collapse(candidates: DataFrame) -> DataFrame:
    """One row per (number, supplier, date, gross) with the first arrival."""
    return (candidates.groupBy("number_key", "supplier_key", "invoice_date", "gross_total")
            .agg(F.min("arrival_seq").alias("arrival_seq"))
            .withColumn("stored_gross", _stored_gross(F.col("gross_total")))
            # A gross total finer than cents equals no stored one, but still occupies its rounded value.
            .withColumn("exact", F.col("gross_total") == F.col("stored_gross")))


def _fold(edges: DataFrame) -> DataFrame:
    """Imported documents of bounded number keys: one shuffle, then a fold over each key's short array."""
    item = F.struct("arrival_seq", "supplier_key", "invoice_date", "stored_gross", "exact")
    groups = edges.groupBy("number_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast(groups.schema["items"].dataType)

    def step(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["supplier_key"] == x["supplier_key"]) | (
            x["exact"] & (k["invoice_date"] == x["invoice_date"]) & (k["stored_gross"] == x["stored_gross"])))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    kept = groups.select("number_key", F.explode(F.aggregate("items", empty, step)).alias("k"))
    return kept.select("k.arrival_seq", "number_key", "k.supplier_key", "k.invoice_date", "k.stored_gross").select(*IMPORTED_COLUMNS)


def _round(undecided: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """One round over the undecided documents of large number keys: (imported, still undecided)."""
    s_node = ["number_key", "supplier_key"]
    g_node = ["number_key", "invoice_date", "stored_gross"]
    by_s = undecided.groupBy(*s_node).agg(
        F.min(F.struct("arrival_seq", "invoice_date", "stored_gross", "exact")).alias("f"), F.count(F.lit(1)).alias("s_rows"))
    by_g = undecided.groupBy(*g_node).agg(F.min("arrival_seq").alias("arrival_seq"), F.count(F.lit(1)).alias("g_rows"))
    first_s = by_s.select(*s_node, "f.*", "s_rows")
    first_g = by_g.select("arrival_seq", F.lit(True).alias("first_at_amount"), "g_rows")
    # Arrival numbers are unique, so this join has no hot key.
    new = cut(first_s.join(first_g, "arrival_seq", "left")
              .where(~F.col("exact") | F.coalesce("first_at_amount", F.lit(False))).drop("first_at_amount"))
    rest = anti_lookup(undecided, new, s_node, hot_keys(new, s_node, hot_rows, "s_rows"))
    # An amount can be occupied by several imported documents when their gross total is finer than cents.
    amounts = new.groupBy(*g_node).agg(F.min("arrival_seq").alias("occupied_from"), F.max("g_rows").alias("g_rows"))
    rest = left_lookup(rest, amounts.drop("g_rows"), g_node, hot_keys(amounts, g_node, hot_rows, "g_rows"))
    free = F.col("occupied_from").isNull() | ~F.col("exact") | (F.col("occupied_from") > F.col("arrival_seq"))
    return new.select(*IMPORTED_COLUMNS), cut(rest.where(free).select(*undecided.columns))


def greedy_imports(candidates: DataFrame, fold_rows: int = FOLD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The imported documents among `candidates` (CANDIDATE_COLUMNS), as if processed one by one.

    What a round leaves undecided no longer touches anything imported, so it is a smaller problem of the same kind:
    number keys that have become small are folded, the others go into the next round.
    """
    undecided = cut(collapse(candidates))
    imported: list[DataFrame] = []
    while True:
        large = cut(undecided.groupBy("number_key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > fold_rows).select("number_key"))
        n_large = large.count()
        if n_large == 0:
            return union_all([*imported, _fold(undecided)])
        keys = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
        imported.append(_fold(undecided.join(keys, "number_key", "left_anti")))
        new, undecided = _round(cut(undecided.join(keys, "number_key", "left_semi")), hot_rows)
        imported.append(new)


# Lookup against stored invoices ------------------------------------------------------------------------------------

STORED_COLUMNS = ["id", "supplier_key", "invoice_number_key", "invoice_date", "gross_total", "invoice_number", "supplier_name", "source_file"]


def _hit() -> Column:
    return F.struct("id", "invoice_number", "supplier_name", "source_file")


def find_duplicates(candidates: DataFrame, invoices: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`candidates` plus `hit`: the matching stored invoice with the lowest id, or null.

    Instead of joining on the number key and testing the OR per pair, the two alternatives are two lookups, each
    against a side with one row per full key. `candidates` is read several times: pass a checkpointed table.
    """
    s_key = ["number_key", "supplier_key"]
    g_key = ["number_key", "invoice_date", "gross_total"]
    gross_type = candidates.schema["gross_total"].dataType
    stored = (invoices.select(*STORED_COLUMNS).withColumnRenamed("invoice_number_key", "number_key")
              .withColumn("gross_total", F.col("gross_total").cast(gross_type)))

    def side(key: list[str], name: str) -> DataFrame:
        # Only stored invoices whose whole key occurs in the batch; a small batch is broadcast by adaptive execution.
        own = stored.join(candidates.select(*key).distinct(), key, "left_semi")
        return own.groupBy(*key).agg(F.min_by(_hit(), "id").alias(name))

    by_supplier, by_amount = side(s_key, "s_hit"), side(g_key, "g_hit")
    found = left_lookup(candidates, by_supplier, s_key, hot_keys(candidates, s_key, hot_rows))
    found = left_lookup(found, by_amount, g_key, hot_keys(candidates, g_key, hot_rows))
    hit = (F.when(F.col("g_hit").isNull() | (F.col("s_hit.id") <= F.col("g_hit.id")), F.col("s_hit"))
           .otherwise(F.col("g_hit")))
    return found.withColumn("hit", hit).drop("s_hit", "g_hit")
