"""Filter interaction audit: what each filter removes in every order of application, and its average over the orders.

The sets of filters already applied form a lattice; applying a filter is an edge from a set to the one with that filter added. What an edge
removes depends on the set alone, not on the order in which it was reached, so documents are counted once per set of failed filters and part,
and the edges of the lattice (k * 2**(k-1), whatever the corpus) are read off those counts. The number of orders through an edge is the
number of paths that reach its lower end, counted forwards, times the number that leave its upper end, counted backwards: with these weights
the edge removals give Shapley values, and every step of every order is one edge.

Defined results: a null text is empty, a null part is the empty string. A text fails the duplicate filter if the same text stands at a smaller
id anywhere in the table; a null id has no smaller one and is none, and rows that share the smallest id all pass. Labels of an id that
has several are combined (any label of 1 counts); a null label counts as 0. Rows that share an id count one by one. A table without rows
has no parts and gives none.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 7     # orders are listed, and there are k! of them
NULL_SPREAD = 1024   # rows without an id are joined to labels under so many keys, for no label has any


def paths(k: int) -> tuple[list[int], list[int]]:
    """For every set of `k` filters, as bits: in how many orders it can be reached from the empty set, and left for the full one."""
    reaching, leaving = [1] + [0] * ((1 << k) - 1), [0] * ((1 << k) - 1) + [1]
    for state in range(1, 1 << k):
        reaching[state] = sum(reaching[state & ~(1 << f)] for f in range(k) if state >> f & 1)
    for state in range((1 << k) - 2, -1, -1):
        leaving[state] = sum(leaving[state | 1 << f] for f in range(k) if not state >> f & 1)
    return reaching, leaving


def standard_conditions(text: Column) -> dict[str, Column]:
    """Short, repetitive, shouting and symbol-laden texts, as failure conditions."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, conditions=standard_conditions, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail. Bits follow the order of the conditions; the last is that of
    the duplicate filter. Texts never leave the scan: a digest stands for them, and rows are added up by it before they are moved."""
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("t"))
    mask, k = F.lit(0), 0
    for k, failed in enumerate(conditions(text).values(), 1):
        mask = mask + F.when(failed, F.lit(1 << (k - 1))).otherwise(F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    spread = lambda: F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SPREAD))).otherwise(F.lit(-1).cast("long"))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.withColumn("spread", spread()).join(known.withColumn("spread", F.lit(-1).cast("long")), ["id", "spread"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # copies of a text within a part and label, of which those at the smallest id may be the first
    copies = rows.select("id", "part", "digest", "mask", "n", flag("good"), flag("toxic")).groupBy("digest", "part", "mask", "good", "toxic", "id").agg(F.sum("n").alias("n"))
    copies = copies.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min("id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"),
                                                                         F.min_by(F.when(F.col("id").isNotNull(), F.col("n")), "id").alias("at_least"), F.sum("n").alias("n"))
    first = copies.groupBy("digest").agg(F.min("least").alias("first"))
    copies = copies.join(first, "digest")
    passing = F.col("unnumbered") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + (1 << k)).alias("mask"), (F.col("n") - passing).alias("n")))
    split = copies.select("part", "good", "toxic", F.explode(both).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def edges(masks: DataFrame, k: int) -> DataFrame:
    """(part, state, bit, removed, good_lost, toxic_lost, kept, fails, unique_fails, orders) for every edge of the lattice of `k` filters.
    `orders` is the number of orders that go along the edge."""
    reaching, leaving = paths(k)
    steps = [(state, bit, reaching[state] * leaving[state | 1 << bit]) for state in range(1 << k) for bit in range(k) if not state >> bit & 1]
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, b, w in steps])
    at = masks.withColumn("e", F.explode(every)).select("part", "mask", "n", "good", "toxic", "e.*").withColumn("own", F.expr("shiftleft(1, bit)"))
    here = "mask & state = 0 and mask & own <> 0"
    total = lambda when, what, name: F.sum(F.expr(f"case when {when} then {what} else 0 end")).alias(name)
    return at.groupBy("part", "state", "bit", "orders").agg(total(here, "n", "removed"), total(here, "good", "good_lost"), total(here, "toxic", "toxic_lost"), total("mask & (state | own) = 0", "n", "kept"),
                                                           total("mask & own <> 0", "n", "fails"), total("mask = own", "n", "unique_fails"))


def audit(docs: DataFrame, labels: DataFrame, conditions=standard_conditions, duplicates: str = "E", **columns) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `conditions` maps the text column to failure conditions by letter; `duplicates` is the letter of the filter that refuses later copies."""
    names = [*conditions(F.lit("")), duplicates]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: every order of them is a row")
    # a handful of rows per part, written because both the steps and the averages read them
    found = written(edges(failures(docs, labels, conditions, **columns), len(names)), "edges")
    value = found.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = [("".join(names[f] for f in order), at + 1, sum(1 << f for f in order[:at]), order[at]) for order in permutations(range(len(names))) for at in range(len(names))]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, bit int")
    out = found.join(value, ["part", "bit"]).join(F.broadcast(steps), ["state", "bit"])  # k * k! rows, whatever the corpus
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
