"""Mixing of sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source has a queue: its documents in an order shuffled by a keyed digest of doc_id and text, up to
`max_copies` times over. The virtual finish time of a copy is the source's tokens up to and with it,
divided by the source's target. All copies are range-sorted by virtual finish time over all sources, and
truncated where the total budget (the tokens of all documents) is spent.

Only sizes and digests are sorted, never texts. A queue's order is that of its digests and finish times
rise along it, so what the mix takes of a queue's c-th pass is a prefix: one digest for each source and
pass decides every document, and texts meet these few rows in a join that Spark broadcasts by their size.

Prefix sums never gather a source in one task: the digest's leading hex digits split each queue into
buckets, whose sums are added up first, over ranges of them; a window then runs within a bucket. Rows that are alike in all
columns, maps and variants too (by a digest of the row as JSON), are one row with a count. The end of the budget is found from the sums of the sorted ranges, and
within the one range that holds it. Buckets grow with the number of rows, ranges with the partitions.

Defined results: a null text has size 0; a null source is a source, last in order; repeated rows are
documents of their own, and where the budget ends among them, that many are taken; an empty table
gives an empty result; input columns with the name of an output give way to it. Sources without any word
have target 0 and nothing is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import placed, running
from .common import WORD, discard, materialise, with_outputs

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
ROWS_PER_BUCKET = 2_000
KEY = "mix"
_ROW = ["__hx_queue", "__hx_digest", "__hx_rest"]


def placed_in_queues(docs: DataFrame) -> DataFrame:
    """docs with the queue and the place in its shuffled order: a digest of doc_id and text, and one of the other columns."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]))
    return docs.withColumns(
        {
            "__hx_queue": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))),
            "__hx_digest": F.md5(F.concat(F.lit(f"{KEY}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))),
            "__hx_rest": F.md5(others),
        }
    )


def prepared(docs: DataFrame) -> DataFrame:
    """docs with its size, queue and place in the shuffled order."""
    return placed_in_queues(docs).withColumn("__hx_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets of the queues (a row per source): shares by weight of all sizes, none above max_copies times its size.

    Filling up by weight ends where the sources at their limit are those with the least limit per unit
    of weight; in that order, running sums give each candidate level, and the first source that stays
    below its limit has the right one. Sources are range-sorted, so there may be many.
    """
    df = sizes.withColumn("last", F.when(F.col("__hx_queue") == "n", 1).otherwise(0))
    df = running(df, ["last", "__hx_queue"], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    df = df.withColumns({"weight": weight, "cap": max_copies * F.col("source_size")}).withColumn("limit", F.col("cap") / F.col("weight"))
    df = running(df, ["limit", "rank"], {"full": F.col("cap"), "weighed": F.col("weight"), "place": F.lit(1).cast("long")})
    every = sizes.agg(F.sum("source_size").alias("all_size")).join(F.broadcast(df.agg(F.sum("weight").alias("all_weight"))))  # one row each
    df = df.join(F.broadcast(every))  # one row
    df = materialise(df.withColumn("level", (F.col("all_size") - F.col("full")).cast("double") / (F.col("all_weight") - F.col("weighed"))), "mix-levels", few=True)
    level = df.where(F.col("limit") > F.col("level")).agg(F.min(F.struct("place", "level")).alias("l")).select(F.col("l.level").alias("free"))
    df = df.join(F.broadcast(level))  # one row
    return df.select("__hx_queue", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("free") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


@dataclass
class Mix:
    """What a mix needs besides the rows: a row per queue with source_size, target, and how far the mix goes in each pass."""

    queues: DataFrame
    split: bool  #: whether a pass ends among rows that are alike


def _finish(upto: Column) -> Column:
    """Virtual finish time of a copy, from the queue's tokens up to and with it."""
    return upto.cast("double") / F.col("target")


def plan(rows: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, rows_per_bucket: int = ROWS_PER_BUCKET) -> Mix:
    """The mix of all prepared rows; of a table's texts only sizes and digests are kept."""
    light = materialise(rows.groupBy(*_ROW, "__hx_size").agg(F.count("*").alias("k")), "mix-rows")
    queues = materialise(targets(light.groupBy("__hx_queue").agg(F.sum(F.col("__hx_size") * F.col("k")).alias("source_size")), weights, max_copies), "mix-targets", few=True)
    n, total = light.agg(F.count("*"), F.coalesce(F.sum(F.col("__hx_size") * F.col("k")), F.lit(0))).first()
    digits = min(max(1, math.ceil(math.log(max(n, 1) / rows_per_bucket + 1, 16))), 16)
    light = light.withColumn("bucket", F.substring("__hx_digest", 1, digits))
    sums = light.groupBy("__hx_queue", "bucket").agg(F.sum(F.col("__hx_size") * F.col("k")).alias("n"))
    before = running(sums, ["__hx_queue", "bucket"], {"before": F.col("n")})
    first = before.groupBy("__hx_queue").agg(F.min("before").alias("first"))
    offsets = materialise(before.join(first, "__hx_queue").select("__hx_queue", "bucket", (F.col("before") - F.col("first")).alias("offset")), "mix-offsets", few=True)
    own = Window.partitionBy("__hx_queue", "bucket").orderBy("__hx_digest", "__hx_rest").rowsBetween(Window.unboundedPreceding, -1)
    queued = light.join(offsets, ["__hx_queue", "bucket"]).withColumn("from", F.col("offset") + F.coalesce(F.sum(F.col("__hx_size") * F.col("k")).over(own), F.lit(0)))
    queued = materialise(queued.where("__hx_size > 0").join(queues, "__hx_queue").select(*_ROW, "__hx_size", "k", "from", "source_size", "target"), "mix-queued")
    copies = queued.select("__hx_queue", "__hx_size", "k", "from", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))).alias("pass"))
    copies = copies.withColumn("at", F.col("pass") * F.col("source_size") + F.col("from"))
    copies = copies.select("__hx_queue", "__hx_size", "source_size", "target", "pass", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).withColumn("at", F.col("at") + F.col("j") * F.col("__hx_size"))
    order = ["finish", "__hx_queue", "at"]
    copies = placed(copies.select(_finish(F.col("at") + F.col("__hx_size")).alias("finish"), "__hx_queue", "at", F.col("__hx_size").alias("size"), "pass", (F.col("at") + F.col("__hx_size") - F.col("pass") * F.col("source_size")).alias("reach")), order, "mix-copies")
    spent, last = 0, None
    for part, s in sorted(copies.groupBy("__part").agg(F.sum("size")).collect()):  # a row per range
        if spent + s > total:
            last = part
            break
        spent += s
    taken = copies if last is None else copies.where(F.col("__part") < last)
    if last is not None:
        upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.where(F.col("__part") == last).withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") + spent <= total)
        taken = taken.unionByName(inside.drop("upto"))
    reach = materialise(taken.groupBy("__hx_queue", "pass").agg(F.max("reach").alias("reach")), "mix-reach", few=True)
    last_row = F.max(F.struct("__hx_digest", "__hx_rest", "__hx_size", "k", "from")).alias("r")
    ends = queued.join(reach, "__hx_queue").where(F.col("from") + F.col("__hx_size") <= F.col("reach")).groupBy("__hx_queue", "pass", "reach").agg(last_row)
    whole = F.least(F.col("r.k"), F.floor((F.col("reach") - F.col("r.from")) / F.col("r.__hx_size")))
    ends = ends.select("__hx_queue", F.struct("pass", F.col("r.__hx_digest").alias("digest"), F.col("r.__hx_rest").alias("rest"), whole.alias("m"), F.col("r.k").alias("k")).alias("e"))
    ends = ends.groupBy("__hx_queue").agg(F.sort_array(F.collect_list("e")).alias("ends"))  # at most max_copies
    none = F.expr("cast(array() AS array<struct<pass:int,digest:string,rest:string,m:bigint,k:bigint>>)")
    out = queues.join(ends, "__hx_queue", "left").select("__hx_queue", F.col("source_size").alias("__hx_source_size"), F.col("target").alias("__hx_target"), F.coalesce("ends", none).alias("__hx_ends"))
    out = materialise(out, "mix-ends", few=True)
    split = not out.where("exists(__hx_ends, e -> e.m < e.k)").isEmpty()
    discard(light, copies, queued, offsets, reach)
    return Mix(out, split)


def with_copies(rows: DataFrame, m: Mix, some: Column) -> DataFrame:
    """Rows with their place in the queues, with __hx_copies, how often the mix takes each; some: whether a row has any word."""
    df = rows.join(m.queues, "__hx_queue")
    same = "(__hx_digest = e.digest AND __hx_rest = e.rest)"
    each = f"CASE WHEN __hx_digest < e.digest OR (__hx_digest = e.digest AND __hx_rest < e.rest) OR ({same} AND e.m = e.k) THEN 1 ELSE 0 END"
    df = df.withColumn("__hx_copies", F.when(some, F.expr(f"aggregate(__hx_ends, 0, (a, e) -> a + {each})")).otherwise(F.lit(0)))
    if not m.split:
        return df.drop("__hx_ends")
    alike = F.expr(f"exists(__hx_ends, e -> {same} AND e.m < e.k)") & some
    # rows that are alike, of which a pass takes some: counted, and dealt out by number
    columns = [c for c in df.columns if c not in _ROW]
    group = df.where(alike).groupBy(*_ROW).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("r"), F.count("*").alias("n"))
    group = group.select(*_ROW, *[F.col(f"r.`{c}`").alias(c) for c in columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__hx_j"))
    group = group.withColumn("__hx_copies", F.col("__hx_copies") + F.expr(f"aggregate(__hx_ends, 0, (a, e) -> a + CASE WHEN {same} AND e.m < e.k AND __hx_j <= e.m THEN 1 ELSE 0 END)"))
    return df.where(~alike).unionByName(group.drop("__hx_j")).drop("__hx_ends")


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """All of docs without its texts, with what the mix takes of each."""
    given = [c for c in docs.columns if c.lower() != "text"]
    rows = materialise(prepared(docs).select(*[F.col(f"`{c}`") for c in given], "__hx_size", *_ROW), "mix-sizes")
    outputs = {"size": "size", "source_size": "source_size", "target": "target", "copies": "copies"}
    df = with_copies(rows, plan(rows, weights, max_copies), F.col("__hx_size") > 0)
    return with_outputs(df, given, {k: F.col(f"__hx_{v}") for k, v in outputs.items()} | {"taken": F.col("__hx_copies").cast("long") * F.col("__hx_size")})


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: docs as they are, each as often as the mix takes it."""
    m = plan(prepared(docs), weights, max_copies)
    df = with_copies(placed_in_queues(docs), m, F.coalesce(F.col("text").rlike(WORD), F.lit(False))).where(F.col("__hx_copies") > 0)
    return df.withColumn("__hx_copy", F.explode(F.sequence(F.lit(1), F.col("__hx_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
