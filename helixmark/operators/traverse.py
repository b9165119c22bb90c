"""The complete walk down a trained hierarchy: gates, constant nodes, fallbacks, reviews, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..storage import materialise
from . import hierarchy

#: What can become of a step.
STATUSES = ("constant", "success", "abstained", "global_lineage_fallback", "stopped")

#: What a walk reads of a node's evidence.
EVIDENCE = ("n_supporting", "resolved", "n_resolved", "n_active", "evidence_status")


def walk(samples: DataFrame, nodes: DataFrame, scorer, gates: DataFrame, policy: DataFrame, fallback: DataFrame, max_depth: int, review_label: str = "review_required", low: tuple[str, ...] = encode.LOW_CONFIDENCE, delta: float = 0.0, confidence: DataFrame | None = None, evidence: DataFrame | None = None, guard: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All steps of all samples: (sample, depth, node, label_column, status, label, reported, support, reason).

    nodes: (node, label_column, status, constant); a node that isn't there, or has neither status constant
    nor success, is unavailable. scorer: frontier (sample, node) to (sample, node, child, score). gates:
    (sample, node, verdict). policy: (label_column, class, review). fallback: (sample, depth, label, support),
    the labels of a global model, which stand in where a node is unavailable or, by the rules of
    lineage_fallback, wins over the branch. confidence: (sample, node, confidence) of the branch's calls, high
    where it has none. Or evidence: (sample, node, n_supporting, resolved, n_resolved, n_active, evidence_status), from which and from the
    branch's support confidence follows (low without a row); steps then also have confidence, resolved, n_resolved and evidence_status, and
    guard may change a level's steps: a function that adds routing. Routing goes by it, else by the label; reporting by `reported`.

    A level is one plan over all samples; the loop runs over the depth, and writes each level but the last.
    """
    frontier, out = samples.select("sample", F.lit("").alias("node")), None
    for depth in range(1, max_depth + 1):
        at = frontier.join(nodes, "node", "left").join(gates, ["sample", "node"], "left")
        live = at.where((F.col("status") == "success") & (F.coalesce("verdict", F.lit("predict")) == "predict"))
        scored = scorer(live.select("sample", "node"))
        total = scored.groupBy("sample", "node").agg(F.sum("score").alias("t"), F.min_by(F.struct("child", "score"), F.struct((-F.col("score")).alias("s"), "child")).alias("b"))
        top = total.select("sample", "node", F.element_at(F.split("b.child", "\\|"), -1).alias("branch"), (F.col("b.score") / F.when(F.col("t") > 0, F.col("t"))).alias("branch_support"))
        df = at.join(top, ["sample", "node"], "left").join(fallback.where(F.col("depth") == depth).select("sample", F.col("label").alias("other"), F.col("support").alias("other_support")), "sample", "left")
        branch_status = F.when(F.col("status") == "constant", "constant").when((F.col("status") == "success") & (F.col("verdict") == "abstain"), "abstained").when((F.col("status") == "success") & F.col("branch").isNotNull(), "success").otherwise("unavailable")
        df = df.withColumn("s", branch_status)
        if evidence is not None:
            df = df.join(evidence.select("sample", "node", *EVIDENCE), ["sample", "node"], "left").fillna(0, ["n_supporting", "resolved", "n_resolved", "n_active"])
            df = df.withColumn("confidence", encode.confidence(F.col("branch_support"), F.col("n_supporting"), F.col("resolved"), F.col("n_resolved"), F.col("n_active"), F.col("evidence_status")))
        elif confidence is None:
            df = df.withColumn("confidence", F.lit("high_confidence"))
        else:
            df = df.join(confidence.select("sample", "node", "confidence"), ["sample", "node"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("high_confidence")))
        why = encode.lineage_fallback(F.when(F.col("s") == "success", "success").otherwise("none"), F.col("confidence"), F.coalesce("branch", F.lit("")), F.col("branch_support"), F.coalesce("other", F.lit("")), F.col("other_support"), low, delta)
        df = df.withColumn("reason", F.when(F.col("s").isin("success", "unavailable"), why))
        takes = F.col("reason").isNotNull() & F.col("other").isNotNull()
        df = df.withColumns(
            {
                "step": F.when(F.col("s").isin("constant", "abstained"), F.col("s")).when(takes, "global_lineage_fallback").when(F.col("s") == "success", "success").otherwise("stopped"),
                "label": F.when(F.col("s") == "constant", F.col("constant")).when(F.col("s") == "abstained", F.lit(None)).when(takes, F.col("other")).otherwise(F.col("branch")),
                "support": F.when(takes, F.col("other_support")).when(F.col("s") == "success", F.col("branch_support")),
            }
        )
        p = policy.select("label_column", F.col("class").alias("label"), "review")
        df = df.join(p, ["label_column", "label"], "left")
        step = df.select("sample", F.lit(depth).alias("depth"), "node", "label_column", F.col("step").alias("status"), "label", F.when(F.col("review"), F.lit(review_label)).otherwise(F.col("label")).alias("reported"), "support", F.when(F.col("step") == "global_lineage_fallback", F.col("reason")).alias("reason"), *(["confidence", "resolved", "n_resolved", "evidence_status"] if evidence is not None else []))
        if guard is not None:
            step = guard(step)
        if depth < max_depth:  # read twice: as a result, and by the next level
            step = materialise(step, "walk-level", few=True)
        out = step if out is None else out.unionByName(step)
        to = F.col("routing" if guard is not None else "label")
        frontier = step.where(to.isNotNull()).select("sample", F.when(F.col("node") == "", to).otherwise(F.concat_ws("|", "node", to)).alias("node"))
    return out


def query_walk(cells: DataFrame, nodes: DataFrame, scorer, policy: DataFrame, fallback: DataFrame, max_depth: int, guarded_columns: tuple[str, ...] = (), terminal: DataFrame | None = None, mode: str = "warn", min_recovery: float = 0.5, min_callable: float = 0.5, **options) -> DataFrame:
    """From the cells of each node's features to the guarded path: all steps of all samples.

    cells: (sample, node, feature, value, mapping_status, allele_call, available), a node's features as a query resolves them. They give the
    gates (shares of available and callable features) and the marker evidence of each node; that and a branch's support give its confidence, which lets
    the global model's label win (walk, whose nodes, scorer, policy, fallback and options these are); susceptible calls of the guarded label columns on weak evidence are
    escalated to the terminal model, warned of, or blocked (hierarchy.guarded, whose terminal and mode these are). Rows: sample, depth, node, label_column,
    status, label, reported, routing, guard, source, support, reason, confidence, resolved, n_resolved, evidence_status. Cells are read once, and what they add up to is written first: as model_evidence counts, without its lists and histograms.
    """
    mapped, call, state = (F.col(c) for c in ("mapping_status", "allele_call", "value"))
    role = encode.evidence_role(call, mapped, F.col("available"), state)
    is_ = lambda *r: F.count_if(role.isin(*r))
    per = cells.groupBy("sample", "node").agg(
        F.count("*").alias("n"),
        F.avg(F.col("available").cast("double")).alias("r"),
        F.avg(state.isNotNull().cast("double")).alias("c"),
        F.count_if(state != 0).alias("n_active"),
        F.count_if(mapped.isNotNull() | call.isNotNull()).alias("mapped"),
        is_("resolved_nonbaseline_state").alias("n_supporting"),
        is_("resolved_baseline_state", "resolved_nonbaseline_state", "resolved_trained_zero_state").alias("known"),
        is_("aligned_matrix_state").alias("aligned"),
    )
    passed = (F.col("r") >= min_recovery) & (F.col("c") >= min_callable) & (F.col("c") > 0)
    has = F.col("mapped") > 0
    per = per.withColumn("n_resolved", F.col("known") + F.when(has, F.lit(0)).otherwise(F.col("aligned"))).withColumn("resolved", F.col("n_resolved") / F.greatest("n", F.lit(1)))
    found = per.select("sample", "node", F.when(passed, F.lit("predict")).otherwise(F.lit("abstain")).alias("verdict"), "n_supporting", "resolved", "n_resolved", "n_active", encode.resolved_status(F.col("resolved"), F.col("n_resolved"), has).alias("evidence_status"))
    found = materialise(found, "walk-evidence", few=True)
    gates = found.select("sample", "node", "verdict")

    def guard(step: DataFrame) -> DataFrame:
        given = step.withColumnsRenamed({"status": "__step", "reported": "__reviewed", "evidence_status": "status"})
        out = hierarchy.guarded(given, guarded_columns, terminal, mode).withColumnsRenamed({"status": "evidence_status", "__step": "status"})
        # a rare class stays for review, where the guard has nothing to say
        return out.withColumn("reported", F.when(F.col("guard") == "none", F.col("__reviewed")).otherwise(F.col("reported"))).drop("__reviewed")

    steps = walk(found.select("sample").distinct(), nodes, scorer, gates, policy, fallback, max_depth, evidence=found, guard=guard, **options)
    return steps.select("sample", "depth", "node", "label_column", "status", "label", "reported", "routing", "guard", "source", "support", "reason", *["confidence", "resolved", "n_resolved", "evidence_status"])


def tiered_payload(samples: DataFrame, groups: DataFrame, models: DataFrame) -> DataFrame:
    """Two-level routing: the group's model, else the global, else the binary one: (sample, model, tier).

    samples: (sample, level1); groups: (level1, grp); models: (kind, grp, model), one global and one binary at most.
    """
    own = groups.join(models.where("kind = 'group'").select("grp", F.col("model").alias("own")), "grp").select("level1", "own")
    rest = models.where("kind <> 'group'").agg(F.max(F.when(F.col("kind") == "global", F.col("model"))).alias("g"), F.max(F.when(F.col("kind") == "binary", F.col("model"))).alias("b"))
    df = samples.join(own, "level1", "left").join(F.broadcast(rest))  # one row
    return df.select("sample", F.coalesce("own", "g", "b").alias("model"), F.when(F.col("own").isNotNull(), "group").when(F.col("g").isNotNull(), "global").when(F.col("b").isNotNull(), "binary").alias("tier"))
