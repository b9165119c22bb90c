"""Label hierarchies: node scores, traversal along one or several branches, fallbacks, reviews and guards, grafts.

A tree is a table: profiles (node, child, feature, mean) and edges (node, child). A node is its label path.
Traversal is level by level: a frontier of (sample, node) rows joins the tree, so each level is one plan
over all samples and nodes, and the loop runs over the depth of the tree only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode
from ..storage import materialise

TERMINAL = "__TERMINAL__"


def prefixes(paths: DataFrame, delimiter: str = "|") -> DataFrame:
    """(node, child, label, depth) of all edges of label paths (labels array); the root is ''."""
    df = paths.select(F.explode(F.expr("transform(sequence(1, size(labels)), k -> struct(slice(labels, 1, k - 1) AS up, slice(labels, 1, k) AS down, labels[k - 1] AS label, k AS depth))")).alias("e"))
    return df.select(F.array_join("e.up", delimiter).alias("node"), F.array_join("e.down", delimiter).alias("child"), "e.label", "e.depth").distinct()


def profiles(matrix: DataFrame, members: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, child, feature, mean) from training samples: members (sample, child) says which subtrees a sample is in."""
    m = matrix.where("value IS NOT NULL").join(members, "sample").groupBy("child", "feature").agg(F.avg("value").alias("mean"))
    return m.join(tree.select("node", "child"), "child").select("node", "child", "feature", "mean")


def profile_scores(frontier: DataFrame, matrix: DataFrame, profile: DataFrame) -> DataFrame:
    """(sample, node, child, score, n, asked): mean of 1 - |value - mean| over the callable features; 0 without any.

    Cells meet the frontier by sample and the profile by node and feature, whose rows carry all children: only cells that exist are scored, and what a
    sample's cells add up to leaves a task, not the cells of each child. How many features were asked for is the profile's own.
    """
    at = frontier.select("sample", "node").distinct()
    cells = at.join(matrix.where("value IS NOT NULL").select("sample", "feature", "value").hint("merge"), "sample")  # so a task sums few samples, each whole
    means = profile.groupBy("node", "feature").agg(F.collect_list(F.struct("child", "mean")).alias("__of"))
    cells = cells.join(means, ["node", "feature"]).select("sample", "node", "value", F.inline("__of"))
    per = cells.groupBy("sample", "node", "child").agg(F.avg(1 - F.abs(F.col("value") - F.col("mean"))).alias("s"), F.count("*").alias("n"))
    asked = profile.groupBy("node", "child").agg(F.count("*").alias("asked"))
    df = at.join(asked, "node").join(per, ["sample", "node", "child"], "left")
    return df.select("sample", "node", "child", F.least(F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("score"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "asked")


def symbol_scores(frontier: DataFrame, markers: DataFrame, frequencies: DataFrame) -> DataFrame:
    """As profile_scores for symbols: mean frequency of the sample's state in the child; a state unknown there counts 0.

    markers: (sample, feature, state), NULL left out; frequencies: (node, child, feature, state, freq).
    """
    children = frequencies.select("node", "child").distinct()
    cells = frontier.select("sample", "node").distinct().join(children, "node").join(markers.where("state IS NOT NULL"), "sample")
    per = cells.join(frequencies, ["node", "child", "feature", "state"], "left").groupBy("sample", "node", "child").agg(F.avg(F.coalesce("freq", F.lit(0.0))).alias("s"))
    return per.select("sample", "node", "child", F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)).alias("score"))


def choose_scores(scores: DataFrame, model: DataFrame, max_missing: float = 20.0, max_entropy: float = 0.8) -> DataFrame:
    """Per node the model's scores or the profile's: a single child scores 1; without a model, with too much missing or too even scores, the profile decides.

    scores: (sample, node, child, score, n, asked); model: (sample, node, child, p).
    """
    w = Window.partitionBy("sample", "node")
    df = scores.join(model, ["sample", "node", "child"], "left")
    df = df.withColumn("__p", F.collect_list(F.coalesce("p", F.lit(0.0))).over(w)).withColumns(
        {
            "children": F.count("*").over(w),
            "has_model": F.count("p").over(w) > 0,
            "missing": 100 * (1 - F.max(F.col("n") / F.greatest("asked", F.lit(1))).over(w)),
            "entropy": encode.entropy(encode.normalised("__p")),
        }
    )
    source = F.when(F.col("children") == 1, F.lit("single")).when(~F.col("has_model"), F.lit("profile")).when(F.col("missing") > max_missing, F.lit("profile_missing")).when(F.col("entropy") > max_entropy, F.lit("profile_entropy")).otherwise(F.lit("model"))
    df = df.withColumn("source", source)
    return df.select("sample", "node", "child", F.when(F.col("source") == "single", 1.0).when(F.col("source") == "model", F.coalesce("p", F.lit(0.0))).otherwise(F.col("score")).alias("score"), "source")


def descend(samples: DataFrame, scorer, max_depth: int) -> DataFrame:
    """One branch: from the root to the best child of each node, (sample, depth, node, child, score); ties go to the least child.

    samples: (sample); scorer takes a frontier (sample, node) and gives (sample, node, child, score).
    """
    frontier, out = samples.select("sample", F.lit("").alias("node")), None
    for depth in range(1, max_depth + 1):
        step = scorer(frontier).groupBy("sample", "node").agg(F.min_by(F.struct("child", "score"), F.struct((-F.col("score")).alias("s"), "child")).alias("b"))
        step = step.select("sample", F.lit(depth).alias("depth"), "node", F.col("b.child").alias("child"), F.col("b.score").alias("score"))
        if depth < max_depth:  # read twice: as a result, and by the next level
            step = materialise(step, "descend-level", few=True)
        out = step if out is None else out.unionByName(step)
        frontier = step.select("sample", F.col("child").alias("node"))
    return out


def branch(samples: DataFrame, scorer, max_depth: int, specificity: float, sensitivity: float) -> DataFrame:
    """All branches: a child stays if its score is above `specificity`; a path scores the least of its edges.

    Paths that end (at TERMINAL, or a node without children) and score above `sensitivity` count; a sample
    without one gets its deepest others above it. (sample, path, score, depth, terminal)
    """
    frontier, ended, passed = samples.select("sample", F.lit("").alias("node"), F.lit(1.0).alias("path_score")), None, None
    for depth in range(1, max_depth + 1):
        scored = scorer(frontier.select("sample", "node"))
        step = materialise(frontier.join(scored, ["sample", "node"], "left"), "branch-level", few=True)  # read four times
        done = step.where(F.col("child").isNull() | ((F.col("child") == TERMINAL) & (F.col("score") > specificity)))
        done = done.select("sample", F.col("node").alias("path"), F.when(F.col("child").isNull(), F.col("path_score")).otherwise(F.least("path_score", "score")).alias("score"), F.lit(depth - 1).alias("depth"))
        ended = done if ended is None else ended.unionByName(done)
        frontier = step.where(F.col("child").isNotNull() & (F.col("child") != TERMINAL) & (F.col("score") > specificity)).select("sample", F.col("child").alias("node"), F.least("path_score", "score").alias("path_score"))
        here = frontier.select("sample", F.col("node").alias("path"), F.col("path_score").alias("score"), F.lit(depth).alias("depth"))
        passed = here if passed is None else passed.unionByName(here)
    ended = ended.unionByName(passed.where(F.col("depth") == max_depth)).where(F.col("path") != "").where(F.col("score") > sensitivity).withColumn("terminal", F.lit(True))
    others = passed.where(F.col("score") > sensitivity).join(ended.select("sample").distinct(), "sample", "left_anti")
    deepest = others.withColumn("__r", F.rank().over(Window.partitionBy("sample").orderBy(F.col("depth").desc()))).where("__r = 1").drop("__r").withColumn("terminal", F.lit(False))
    both = ended.unionByName(deepest)
    return both.groupBy("sample", "path").agg(F.max("score").alias("score"), F.max("depth").alias("depth"), F.max("terminal").alias("terminal"))


def recursive_paths(edges: DataFrame) -> DataFrame:
    """All root-to-node paths with the least edge score, by a recursive query: (path, score, depth). edges: (node, child, score); the root is ''."""
    return edges.sparkSession.sql("WITH RECURSIVE p(path, score, depth) AS (SELECT child, score, 1 FROM {edges} WHERE node = '' UNION ALL SELECT e.child, least(p.score, e.score), p.depth + 1 FROM p JOIN {edges} e ON e.node = p.path) SELECT * FROM p", edges=edges)


def support_policy(labels: DataFrame, min_class: int = 2, min_review: int = 10) -> DataFrame:
    """(label_column, class, n, excluded, review) of labels (label_column, label); null-like labels are left out."""
    ok = labels.where(F.col("label").isNotNull() & ~F.lower(F.trim("label")).isin("", "nan", "none", "null", "na", "n/a"))
    n = ok.groupBy("label_column", F.trim("label").alias("class")).agg(F.count("*").alias("n"))
    return n.select("label_column", "class", "n", (F.col("n") < min_class).alias("excluded"), (F.col("n") < min_review).alias("review"))


def policy_lists(policy: DataFrame) -> DataFrame:
    """Per label column the sorted excluded and to-be-reviewed classes."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("class"))))
    return policy.groupBy("label_column").agg(F.array_join(pick("excluded"), ",").alias("excluded"), F.array_join(pick("review"), ",").alias("review"))


def reported(steps: DataFrame, policy: DataFrame, label_column: str, review_label: str = "review_required") -> DataFrame:
    """steps (sample, label, ...) with the label to report and the one to route by: rare classes are reported for review, and routed as they are."""
    p = policy.where(F.col("label_column") == label_column).select(F.col("class").alias("label"), "review")
    return steps.join(p, "label", "left").withColumns({"routing": F.col("label"), "reported": F.when(F.col("review"), F.lit(review_label)).otherwise(F.col("label"))}).drop("review")


# What becomes of a susceptible call on weak evidence.
ESCALATED, WARNED, BLOCKED = "amr_terminal_fallback_escalation", "amr_weak_evidence_warning", "amr_evidence_review_required"


def guarded(steps: DataFrame, columns: tuple[str, ...], terminal: DataFrame | None = None, mode: str = "warn", least: float = 0.05, min_resistant: float = 0.5, review_label: str = BLOCKED) -> DataFrame:
    """steps (sample, label_column, label, resolved, n_resolved, status) with reported, routing, guard and source.

    Susceptible calls of the given label columns on weak evidence go to the sample's terminal model: terminal
    is (sample, prediction, resistant_probability, source). If it says resistant with enough probability, that
    is reported and routed by. Otherwise the call stays with a warning, or is reported for review (mode block).
    """
    low = [c.lower() for c in columns]
    weak = (F.lower(F.trim("label")) == "susceptible") & F.lower(F.trim("label_column")).isin(*low) & encode.weak_evidence(F.col("resolved"), F.col("n_resolved"), F.col("status"), least)
    df = steps.withColumn("__weak", F.coalesce(weak, F.lit(False)))
    if terminal is None:
        df = df.withColumns({"__resistant": F.lit(False), "__to": F.lit(None).cast("string"), "__from": F.lit(None).cast("string")})
    else:
        over = (F.lower(F.trim("prediction")) == "resistant") & (F.col("resistant_probability") >= min_resistant)
        df = df.join(terminal.select("sample", F.coalesce(over, F.lit(False)).alias("__resistant"), F.col("prediction").alias("__to"), F.col("source").alias("__from")), "sample", "left")
    escalated = F.col("__weak") & F.coalesce("__resistant", F.lit(False))
    blocked = F.lit(mode == "block")
    df = df.withColumns(
        {
            "reported": F.when(escalated, F.col("__to")).when(F.col("__weak") & blocked, F.lit(review_label)).otherwise(F.col("label")),
            "routing": F.when(escalated, F.col("__to")).otherwise(F.col("label")),
            "guard": F.when(escalated, F.lit(ESCALATED)).when(F.col("__weak") & blocked, F.lit(BLOCKED)).when(F.col("__weak"), F.lit(WARNED)).otherwise(F.lit("none")),
            "source": F.when(escalated, F.col("__from")),
        }
    )
    return df.drop("__weak", "__resistant", "__to", "__from")


def fallback_model(steps: DataFrame, models: DataFrame) -> DataFrame:
    """(sample, model, source): that of the deepest predicted label with one, else the global one (of several the least). models: (label, model); the global label is ''."""
    hits = steps.join(models.where("label <> ''"), "label").groupBy("sample").agg(F.max_by("model", "depth").alias("m"))
    every = F.broadcast(models.where("label = ''").agg(F.min("model").alias("g")))
    df = steps.select("sample").distinct().join(hits, "sample", "left").join(every, F.lit(True), "left")  # one row
    return df.select("sample", F.coalesce("m", "g").alias("model"), F.when(F.col("m").isNotNull(), F.lit("parent")).when(F.col("g").isNotNull(), F.lit("global")).alias("source"))


def path_text(steps: DataFrame) -> DataFrame:
    """(sample, path): column=label of all steps, in order of depth."""
    each = F.struct("depth", F.concat_ws("=", "label_column", "label").alias("t"))
    return steps.groupBy("sample").agg(F.array_sort(F.collect_list(each)).alias("s")).select("sample", F.array_join(F.transform("s", lambda x: x["t"]), " / ").alias("path"))


def graft(tree: DataFrame, child: DataFrame, at: str, delimiter: str = "|") -> DataFrame:
    """tree (node, child, ...) whose terminal node `at` becomes the root of another tree of the same columns."""
    under = lambda c: F.when(F.col(c) == "", F.lit(at)).when(F.col(c) == TERMINAL, F.col(c)).otherwise(F.concat(F.lit(at + delimiter), F.col(c)))
    kept = tree.where(F.col("node") != at)
    return kept.unionByName(child.withColumns({"node": under("node"), "child": under("child")}))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether two tables have the same rows, repeats included."""
    diff = a.exceptAll(b).unionAll(b.exceptAll(a))
    return diff.agg((F.count("*") == 0).alias("same"))


def outline(edges: DataFrame, delimiter: str = "|") -> str:
    """Indented text of a (small) tree of edges (child)."""
    rows = sorted(r["child"].split(delimiter) for r in edges.select("child").distinct().collect())
    return "\n".join("  " * (len(p) - 1) + p[-1] for p in rows)


def newick(edges: DataFrame, delimiter: str = "|") -> str:
    """Newick text of a (small) tree of edges (node, child)."""
    below: dict[str, list[str]] = {}
    for r in edges.select("node", "child").distinct().collect():
        below.setdefault(r["node"], []).append(r["child"])

    # each node's text after those of its children, without recursion
    done: dict[str, str] = {}
    open_ = [""]
    while open_:
        node = open_[-1]
        waiting = [c for c in below.get(node, []) if c not in done]
        if waiting:
            open_ += waiting
            continue
        open_.pop()
        inner = ",".join(done[c] for c in sorted(below.get(node, [])))
        name = node.split(delimiter)[-1].replace(" ", "_")
        done[node] = f"({inner}){name}" if inner else name
    return done[""] + ";"
