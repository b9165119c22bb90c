"""SimHash near-duplicates by generalised pigeonhole.

A fingerprint has 64 bits of a text's 4-word shingles. Texts link at `DISTANCE` or fewer differing bits;
the result is each document's connected component.

Equal fingerprints are one node. Correlated bits are put into the same part, and the parts get unequal
thresholds t with sum(t + 1) = DISTANCE + 1 (t = -1: the part isn't probed): two fingerprints within
DISTANCE differ by at most t in some part. The number of parts and the thresholds come from dynamic
programming over the expected cost of each part at each threshold: probes sent, and candidates met,
estimated from the pairs of a bounded sample (SAMPLE nodes) and from chance. Pairs of one group of alike
nodes don't count: pivots (below) spare them, so a large group is no reason to send all nodes' probes
further. Every node then probes the keys within t of its own in each part, and candidates are verified.

A key that more than LIGHT nodes share never meets its probes in one join. They are found from the key's
side: it names the keys within t of its own, and their nodes are its probes. Up to PIVOTS of its nodes are
compared with all of its probes first; pivots that share a neighbour are one class, and within the class
that has most rows nothing is left to be found. What lies outside it (as a rule few, where a key is heavy
because its nodes are alike) is dealt to cells with all the others, of at most about 2 * BLOCK rows, so that
each pair of blocks meets, and a cell returns a spanning forest of its links instead of all pairs. That
keeps the same components and stays linear in output. Components are found by alternating large-star and
small-star steps over tables, each a pre-aggregated minimum and a join.

Fingerprints are the nodes, so what a row links to follows from its text alone, whatever its doc_id.

Defined results: texts without words have fingerprint zero and are linked like any other; null text is
empty; rows without doc_id are linked like any other, and a component has the smallest doc_id of its
rows, null if none has any; repeated rows, and different texts under one doc_id, are rows of their own;
an empty table gives an empty result. `deduplicate` keeps exactly one row of each component: that with
the least doc_id (null last), then the least digest of its text, then of all its columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import bounded_batches, materialise

BITS, SHINGLE, SEED, DISTANCE = 64, 4, 42, 4
SAMPLE, LIGHT, BLOCK, PIVOTS = 2048, 64, 2048, 16
#: A probe that is sent costs about as much as so many candidates that are compared.
PROBE_COST = 8.0


def fingerprint(data: bytes) -> int:
    """Of a text in UTF-8, as an unsigned number."""
    words = data.lower().split()  # bytes: only A-Z change; splits at space and 9 to 13
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    shingles = [b" ".join(words[i : i + SHINGLE]) for i in range(n)] if n > 1 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *extra: tuple[str, Column]) -> DataFrame:
    """Rows (doc_id, fp) and extra string columns; fp has the fingerprint's bits as a signed long."""
    names = ["doc_id", "fp", *[k for k, _ in extra]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"") for t in b.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *[v.alias(k) for k, v in extra]).mapInArrow(run, ", ".join([f"doc_id {kind}, fp long", *[f"{k} string" for k, _ in extra]]))


def _together(nodes: DataFrame) -> np.ndarray:
    """How many of all nodes have bits i and j both (64 x 64); each partition sends one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    out = np.zeros(BITS * BITS, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out.reshape(BITS, BITS)


def bit_order(together: np.ndarray, n: int) -> list[int]:
    """All bits, each near those it's correlated with: from the bit with the strongest ties on to the nearest left."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    order = [int(corr.sum(axis=1).argmax())]
    left = set(range(BITS)) - set(order)
    while left:
        nearest = max(sorted(left), key=lambda j: corr[order[-1], j])
        order.append(nearest)
        left.remove(nearest)
    return order


def allocate(cost: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = distance + 1; cost[i][t + 1] is part i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, extra in enumerate(part):
                if used + k <= distance + 1 and (used + k not in step or c + extra < step[used + k][0]):
                    step[used + k] = (c + extra, [*ts, k - 1])
        best = step
    return best.get(distance + 1, (math.inf, []))


def design(order: list[int], sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Parts as (mask, threshold) for n nodes."""
    sample = np.unique(sample)
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, order].astype(np.float32)
    group = {int(x): int(x) for x in sample}
    for x, y in forest(sample, 2 * distance):  # nodes that a pivot may have as neighbours differ by so much; x has its group already
        group[y] = group[x]
    names = np.array([group[int(x)] for x in sample], np.uint64)
    apart = (names[:, None] != names[None, :])[np.triu_indices(len(sample), 1)]
    chosen: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(1, distance + 2):
        edges = [round(i * BITS / m) for i in range(m + 1)]
        cost = []
        for a, b in zip(edges, edges[1:]):
            x = bits[:, a:b]
            d = x.sum(axis=1)[:, None] + x.sum(axis=1)[None, :] - 2 * (x @ x.T)
            d = d[np.triu_indices(len(x), 1)]
            line = [0.0]
            for t in range(distance + 1):
                probes = sum(math.comb(b - a, k) for k in range(t + 1))
                chance = probes / 2.0 ** (b - a)
                met = max(float(((d <= t) & apart).mean()) if len(d) else 0.0, chance)
                line.append(PROBE_COST * n * probes + n * n * met if probes <= 5000 else math.inf)
            cost.append(line)
        total, ts = allocate(cost, distance)
        if total < chosen[0]:
            masks = [sum(1 << (BITS - 1 - bit) for bit in order[a:b]) for a, b in zip(edges, edges[1:])]
            chosen = (total, [(mask, t) for mask, t in zip(masks, ts) if t >= 0])
    return chosen[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(mask: int, t: int) -> list[int]:
    """All ways to flip up to t bits of a mask."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [sum(c) for k in range(t + 1) for c in combinations(bits, k)]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect all of the fingerprints that are connected at all, one fewer than each component has."""
    left, out = np.unique(fps), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                left = left[~near]
                out += [(int(x), int(y)) for y in new]
                todo += list(new)
    return out


def links(nodes: DataFrame, parts: list[tuple[int, int]], distance: int = DISTANCE, light: int = LIGHT, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Rows (a, b) of fingerprints that link; of keys that many nodes share, enough to keep all components."""
    own = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for i, (mask, _) in enumerate(parts)])

    def around(i: int, mask: int, t: int):
        at = lambda f: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask))).bitwiseXOR(f).alias("key"))
        return F.transform(F.array(*[F.lit(signed(f)) for f in flips(mask, t)]), at)

    near = F.flatten(F.array(*[around(i, mask, t) for i, (mask, t) in enumerate(parts)]))
    index = nodes.select("fp", F.explode(own).alias("k")).select("k.part", "k.key", "fp")
    probes = nodes.select("fp", F.explode(near).alias("k")).select("k.part", "k.key", F.col("fp").alias("other"))
    heavy = materialise(index.groupBy("part", "key").agg(F.count("*").alias("n_index")).where(F.col("n_index") > light), "simhash-heavy", few=True)
    few = index.join(heavy, ["part", "key"], "left_anti").join(probes, ["part", "key"])
    few = few.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    if heavy.isEmpty():
        return few
    flipped = F.get(F.array(*[F.array(*[F.lit(signed(f)) for f in flips(mask, t)]) for mask, t in parts]), F.col("part"))
    around = heavy.select("part", "key", F.explode(flipped).alias("flip")).select("part", "key", F.col("key").bitwiseXOR(F.col("flip")).alias("from"))
    around = materialise(around, "simhash-around", few=True)
    return few.unionByName(_heavy_links(index, around, heavy.select("part", "key"), distance, block, pivots)).distinct()


def _heavy_links(index: DataFrame, around: DataFrame, heavy: DataFrame, distance: int, block: int, pivots: int) -> DataFrame:
    """Links of the heavy keys' nodes (part, key, fp) and of those with a key (from) around them: to pivots, and of cells."""
    by = ["part", "key"]
    chosen = index.join(heavy, by).groupBy(*by, F.pmod(F.xxhash64("fp"), F.lit(pivots)).alias("slot")).agg(F.min("fp").alias("fp"))
    chosen = materialise(chosen.groupBy(*by).agg(F.array_sort(F.collect_list("fp")).alias("pivots")), "simhash-pivots", few=True)  # at most PIVOTS a key
    close = F.filter("pivots", lambda p: F.bit_count(p.bitwiseXOR(F.col("fp"))) <= distance)
    probes = index.withColumnRenamed("key", "from").join(around, ["part", "from"])
    reached = probes.join(chosen, by).select(*by, "fp", close.alias("near"), (F.col("from") == F.col("key")).alias("own"))
    reached = materialise(reached, "simhash-reached")
    to_first = reached.where(F.size("near") > 0).select("fp", F.col("near")[0].alias("p"))
    between = reached.where(F.size("near") > 1).select("fp", F.col("near")[0].alias("p"), F.explode(F.slice("near", 2, pivots)).alias("q"))
    between = materialise(between.groupBy("p", "q").agg(F.min("fp").alias("fp")), "simhash-among", few=True)  # a neighbour of both
    edge = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # pivots linked by way of a neighbour are one class, named by its least pivot
    roots = components(between.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("p"), "root")
    tagged = reached.withColumn("p", F.get("near", F.lit(0))).join(roots, "p", "left").select(*by, "fp", "own", F.coalesce("root", "p").alias("class"))
    tagged = materialise(tagged, "simhash-tagged")
    sizes = tagged.where("class IS NOT NULL").groupBy(*by, "class").agg(F.count("*").alias("n"))
    main = materialise(sizes.groupBy(*by).agg(F.max_by("class", F.struct("n", "class")).alias("main")), "simhash-main", few=True)
    tagged = tagged.join(main, by, "left").select(*by, "fp", "own", F.coalesce(F.col("class") == F.col("main"), F.lit(False)).alias("inside"))
    pairs = _cells(tagged.where("own AND NOT inside").select(*by, "fp"), tagged.select(*by, "fp"), distance, block)
    pairs = pairs.unionByName(_cells(tagged.where("own AND inside").select(*by, "fp"), tagged.where("NOT inside").select(*by, "fp"), distance, block))
    return edge(to_first, "fp", "p").unionByName(edge(between, "fp", "p")).unionByName(edge(between, "fp", "q")).unionByName(pairs)


def _cells(left: DataFrame, right: DataFrame, distance: int, block: int) -> DataFrame:
    """Links (a, b) between rows of left and right with the same (part, key), dealt to cells of two blocks."""
    by = ["part", "key"]
    count = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialise(count(left, "rows").join(count(right, "cols"), by), "simhash-cells", few=True)
    own_block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    a = left.join(sizes, by).select(*by, own_block("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "fp")
    b = right.join(sizes, by).select(*by, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), own_block("cols").alias("col"), "fp")

    def cell(table: pa.Table) -> pa.Table:
        pairs = np.array(forest(table.column("fp").to_numpy().view(np.uint64), distance), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return a.unionByName(b).groupBy(*by, "row", "col").applyInArrow(cell, "a long, b long")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """Rows (fp, root, rep) for all distinct fingerprints of prints (doc_id, fp): the least fingerprint of the component, and the smallest doc_id of its rows."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes", few=True)
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    parts = design(bit_order(_together(nodes), n), sample, n, distance)
    found = materialise(links(nodes, parts, distance), "simhash-links", few=True)
    roots = materialise(components(found).select(F.col("node").alias("fp"), "root"), "simhash-roots", few=True)
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = materialise(linked.join(least, "root").select("fp", "root", "least"), "simhash-linked", few=True)
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("rep"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, fp, component_id) for all of docs."""
    bounded_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs), "simhash-fingerprints")
    return prints.join(_classes(prints, distance).select("fp", F.col("rep").alias("component_id")), "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component of near-duplicates."""
    bounded_batches(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    prints = materialise(fingerprints(docs, ("__hx_digest", digest)), "simhash-fingerprints")
    roots = _classes(prints, distance).select("fp", "root")
    rows = materialise(prints.join(roots, "fp").groupBy("root", "doc_id", "__hx_digest").agg(F.count("*").alias("n")), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__hx_digest")
    best = rows.groupBy("root").agg(F.min(place).alias("b"), F.count("*").alias("texts"))
    best = materialise(best.select("root", "b", "texts"), "simhash-best")
    # what goes: all keys (doc_id, digest) of components with several but the best one; and what of the best stands for several rows
    gone = rows.join(best.where("texts > 1"), "root").where(place != F.col("b")).select(F.col("doc_id").alias("__hx_id"), F.col("__hx_digest").alias("__hx_of"))
    gone = materialise(gone, "simhash-gone", few=True)
    same = F.col("doc_id").eqNullSafe(F.col("__hx_id")) & (F.col("__hx_digest") == F.col("__hx_of"))
    again = rows.where("n > 1").select(F.col("doc_id").alias("__hx_id"), F.col("__hx_digest").alias("__hx_of"))
    again = materialise(again, "simhash-again", few=True)
    given = [F.col(f"`{c}`") for c in docs.columns]
    # texts are shuffled once at any size: where rows that go fit into a broadcast follows from the corpus
    kept = docs.withColumn("__hx_digest", digest).join(gone.hint("merge"), same, "left_anti")
    if again.isEmpty():
        return kept.select(*given)
    every = F.struct(*given)
    repeated = kept.join(again, same, "left_semi").groupBy("doc_id", "__hx_digest").agg(F.min_by(every, F.sha2(F.to_json(every), 256)).alias("__hx_row"))
    repeated = repeated.select(*[F.col(f"__hx_row.`{c}`").alias(c) for c in docs.columns])
    return kept.join(again, same, "left_anti").select(*given).unionByName(repeated)
