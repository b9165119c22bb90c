"""More queries: the complete walk, annotation, contig aliases, evidence joins, matrices' last steps, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encode
from ..operators import annotation, cohort, hierarchy, joins, models, selection, tables, traverse
from ..sources import writers
from ..storage import materialise
from . import adapters as a
from .registry import query


def r6(c):
    return F.round(c, 6)


# the complete walk ----------------------------------------------------------------------------------

_WALK = f"""{a.PROFILES}, sc AS (SELECT x.sample, p.node, p.child, round(avg(1 - abs(x.value - p.mean)), 9) AS score FROM matrix x JOIN profiles p USING (feature) WHERE x.value IS NOT NULL GROUP BY ALL),
tot AS (SELECT sample, node, sum(score) AS t FROM sc GROUP BY ALL), top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY sample, node ORDER BY score DESC, child) = 1),
branch AS (SELECT sample, node, string_split(child, '|')[-1] AS branch, score / t AS sup FROM top JOIN tot USING (sample, node)),
nodes AS (SELECT '' AS node, 'region' AS lc, 'success' AS status, NULL AS constant UNION ALL SELECT r_name, 'nation', CASE r_name WHEN 'ASIA' THEN 'constant' WHEN 'AFRICA' THEN 'failed' ELSE 'success' END, CASE r_name WHEN 'ASIA' THEN 'NATION_8' END FROM region),
smp AS (SELECT DISTINCT sample FROM matrix), gate AS (SELECT sample, r_name AS node, CASE WHEN sample % 9 = 0 THEN 'abstain' ELSE 'predict' END AS verdict FROM smp, region),
fb AS (SELECT sample, 2 AS depth, CASE WHEN sample % 5 <> 0 THEN 'NATION_0' END AS label, CASE WHEN sample % 4 = 0 THEN 1.0 ELSE 0.0 END AS support FROM smp), pol AS (SELECT 'nation' AS lc, n_name AS class, count(*) < 5 AS review FROM slabels GROUP BY n_name),
one AS (SELECT sample, 1 AS depth, '' AS node, 'region' AS lc, 'success' AS status, branch AS label, sup AS support, NULL AS reason FROM branch WHERE node = ''),
t2 AS (SELECT one.sample, one.label AS node, n.lc, n.status AS ns, n.constant, g.verdict, b.branch, b.sup, fb.label AS other, fb.support AS os FROM one LEFT JOIN nodes n ON n.node = one.label LEFT JOIN gate g ON g.sample = one.sample AND g.node = one.label LEFT JOIN branch b ON b.sample = one.sample AND b.node = one.label AND n.status = 'success' AND g.verdict = 'predict' LEFT JOIN fb ON fb.sample = one.sample),
s2 AS (SELECT *, CASE WHEN ns = 'constant' THEN 'constant' WHEN ns = 'success' AND verdict = 'abstain' THEN 'abstained' WHEN ns = 'success' AND branch IS NOT NULL THEN 'success' ELSE 'unavailable' END AS s FROM t2),
w2 AS (SELECT *, CASE WHEN s = 'unavailable' THEN 'branch_node_unavailable' WHEN s = 'success' AND branch <> other AND os >= sup THEN 'global_lineage_disagreement_recovery' END AS why FROM s2),
two AS (SELECT sample, 2 AS depth, node, lc, CASE WHEN s IN ('constant', 'abstained') THEN s WHEN why IS NOT NULL AND other IS NOT NULL THEN 'global_lineage_fallback' WHEN s = 'success' THEN 'success' ELSE 'stopped' END AS status,
  CASE WHEN s = 'constant' THEN constant WHEN s = 'abstained' THEN NULL WHEN why IS NOT NULL AND other IS NOT NULL THEN other ELSE branch END AS label, CASE WHEN why IS NOT NULL AND other IS NOT NULL THEN os WHEN s = 'success' THEN sup END AS support, CASE WHEN why IS NOT NULL AND other IS NOT NULL THEN why END AS reason FROM w2),
steps AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query(f"WITH {_WALK} SELECT sample, depth, node, steps.lc AS label_column, status, label, CASE WHEN review THEN 'review_required' ELSE label END AS reported, round(support, 6) AS support, reason FROM steps LEFT JOIN pol ON pol.lc = steps.lc AND pol.class = steps.label")
def hierarchy_walk(s, d):
    """Gates, a constant and a failed node, a global model's fallback, rare classes for review."""
    m, _, prof = a.trained(s, d)
    scorer = lambda f: hierarchy.profile_scores(f, m, prof).where("n > 0").withColumn("score", F.round("score", 9))
    region = a.table(s, d, "region")
    root = s.createDataFrame([("", "region", "success", None)], "node string, label_column string, status string, constant string")
    rest = region.select(F.col("r_name").alias("node"), F.lit("nation").alias("label_column"), F.when(F.col("r_name") == "ASIA", "constant").when(F.col("r_name") == "AFRICA", "failed").otherwise("success").alias("status"), F.when(F.col("r_name") == "ASIA", "NATION_8").alias("constant"))
    samples = m.select("sample").distinct()
    regions = region.groupBy().agg(F.collect_list("r_name").alias("r"))  # five
    gates = samples.join(F.broadcast(regions)).select("sample", F.explode("r").alias("node"), F.when(F.col("sample") % 9 == 0, "abstain").otherwise("predict").alias("verdict"))
    fallback = samples.select("sample", F.lit(2).alias("depth"), F.when(F.col("sample") % 5 != 0, "NATION_0").alias("label"), F.when(F.col("sample") % 4 == 0, 1.0).otherwise(0.0).alias("support"))
    labels = a.sample_labels(s, d).select(F.lit("nation").alias("label_column"), F.col("labels")[1].alias("label"))
    policy = hierarchy.support_policy(labels, 2, 5)
    out = traverse.walk(samples, root.unionByName(rest), scorer, gates, policy, fallback, 2)
    return out.withColumn("support", r6("support"))


@query("""SELECT c_custkey AS sample, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'model-' || lower(c_mktsegment) ELSE 'global' END AS model, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'group' ELSE 'global' END AS tier FROM customer""")
def two_level_routing(s, d):
    samples = a.table(s, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("level1"))
    groups = s.createDataFrame([("BUILDING", "g1"), ("MACHINERY", "g2")], "level1 string, grp string")
    m = s.createDataFrame([("group", "g1", "model-building"), ("group", "g2", "model-machinery"), ("global", None, "global"), ("binary", None, "bin")], "kind string, grp string, model string")
    return traverse.tiered_payload(samples, groups, m)


@query("SELECT c_nationkey AS sample, c_mktsegment AS path, max(c_acctbal) AS score FROM customer GROUP BY ALL")
def best_per_path(s, d):
    rows = a.table(s, d, "customer").select(F.col("c_nationkey").alias("sample"), F.col("c_mktsegment").alias("path"), F.col("c_acctbal").alias("score"))
    return tables.best_per_path(rows, ["sample", "path"], "score")


@query("SELECT c_nationkey AS sample, c_custkey AS id FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment) DESC) = 1")
def deepest_picks(s, d):
    rows = a.table(s, d, "customer").select(F.col("c_nationkey").alias("sample"), F.col("c_custkey").alias("id"), "c_mktsegment")
    return tables.deepest(rows, "sample", F.length("c_mktsegment")).select("sample", "id")


# calls and markers ----------------------------------------------------------------------------------


@query(f"""WITH {a.CALLS}, al AS (SELECT 'F' AS chrom, 'chrF' AS alias UNION ALL SELECT 'O', 'chrO' UNION ALL SELECT 'O', 'chrX'), req AS (SELECT l_suppkey AS sample, CASE WHEN l_partkey % 3 = 0 THEN 'F' WHEN l_partkey % 3 = 1 THEN 'chrF' ELSE 'chrX' END AS asked, l_partkey % 200 AS pos FROM lineitem GROUP BY ALL)
SELECT r.sample, r.asked, r.pos, coalesce(e.state, x.state) AS state, CASE WHEN e.state IS NOT NULL THEN 'exact' WHEN x.state IS NOT NULL THEN 'alias' ELSE 'absent' END AS match FROM req r LEFT JOIN latest e ON e.sample = r.sample AND e.chrom = r.asked AND e.pos = r.pos LEFT JOIN al ON al.alias = r.asked LEFT JOIN latest x ON x.sample = r.sample AND x.chrom = al.chrom AND x.pos = r.pos""")
def alias_lookup(s, d):
    """Calls by contig: as named, else by an alias, which must be unique."""
    calls = a.latest(s, d).select("sample", "chrom", "pos", "state")
    alias = s.createDataFrame([("F", "chrF"), ("O", "chrO"), ("O", "chrX")], "chrom string, asked string")  # three rows; a shuffle by contig would put all calls into as many tasks
    k = F.col("l_partkey") % 3
    req = a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.when(k == 0, "F").when(k == 1, "chrF").otherwise("chrX").alias("asked"), (F.col("l_partkey") % 200).alias("pos")).distinct()
    exact = calls.withColumnRenamed("chrom", "asked")
    return joins.tiered_lookup(req, [("exact", exact, True), ("alias", calls.join(F.broadcast(alias), "chrom"), True)], ["sample", "asked", "pos"], ["state"])


@query(f"WITH {a.RESOLVED} SELECT sample, feature, label, pos FROM resolved WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample, feature ORDER BY pos DESC) = 1")
def call_metadata(s, d):
    """The last call of each sample and feature."""
    return cohort.latest_calls(a.resolved(s, d).where("value IS NOT NULL").select("sample", "feature", "label", "pos"), ["sample", "feature"], ["pos"])


@query(f"WITH {a.CALLS} SELECT chrom, pos, ref, alt, row_number() OVER (ORDER BY chrom, pos, ref, alt) AS id FROM (SELECT DISTINCT chrom, pos, ref, alt FROM calls)")
def integer_variant_ids(s, d):
    """Numbers of distinct sites in order."""
    return tables.integer_ids(a.raw_calls(s, d), ["chrom", "pos", "ref", "alt"])


@query(f"WITH {a.RESOLVED} SELECT sample, feature, label FROM resolved WHERE value = 1 OR value IS NULL OR label = 'assumed_reference_non_baseline'")
def compact_calls(s, d):
    """The rows that a compact call table keeps: not baseline, not callable, or cautionary."""
    return a.resolved(s, d).where("value = 1 OR value IS NULL OR label = 'assumed_reference_non_baseline'").select("sample", "feature", "label")


@query(f"""WITH {a.CALLS}, {a.MATRIX}, c AS (SELECT chrom, pos, ref, allele, count(DISTINCT sample) AS n FROM latest WHERE state = 'CALLED_ALTERNATE' GROUP BY ALL) SELECT (SELECT count(DISTINCT sample) FROM latest) AS n_samples, count(*) AS n_candidate_sites, sum(n)::BIGINT AS n_events, count(*) FILTER (n >= 2 AND ref <> allele) AS n_kept_sites,
(SELECT count(DISTINCT sample) FROM matrix) AS n_matrix_samples, (SELECT count(DISTINCT feature) FROM matrix) AS n_matrix_features FROM c""")
def cohort_reconciliation(s, d):
    calls = a.latest(s, d)
    return tables.reconciliation(calls, cohort.sites(calls, 2), a.matrix(s, d))


@query("WITH x AS (SELECT event_id, 'v' || event_id % 5 || '=' || event_type AS feature, value FROM events) SELECT regexp_extract(feature, '^([^=]*)', 1) AS base, round(sum(value), 4) AS total, count(*) AS n FROM x GROUP BY base")
def folded_importances(s, d):
    """Importances of one-hot features, by base feature."""
    x = a.table(s, d, "events").select(F.concat(F.lit("v"), F.col("event_id") % 5, F.lit("="), "event_type").alias("feature"), "value")
    return x.groupBy(F.substring_index("feature", "=", 1).alias("base")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query(f"WITH {a.MATRIX}, {a.LABELS}, co AS (SELECT r_name AS class, feature, avg(value) - 0.5 AS coef FROM matrix JOIN slabels USING (sample) WHERE value IS NOT NULL GROUP BY ALL) SELECT sample, class, round(sum(coef * value), 6) + 0 AS score FROM matrix JOIN co USING (feature) WHERE value IS NOT NULL GROUP BY ALL")
def linear_contributions(s, d):
    m = a.matrix(s, d)
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("class"))
    coef = m.where("value IS NOT NULL").join(labels, "sample").groupBy("class", "feature").agg((F.avg("value") - 0.5).alias("coef"))
    return models.contributions(m, coef).groupBy("sample", "class").agg((r6(F.sum("contribution")) + 0).alias("score"))


@query(f"WITH {a.MATRIX}, {a.LABELS}, f0 AS (SELECT r_name AS child, feature, coalesce(value::INT::VARCHAR, 'N') AS state, count(*) AS n FROM matrix JOIN slabels USING (sample) GROUP BY ALL), fr AS (SELECT child, feature, state, n / sum(n) OVER (PARTITION BY child, feature) AS freq FROM f0), ch AS (SELECT DISTINCT child FROM fr), mk AS (SELECT sample, feature, value::INT::VARCHAR AS state FROM matrix WHERE value IS NOT NULL) SELECT mk.sample, ch.child, round(avg(coalesce(fr.freq, 0)), 6) AS score FROM mk CROSS JOIN ch LEFT JOIN fr ON fr.child = ch.child AND fr.feature = mk.feature AND fr.state = mk.state GROUP BY ALL")
def symbol_profiles(s, d):
    m = a.matrix(s, d)
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("child"))
    state = F.col("value").cast("int").cast("string")
    n = m.join(labels, "sample").groupBy("child", "feature", F.coalesce(state, F.lit("N")).alias("state")).agg(F.count("*").alias("n"))
    freq = n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("child", "feature"))).withColumn("node", F.lit("")).drop("n")
    out = hierarchy.symbol_scores(m.select("sample", F.lit("").alias("node")).distinct(), m.select("sample", "feature", state.alias("state")), freq)
    return out.select("sample", "child", r6("score").alias("score"))


# sequences and annotation ---------------------------------------------------------------------------

_GENOME = "genome AS (SELECT 'c' || p_size % 5 AS contig, string_agg(substr('ACGT', (p_partkey * 7 + p_size) % 4 + 1, 1), '' ORDER BY p_partkey) AS seq FROM part GROUP BY p_size % 5)"


def _genome(s, d):
    """Five contigs of letters from all parts."""
    letter = F.substring(F.lit("ACGT"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 4 + 1).cast("int"), F.lit(1))
    each = F.array_sort(F.collect_list(F.struct("p_partkey", letter.alias("l"))))
    return a.table(s, d, "part").groupBy(F.concat(F.lit("c"), F.col("p_size") % 5).alias("contig")).agg(F.array_join(F.transform(each, lambda x: x["l"]), "").alias("seq"))


def _snps(s, d):
    """The genome, and a variant in each three letters; letters come from tiles, so no row of a place carries its contig."""
    g = materialise(_genome(s, d), "genome")  # read for the variants and for the tiles
    at = annotation.tiles(g).select("contig", "tile", F.posexplode(F.split("piece", "")).alias("i", "ref"))
    at = at.select("contig", (F.col("tile") * annotation.TILE + F.col("i") + 1).alias("pos"), "ref").withColumn("k", F.floor((F.col("pos") + 2) / 3))
    at = at.where(F.col("pos") == F.col("k") * 3 - 2 + F.col("k") % 3)
    return g, at.select("contig", "pos", F.when(F.col("k") % 20 == 0, "N").otherwise(F.col("ref")).alias("ref"), F.translate("ref", "ACGT", "CGTA").alias("alt"))


_PARTS = [("c0", 0, 0, 10, 60, 1), ("c0", 1, 0, 50, 100, -1), ("c1", 2, 0, 20, 40, -1), ("c1", 2, 1, 60, 81, -1), ("c2", 3, 0, 200, 262, 1), ("c3", 4, 0, 5, 7, 1), ("c3", 4, 1, 11, 13, 1), ("c3", 4, 2, 30, 32, 1)]
_CODON = "".join(f" WHEN '{x}{y}{z}' THEN '{'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * i + 4 * j + k]}'" for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for k, z in enumerate("TCAG"))
_RC = lambda x: f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


@query(
    f"""WITH {_GENOME}, kk AS (SELECT contig, seq, unnest(range(1, (length(seq) + 2) // 3 + 1)) AS k FROM genome), s0 AS (SELECT contig, seq, k, k * 3 - 2 + k % 3 AS pos FROM kk WHERE k * 3 - 2 + k % 3 <= length(seq)), snps AS (SELECT contig, pos, seq, CASE WHEN k % 20 = 0 THEN 'N' ELSE substr(seq, pos, 1) END AS ref, translate(substr(seq, pos, 1), 'ACGT', 'CGTA') AS alt FROM s0),
parts AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {f}, {p}, {x}, {y}, {z})" for c, f, p, x, y, z in _PARTS)}) t(contig, feature_order, part_order, s, e, strand)),
cds AS (SELECT p.contig, feature_order, string_agg(CASE WHEN strand < 0 THEN {_RC("substr(seq, s, e - s + 1)")} ELSE substr(seq, s, e - s + 1) END, '' ORDER BY CASE WHEN strand < 0 THEN -s ELSE s END) AS coding FROM parts p JOIN genome USING (contig) GROUP BY ALL),
offs AS (SELECT *, coalesce(sum(e - s + 1) OVER (PARTITION BY feature_order ORDER BY CASE WHEN strand < 0 THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS o FROM parts),
hit AS (SELECT n.contig, pos, ref, alt, feature_order, strand, o + CASE WHEN strand < 0 THEN e - pos ELSE pos - s END AS i FROM snps n JOIN offs USING (contig) WHERE pos BETWEEN s AND e AND ref <> 'N'),
cod AS (SELECT hit.*, substr(coding, (i // 3) * 3 + 1, 3) AS codon, CASE WHEN strand < 0 THEN {_RC("alt")} ELSE alt END AS letter FROM hit JOIN cds USING (contig, feature_order)),
alt_ AS (SELECT *, substr(codon, 1, (i % 3)::INT) || letter || substr(codon, (i % 3)::INT + 2, 2) AS ac FROM cod),
aa_ AS (SELECT *, CASE WHEN length(codon) <> 3 THEN NULL ELSE CASE codon{_CODON} ELSE 'X' END END AS aa, CASE WHEN length(ac) <> 3 THEN NULL ELSE CASE ac{_CODON} ELSE 'X' END END AS alt_aa FROM alt_)
SELECT contig, pos, 'coding' AS region, feature_order, (i // 3 + 1)::INT AS codon_number, codon, ac AS alt_codon, CASE WHEN aa = alt_aa THEN 'synonymous' WHEN alt_aa = '*' THEN 'nonsense' WHEN aa = '*' THEN 'stop_loss' ELSE 'missense' END AS effect FROM aa_
UNION ALL SELECT contig, pos, CASE WHEN ref = 'N' THEN 'ref_mismatch' ELSE 'non_coding' END, NULL, NULL, NULL, NULL, NULL FROM snps n WHERE ref = 'N' OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.contig = n.contig AND h.pos = n.pos)"""
)
def snp_annotation(s, d):
    g, snps = _snps(s, d)
    parts = s.createDataFrame(_PARTS, "contig string, feature_order int, part_order int, start long, end long, strand int")
    out = annotation.annotate(snps, parts, g, 50)
    return out.select("contig", "pos", "region", F.when(F.col("region") == "coding", F.col("feature_order")).alias("feature_order"), "codon_number", "codon", "alt_codon", "effect")


@query(f"WITH {_GENOME}, kk AS (SELECT contig, seq, unnest(range(1, (length(seq) + 2) // 3 + 1)) AS k FROM genome), s0 AS (SELECT contig, seq, k * 3 - 2 + k % 3 AS pos FROM kk WHERE k * 3 - 2 + k % 3 <= length(seq)) SELECT contig, pos, array_to_string(list_transform(range(-10, 11), lambda j: substr(seq, ((pos - 1 + j) % length(seq) + length(seq)) % length(seq) + 1, 1)), '') AS context FROM s0")
def snp_contexts(s, d):
    g, snps = _snps(s, d)
    return annotation.contexts(snps.select("contig", "pos"), g, 10)


# matrices' last steps -------------------------------------------------------------------------------


@query(f"""WITH {a.MATRIX}, n AS (SELECT feature, least(count(*) FILTER (value = 0), count(*) FILTER (value = 1)) AS minor FROM matrix GROUP BY feature), ok AS (SELECT feature FROM n WHERE minor >= 3 AND feature % 3 <> 0), f AS (SELECT feature FROM ok UNION SELECT feature FROM n WHERE feature IN (5, 6, 9))
SELECT sample, feature, value FROM matrix WHERE feature IN (SELECT feature FROM f)""")
def final_matrix(s, d):
    """Minor count and type, then features that are kept by force."""
    m = a.matrix(s, d)
    ok = cohort.minor_counts(m).where("minor >= 3 AND feature % 3 <> 0").select("feature")
    keep = ok.unionByName(m.where("feature IN (5, 6, 9)").select("feature")).distinct()
    return m.join(keep, "feature", "left_semi").select("sample", "feature", "value")


@query(f"WITH {a.MATRIX}, p AS (SELECT x.sample AS i, y.sample AS j, count(*) / (SELECT count(DISTINCT feature) FROM matrix) AS c FROM matrix x JOIN matrix y ON x.feature = y.feature AND x.sample < y.sample WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY ALL) SELECT i, j, round(c, 6) AS complete FROM p WHERE c >= 0.025")
def pairwise_complete(s, d):
    """Pairs of samples with enough features that both have."""
    return tables.pairwise_complete(a.matrix(s, d), 0.025).withColumn("complete", r6("complete"))


@query(f"WITH {a.MATRIX} SELECT feature, string_agg(coalesce(value::INT::VARCHAR, '?'), '' ORDER BY sample) AS states FROM matrix GROUP BY feature")
def transposed_states(s, d):
    """Features as rows: each one's states over the samples, in order."""
    v = F.coalesce(F.col("value").cast("int").cast("string"), F.lit("?"))
    each = F.array_sort(F.collect_list(F.struct("sample", v.alias("v"))))
    return a.matrix(s, d).groupBy("feature").agg(F.array_join(F.transform(each, lambda x: x["v"]), "").alias("states"))


@query(f"WITH {a.MATRIX} SELECT sample, string_agg(coalesce(value::INT::VARCHAR, 'N'), '' ORDER BY feature) AS seq FROM matrix WHERE feature % 2 = 1 GROUP BY sample")
def masked_sequences(s, d):
    """Each sample's states as a sequence over the kept columns."""
    m = a.matrix(s, d)
    kept = m.select("feature").distinct().where("feature % 2 = 1")
    v = F.coalesce(F.col("value").cast("int").cast("string"), F.lit("N"))
    each = F.array_sort(F.collect_list(F.struct("feature", v.alias("v"))))
    return m.join(kept, "feature", "left_semi").groupBy("sample").agg(F.array_join(F.transform(each, lambda x: x["v"]), "").alias("seq"))


@query(f"WITH {a.MATRIX} SELECT (SELECT count(*) FROM ((SELECT DISTINCT sample FROM matrix) EXCEPT SELECT s_suppkey FROM supplier)) = 0 AND (SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT sample FROM matrix)) = 0 AS same")
def same_samples(s, d):
    return hierarchy.same_rows(a.matrix(s, d).select("sample").distinct(), a.table(s, d, "supplier").select(F.col("s_suppkey").alias("sample")))


@query("SELECT c_custkey, c_mktsegment || '|' || c_nationkey AS label FROM customer")
def evaluation_labels(s, d):
    """A leading number goes if every row has one and at least four parts."""
    rows = a.table(s, d, "customer").select("c_custkey", F.concat_ws(" | ", "c_custkey", "c_mktsegment", "c_nationkey", F.lit("s")).alias("field"))
    return tables.evaluation_labels(rows, "field").select("c_custkey", "label")


@query("SELECT o_orderstatus AS status, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(s, d):
    """Extension."""
    o = a.table(s, d, "orders").where("o_totalprice IS NOT NULL")
    return o.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumnRenamed("o_orderstatus", "status")


@query(f"""WITH {a.CALLS} SELECT sample, chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || CASE WHEN state LIKE 'CALLED%' AND allele <> ref THEN allele ELSE '.' END || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || dp::INT || ';AF=1.000' || chr(9) || 'GT:DP' || chr(9)
  || CASE WHEN state NOT LIKE 'CALLED%' THEN './.' WHEN allele = ref THEN '0/0' ELSE '1/1' END || ':' || dp::INT AS value FROM latest""")
def vcf_text(s, d):
    """The VCF lines of all samples' calls."""
    calls = cohort.latest_calls(a.classified(s, d).select("sample", "chrom", "pos", "ref", "alt", "state", "allele", "dp", *a.LAST), ["sample", "chrom", "pos"], a.LAST)
    calls = calls.select("sample", "chrom", "pos", "ref", "allele", F.col("dp").cast("int").alias("depth"), F.lit(1.0).alias("fraction"), F.when(F.col("state").startswith("CALLED"), "called").otherwise("low_depth").alias("state"))
    return writers.vcf_body(calls).select("sample", "value")


# models (their fits have no SQL) --------------------------------------------------------------------


def _training(s, d):
    m = a.matrix(s, d)
    features = list(range(1, 201))
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("label"))
    return models.table(m, features), labels, features


@query(None)
def random_forest(s, d):
    wide, labels, features = _training(s, d)
    return models.predict(models.train(wide, labels, features, models.ESTIMATORS["random_forest"]()), wide)


@query(None)
def logistic_regression(s, d):
    wide, labels, features = _training(s, d)
    return models.predict(models.train(wide, labels, features, models.ESTIMATORS["logistic_regression"]()), wide)


@query(None)
def decision_tree_gated(s, d):
    """Samples whose gate abstains get no prediction."""
    wide, labels, features = _training(s, d)
    verdicts = wide.select("sample", F.when(F.col("sample") % 3 == 0, "abstain").otherwise("predict").alias("verdict"))
    return models.predict(models.train(wide, labels, features, models.ESTIMATORS["decision_tree"]()), wide, verdicts)


@query(None)
def model_recommendation(s, d):
    """(level, model, score) of all eight candidates by stratified folds, over both levels of the labels; a level without folds has the fallback, without a score."""
    wide, labels, features = _training(s, d)
    wide = materialise(wide, "recommendation-wide", few=True)  # read for each level
    levels = [("region", labels), ("nation", a.sample_labels(s, d).select("sample", F.array_join("labels", "|").alias("label")))]
    got = [(name, model, score) for name, own in levels for model, score in models.search(wide, own, features)]
    return s.createDataFrame(got, "level string, model string, score double")
