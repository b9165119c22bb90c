"""The driver's tables as relations of the engine, and the same relations as DuckDB SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, genotype
from ..operators import cohort, hierarchy
from ..storage import materialise

LAST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records from line items: a supplier is a sample, a part (modulo 200) a position."""
    base = lambda n: F.expr(f"substring('ACGT', cast(({n}) % 4 AS int) + 1, 1)")
    gt = F.when(F.col("l_orderkey") % 7 == 0, "0/1").when(F.col("l_returnflag") == "A", "1/1").when(F.col("l_returnflag") == "N", "0").otherwise("./.")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample"),
        F.col("l_linestatus").alias("chrom"),
        (F.col("l_partkey") % 200).alias("pos"),
        base("l_partkey").alias("ref"),
        base("l_partkey + 1 + l_orderkey % 3").alias("alt"),
        F.col("l_quantity").alias("qual"),
        F.round(F.col("l_discount") * 200).alias("dp"),
        (F.col("l_tax") * 1000).alias("mq"),
        F.when(F.col("l_linenumber") == 7, "q10").otherwise("PASS").alias("filter"),
        gt.alias("gt"),
        *LAST,
    )


def classified(spark: SparkSession, sf_dir: str, q: genotype.Quality = genotype.Quality()) -> DataFrame:
    df = raw_calls(spark, sf_dir)
    null = F.lit(None).cast("double")
    df = df.withColumn("reasons", genotype.qc_reasons(F.col("qual"), F.col("filter"), F.col("dp"), null, F.col("mq"), null, q))
    df = df.withColumn("state", genotype.record_state(F.col("ref"), F.col("alt"), F.col("gt"), F.size("reasons") > 0, None, q))
    return df.withColumn("allele", genotype.called_allele(F.col("ref"), F.col("alt"), F.col("gt"), F.col("state")))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.latest_calls(classified(spark, sf_dir).select("sample", "chrom", "pos", "ref", "alt", "state", "allele", *LAST), ["sample", "chrom", "pos"], LAST)


def gvcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified records of gVCFs from line items: symbolic alternates, several, none, and blocks."""
    base = F.expr("substring('ACGT', cast(l_partkey % 4 AS int) + 1, 1)")
    alt = F.element_at(F.array(*[F.lit(x) for x in ("C,<NON_REF>", "<NON_REF>", ".", "C,G,<NON_REF>", "g", "<*>")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    gt = F.element_at(F.array(*[F.lit(x) for x in ("0/0", "1/1", "2/2", "0|0", "./1")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line_no")
    pos = F.col("l_partkey") % 200
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_linestatus").alias("chrom"), pos.alias("pos"), (pos + F.col("l_suppkey") % 9).alias("end"), F.when(F.col("l_partkey") % 11 == 0, "AT").otherwise(base).alias("ref"), alt.alias("alt"), gt.alias("gt"), line)
    # records are many, their kinds few: each kind is classified once
    kinds = df.select("ref", "alt", "gt").distinct()
    kinds = kinds.withColumn("state", genotype.record_state(F.col("ref"), F.col("alt"), F.col("gt"), F.lit(False)))
    kinds = kinds.withColumn("allele", genotype.called_allele(F.col("ref"), F.col("alt"), F.col("gt"), F.col("state")))
    kinds = materialise(kinds.select(*[F.col(c).alias(f"__{c}") for c in ("ref", "alt", "gt")], "state", "allele"), "gvcf-kinds", few=True)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("ref", "alt", "gt")]
    df = df.join(kinds, same[0] & same[1] & same[2]).select(*df.columns, "state", "allele")
    return df.withColumn("block", genotype.is_reference_block(F.col("alt"), F.col("state"), F.col("pos"), F.col("end")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = lambda n: F.expr(f"substring('ACGT', cast(({n}) % 4 AS int) + 1, 1)")
    df = p.select(F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("chrom"), (F.col("p_partkey") % 200).alias("pos"), base("p_partkey").alias("ref"), base("p_partkey + 1 + p_size % 3").alias("alt")).distinct()
    df = df.withColumn("baseline", F.when(F.col("pos") % 5 == 0, F.col("alt")).otherwise(F.col("ref")))
    return df.select(F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("feature"), "chrom", "pos", "ref", "alt", "baseline")


def resolved(spark: SparkSession, sf_dir: str, absent_is_reference: bool = True) -> DataFrame:
    """Every (sample, feature) with its state, encoded value and label."""
    calls = materialise(latest(spark, sf_dir), "latest-calls")  # read for the samples and for their calls
    m = manifest(spark, sf_dir)
    grid = cohort.crossed(calls.select("sample").distinct(), m)
    c = calls.select("sample", "chrom", "pos", F.col("state").alias("called"), "allele")
    df = grid.join(c, ["sample", "chrom", "pos"], "left")
    absent = genotype.REFERENCE if absent_is_reference else genotype.ABSENT
    df = df.withColumns({"assumed": F.col("called").isNull() & F.lit(absent_is_reference), "state": F.coalesce("called", F.lit(absent)), "allele": F.when(F.col("called").isNull() & F.lit(absent_is_reference), F.col("ref")).otherwise(F.col("allele"))})
    df = df.withColumn("e", encode.encode(F.col("state"), F.col("allele"), F.col("ref"), F.col("alt"), F.col("baseline"), F.col("assumed"), F.lit(False)))
    return df.select("sample", "feature", "chrom", "pos", "state", "assumed", F.col("e.value").alias("value"), F.col("e.label").alias("label"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix (sample, feature, value) of suppliers and parts (modulo 200)."""
    li = table(spark, sf_dir, "lineitem")
    v = F.when(F.max((F.col("l_returnflag") == "A").cast("int")) == 1, 1.0).when(F.max((F.col("l_returnflag") == "N").cast("int")) == 1, 0.0)
    return li.groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 200 + 1).alias("feature")).agg(v.alias("value"))


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, labels): region and nation of each supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("sample"), F.array("r_name", "n_name").alias("labels"))


def trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, tree, profiles) of all suppliers."""
    m, labels = matrix(spark, sf_dir), sample_labels(spark, sf_dir)
    tree = hierarchy.prefixes(labels)
    members = labels.select("sample", F.explode(F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, 1, k), '|'))")).alias("child"))
    # both are read at every level of a walk
    m = materialise(m, "trained-matrix")
    return m, tree, materialise(hierarchy.profiles(m, members, tree), "trained-profiles", few=True)


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("pos"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals (k, start, end, ord) of users, of up to five hours, from events."""
    e = table(spark, sf_dir, "events")
    s = F.unix_timestamp("ts")
    return e.select(F.col("user_id").alias("k"), s.alias("start"), (s + F.col("event_id") % 11 * 1800).alias("end"), F.col("event_id").alias("ord"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), (F.unix_timestamp("ts") - 900).alias("pos"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"), "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association results (snp, p, fdr, gfdr, ord) of parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("snp"), F.col("l_tax").alias("p"), F.col("l_discount").alias("fdr"), F.round(F.col("l_quantity") / 100, 4).alias("gfdr"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"))


BASE = "substr('ACGT', (({n}) % 4)::INT + 1, 1)"
CALLS = f"""
calls AS (SELECT l_suppkey AS sample, l_linestatus AS chrom, l_partkey % 200 AS pos, {BASE.format(n="l_partkey")} AS ref, {BASE.format(n="l_partkey + 1 + l_orderkey % 3")} AS alt,
  l_quantity AS qual, round(l_discount * 200) AS dp, l_tax * 1000 AS mq, CASE WHEN l_linenumber = 7 THEN 'q10' ELSE 'PASS' END AS filter,
  CASE WHEN l_orderkey % 7 = 0 THEN '0/1' WHEN l_returnflag = 'A' THEN '1/1' WHEN l_returnflag = 'N' THEN '0' ELSE './.' END AS gt, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
judged AS (SELECT *, list_filter([CASE WHEN filter <> 'PASS' THEN 'FILTER' END, CASE WHEN qual < 30 THEN 'QUAL_low' END, CASE WHEN dp < 10 THEN 'DP_low' END, CASE WHEN mq < 40 THEN 'MQ_low' END], lambda x: x IS NOT NULL) AS reasons FROM calls),
classified AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'FILTERED_OR_LOW_QUALITY' WHEN gt = './.' THEN 'MISSING_OR_NO_CALL' WHEN gt = '0/1' THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN gt = '0' THEN 'CALLED_REFERENCE' ELSE 'CALLED_ALTERNATE' END AS state FROM judged),
called AS (SELECT *, CASE state WHEN 'CALLED_REFERENCE' THEN ref WHEN 'CALLED_ALTERNATE' THEN alt END AS allele FROM classified),
latest AS (SELECT * FROM called QUALIFY row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)"""
MANIFEST = f"""
m0 AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS chrom, p_partkey % 200 AS pos, {BASE.format(n="p_partkey")} AS ref, {BASE.format(n="p_partkey + 1 + p_size % 3")} AS alt FROM part GROUP BY ALL),
manifest AS (SELECT chrom || ':' || pos || ':' || ref || ':' || alt AS feature, chrom, pos, ref, alt, CASE WHEN pos % 5 = 0 THEN alt ELSE ref END AS baseline FROM m0)"""
RESOLVED = f"""{CALLS}, {MANIFEST},
grid AS (SELECT s.sample, m.*, l.state AS called, CASE WHEN l.state IS NULL THEN m.ref ELSE l.allele END AS allele, l.state IS NULL AS assumed, coalesce(l.state, 'CALLED_REFERENCE') AS state
  FROM (SELECT DISTINCT sample FROM latest) s CROSS JOIN manifest m LEFT JOIN latest l ON l.sample = s.sample AND l.chrom = m.chrom AND l.pos = m.pos),
labelled AS (SELECT *, CASE WHEN state = 'CALLED_REFERENCE' AND assumed AND allele <> baseline THEN 'assumed_reference_non_baseline' WHEN state = 'CALLED_REFERENCE' AND assumed THEN 'assumed_reference'
  WHEN state = 'CALLED_REFERENCE' AND allele = baseline THEN 'baseline_match' WHEN state = 'CALLED_REFERENCE' AND allele = alt THEN 'alt_match' WHEN state = 'CALLED_REFERENCE' THEN 'non_baseline_callable'
  WHEN state = 'CALLED_ALTERNATE' AND allele = alt THEN 'alt_match' WHEN state = 'CALLED_ALTERNATE' AND allele IN (baseline, ref) THEN 'baseline_match' WHEN state = 'CALLED_ALTERNATE' THEN 'non_training_allele' ELSE lower(state) END AS label FROM grid),
resolved AS (SELECT sample, feature, chrom, pos, state, assumed, CASE WHEN label IN ('assumed_reference', 'baseline_match') THEN 0.0::DOUBLE WHEN label IN ('assumed_reference_non_baseline', 'alt_match', 'non_baseline_callable') THEN 1.0::DOUBLE END AS value, label FROM labelled)"""
MATRIX = """
matrix AS (SELECT l_suppkey AS sample, l_partkey % 200 + 1 AS feature, CASE WHEN bool_or(l_returnflag = 'A') THEN 1.0::DOUBLE WHEN bool_or(l_returnflag = 'N') THEN 0.0::DOUBLE END AS value FROM lineitem GROUP BY ALL)"""
LABELS = """
slabels AS (SELECT s_suppkey AS sample, r_name, n_name, r_name || '|' || n_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PROFILES = f"""{MATRIX}, {LABELS},
members AS (SELECT sample, '' AS node, r_name AS child FROM slabels UNION ALL SELECT sample, r_name, path FROM slabels),
profiles AS (SELECT node, child, feature, avg(value) AS mean FROM matrix JOIN members USING (sample) WHERE value IS NOT NULL GROUP BY ALL)"""
BLOCKS = """
blocks AS (SELECT user_id AS k, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + event_id % 11 * 1800 AS end_, event_id AS ord FROM events),
probes AS (SELECT event_id AS id, user_id AS k, floor(epoch(ts))::BIGINT - 900 AS pos FROM events)"""
VECTORS = """
bits AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings),
pairs AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_sum(list_transform(range(1, len(a.bits) + 1), lambda k: a.bits[k] * b.bits[k])) AS c, list_sum(a.bits) AS ni, list_sum(b.bits) AS nj, len(a.bits) AS n FROM bits a JOIN bits b ON a.id < b.id),
dist AS (SELECT i, j, li, lj, CASE WHEN ni + nj = 0 THEN 0 ELSE 1 - c / (ni + nj - c) END AS d, (ni + nj - 2 * c) / n AS h FROM pairs)"""
PREDICTIONS = """
preds AS (SELECT l_partkey AS snp, l_tax AS p, l_discount AS fdr, round(l_quantity / 100, 4) AS gfdr, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem)"""
GVCF = f"""
glines AS (SELECT l_suppkey AS sample, l_linestatus AS chrom, l_partkey % 200 AS pos, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_partkey % 11 = 0 THEN 'AT' ELSE {BASE.format(n="l_partkey")} END AS ref,
  CASE l_orderkey % 6 WHEN 0 THEN 'C,<NON_REF>' WHEN 1 THEN '<NON_REF>' WHEN 2 THEN '.' WHEN 3 THEN 'C,G,<NON_REF>' WHEN 4 THEN 'g' ELSE '<*>' END AS alt, CASE l_linenumber % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '1/1' WHEN 2 THEN '2/2' WHEN 3 THEN '0|0' ELSE './1' END AS gt, l_partkey % 200 + l_suppkey % 9 AS end_ FROM lineitem),
gstate AS (SELECT *, alt LIKE '%<%' OR alt = '.' AS symbolic, len(list_filter(string_split(upper(alt), ','), lambda x: x NOT LIKE '<%' AND x <> '.')) AS nc, list_filter(string_split(upper(alt), ','), lambda x: x <> '.') AS alts FROM glines),
gcalled AS (SELECT *, CASE WHEN nc > 0 THEN list_filter(alts, lambda x: x NOT LIKE '<%') ELSE alts END AS counted, CASE WHEN gt IN ('0/0', '0|0') THEN 0 WHEN gt = '1/1' THEN 1 WHEN gt = '2/2' THEN 2 END AS idx FROM gstate),
gvcf AS (SELECT *, CASE WHEN NOT symbolic AND length(ref) > 1 THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN nc > 1 THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN idx IS NULL OR idx > len(counted) THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN idx = 0 THEN 'CALLED_REFERENCE' WHEN counted[idx] LIKE '<%' THEN 'UNRESOLVED_OR_AMBIGUOUS' ELSE 'CALLED_ALTERNATE' END AS state FROM gcalled),
gfinal AS (SELECT *, CASE state WHEN 'CALLED_REFERENCE' THEN ref WHEN 'CALLED_ALTERNATE' THEN counted[idx] END AS allele, coalesce(state = 'CALLED_REFERENCE' AND end_ > pos, false) AS block FROM gvcf),
glast AS (SELECT * FROM gfinal QUALIFY row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1),
gblocks AS (SELECT sample, chrom, pos AS start, end_, {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice}} AS ord, ref FROM gfinal WHERE block)"""
