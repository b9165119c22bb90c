"""Queries of call lookup, context search, stored models and node models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encode
from ..operators import boosting, hierarchy, kernels, lookup, models, stats, traverse
from ..sources import readers
from ..storage import materialise
from . import adapters as a
from .registry import query


def r6(c):
    return F.round(c, 6)


@query(f"WITH {a.GVCF.lstrip()} SELECT sample, chrom, pos, l_orderkey, l_linenumber, l_partkey, l_extendedprice, state, allele, block FROM gfinal")
def gvcf_records(s, d):
    """States of gVCF records: symbolic alternates, several, none, and blocks."""
    return a.gvcf(s, d).select("sample", "chrom", "pos", "line_no.*", "state", "allele", "block")


_LOOKUP = """al(source, target) AS (VALUES ('chrF', 'F'), ('chrX', 'O'), ('F', 'chrX')), cand AS (SELECT DISTINCT asked, chrom FROM (SELECT source AS asked, target AS chrom FROM al UNION ALL SELECT target, source FROM al) WHERE asked <> chrom),
req AS (SELECT DISTINCT l_suppkey AS sample, CASE l_partkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'chrF' WHEN 2 THEN 'chrX' ELSE 'Z' END AS chrom, l_partkey * 7 % 230 AS pos FROM lineitem),
pts AS (SELECT sample, chrom AS asked, chrom, pos, 0 AS tier FROM req UNION ALL SELECT r.sample, r.chrom, c.chrom, r.pos, 1 FROM req r JOIN cand c ON c.asked = r.chrom),
inblk AS (SELECT p.sample, p.chrom, p.pos, arg_min(b.ref, b.ord) AS ref FROM (SELECT DISTINCT sample, chrom, pos FROM pts) p JOIN gblocks b ON b.sample = p.sample AND b.chrom = p.chrom AND p.pos BETWEEN b.start AND b.end_ GROUP BY ALL),
hit AS (SELECT p.*, coalesce(l.state, 'CALLED_REFERENCE') AS state, CASE WHEN l.state IS NULL THEN b.ref ELSE l.allele END AS allele, l.state IS NULL AS blk FROM pts p LEFT JOIN glast l USING (sample, chrom, pos) LEFT JOIN inblk b USING (sample, chrom, pos) WHERE l.state IS NOT NULL OR b.ref IS NOT NULL),
own AS (SELECT * FROM hit WHERE tier = 0), other AS (SELECT sample, asked, pos, count(*) AS n, any_value(state) AS state, any_value(allele) AS allele, bool_or(blk) AS blk FROM hit WHERE tier = 1 GROUP BY ALL)"""


@query(f"""WITH {a.GVCF.lstrip()}, {_LOOKUP} SELECT r.sample, r.chrom, r.pos, CASE WHEN o.sample IS NOT NULL THEN o.state WHEN x.n = 1 THEN x.state END AS state, CASE WHEN o.sample IS NOT NULL THEN o.allele WHEN x.n = 1 THEN x.allele END AS allele, coalesce(CASE WHEN o.sample IS NOT NULL THEN o.blk WHEN x.n = 1 THEN x.blk END, false) AS from_block,
  CASE WHEN o.blk THEN 'gvcf_ref_block' WHEN o.sample IS NOT NULL THEN 'exact_sequence_position' WHEN x.n > 1 THEN 'ambiguous_contig_alias' WHEN x.blk THEN 'gvcf_ref_block_contig_alias' WHEN x.n = 1 THEN 'contig_alias' ELSE 'absent' END AS match
FROM req r LEFT JOIN own o ON o.sample = r.sample AND o.chrom = r.chrom AND o.pos = r.pos LEFT JOIN other x ON x.sample = r.sample AND x.asked = r.chrom AND x.pos = r.pos""")
def gvcf_lookup(s, d):
    """Requested places in gVCF calls: points, then blocks, then all aliases of the contig."""
    calls, blocks = readers.callset(a.gvcf(s, d))
    aliases = s.createDataFrame([("chrF", "F"), ("chrX", "O"), ("F", "chrX")], "source string, target string")
    k = F.col("l_partkey") % 4
    req = a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.when(k == 0, "F").when(k == 1, "chrF").when(k == 2, "chrX").otherwise("Z").alias("chrom"), (F.col("l_partkey") * 7 % 230).alias("pos")).distinct()
    return lookup.call_lookup(req, calls, blocks, aliases, width=16)


_FEATURES = _LOOKUP.split(",\npts AS")[0].split(",\nreq AS")[0] + """,
mf AS (SELECT CASE WHEN pos % 4 = 0 THEN 'chrF' WHEN pos % 4 = 1 THEN 'chrX' ELSE chrom END || ':' || pos || ':' || ref || ':' || alt AS feature, CASE WHEN pos % 4 = 0 THEN 'chrF' WHEN pos % 4 = 1 THEN 'chrX' ELSE chrom END AS chrom, pos, ref, alt, baseline FROM manifest),
mfd AS (SELECT DISTINCT * FROM mf), req AS (SELECT s.sample, m.* FROM (SELECT DISTINCT sample FROM glast) s CROSS JOIN mfd m),
pts AS""" + _LOOKUP.split(",\npts AS")[1].replace("FROM req UNION ALL", "FROM (SELECT DISTINCT sample, chrom, pos FROM req) UNION ALL").replace("FROM req r JOIN cand", "FROM (SELECT DISTINCT sample, chrom, pos FROM req) r JOIN cand")


@query(f"""WITH {a.GVCF.lstrip()}, {a.MANIFEST.lstrip()}, {_FEATURES},
looked AS (SELECT r.*, CASE WHEN o.sample IS NOT NULL THEN o.state WHEN x.n = 1 THEN x.state END AS st, CASE WHEN o.sample IS NOT NULL THEN o.allele WHEN x.n = 1 THEN x.allele END AS al, coalesce(CASE WHEN o.sample IS NOT NULL THEN o.blk WHEN x.n = 1 THEN x.blk END, false) AS from_block,
  CASE WHEN o.blk THEN 'gvcf_ref_block' WHEN o.sample IS NOT NULL THEN 'exact_sequence_position' WHEN x.n > 1 THEN 'ambiguous_contig_alias' WHEN x.blk THEN 'gvcf_ref_block_contig_alias' WHEN x.n = 1 THEN 'contig_alias' ELSE 'absent' END AS match
  FROM req r LEFT JOIN own o ON o.sample = r.sample AND o.chrom = r.chrom AND o.pos = r.pos LEFT JOIN other x ON x.sample = r.sample AND x.asked = r.chrom AND x.pos = r.pos),
full_ AS (SELECT *, match = 'absent' AS assumed, CASE WHEN match = 'ambiguous_contig_alias' THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN match = 'absent' THEN 'CALLED_REFERENCE' ELSE st END AS state, CASE WHEN match = 'absent' THEN ref WHEN from_block THEN ref ELSE al END AS shown FROM looked),
lab AS (SELECT *, CASE WHEN state = 'CALLED_REFERENCE' AND assumed AND shown <> baseline THEN 'assumed_reference_non_baseline' WHEN state = 'CALLED_REFERENCE' AND assumed THEN 'assumed_reference' WHEN state = 'CALLED_REFERENCE' AND shown = baseline THEN 'baseline_match' WHEN state = 'CALLED_REFERENCE' AND shown = alt THEN 'alt_match' WHEN state = 'CALLED_REFERENCE' THEN 'non_baseline_callable'
  WHEN state = 'CALLED_ALTERNATE' AND al = alt THEN 'alt_match' WHEN state = 'CALLED_ALTERNATE' AND al IN (baseline, ref) THEN 'baseline_match' WHEN state = 'CALLED_ALTERNATE' THEN 'non_training_allele' ELSE lower(state) END AS label FROM full_)
SELECT sample, feature, state, assumed, from_block, match, CASE WHEN label IN ('assumed_reference', 'baseline_match') THEN 0.0::DOUBLE WHEN label IN ('assumed_reference_non_baseline', 'alt_match', 'non_baseline_callable') THEN 1.0::DOUBLE END AS value, label FROM lab""")
def gvcf_feature_resolution(s, d):
    """Every sample and feature over gVCF calls, blocks and contig aliases, encoded."""
    calls, blocks = readers.callset(a.gvcf(s, d))
    aliases = s.createDataFrame([("chrF", "F"), ("chrX", "O"), ("F", "chrX")], "source string, target string")
    k = F.col("pos") % 4
    m = a.manifest(s, d).withColumn("chrom", F.when(k == 0, "chrF").when(k == 1, "chrX").otherwise(F.col("chrom")))
    m = m.withColumn("feature", F.concat_ws(":", "chrom", "pos", "ref", "alt")).distinct()
    return lookup.resolve_features(calls, blocks, m, aliases, width=16)


@query(f"WITH {a.CALLS}, n AS (SELECT sample, pos, count(*) AS n, any_value(state) AS state FROM latest GROUP BY ALL), req AS (SELECT DISTINCT l_suppkey AS sample, 'Z' AS chrom, l_partkey * 7 % 230 AS pos FROM lineitem) SELECT r.*, CASE WHEN n = 1 THEN state END AS state, CASE WHEN n = 1 THEN 'position_only_fallback' WHEN n > 1 THEN 'ambiguous_position_only' ELSE 'absent' END AS match FROM req r LEFT JOIN n USING (sample, pos)")
def position_only_lookup(s, d):
    """Without the contig, where a sample has one call at that position."""
    req = a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.lit("Z").alias("chrom"), (F.col("l_partkey") * 7 % 230).alias("pos")).distinct()
    return lookup.call_lookup(req, a.latest(s, d), position_only=True).select("sample", "chrom", "pos", "state", "match")


# contexts -------------------------------------------------------------------------------------------

_RC = lambda x: f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"
_CONTEXTS = f"""subj AS (SELECT page_id AS subject_id, translate(upper(url), 'BEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGT') AS seq FROM pages), ctx0 AS (SELECT subject_id AS context_id, substr(seq, 6, 21) AS context, 10 + subject_id % 3 AS centre FROM subj WHERE subject_id % 100 = 0 AND length(seq) >= 26),
ctx AS (SELECT context_id, context, centre, 'plus' AS strand FROM ctx0 UNION ALL SELECT context_id, {_RC("context")}, 20 - centre, 'minus' FROM ctx0), places AS (SELECT subject_id, seq, unnest(range(-4, length(seq))) AS p FROM subj),
al AS (SELECT context_id, subject_id, strand, centre, seq, context, p, greatest(0, -p) AS lo, least(21, length(seq) - p) AS hi FROM places, ctx WHERE centre >= greatest(0, -p) AND centre < least(21, length(seq) - p) AND least(21, length(seq) - p) - greatest(0, -p) >= 0.8::DOUBLE * 21),
h AS (SELECT *, hamming(substr(context, lo + 1, hi - lo), substr(seq, p + lo + 1, hi - lo)) AS m, hi - lo AS aligned FROM al), hits AS (SELECT context_id, subject_id, p + centre + 1 AS at_, strand, CASE WHEN strand = 'minus' THEN translate(substr(seq, p + centre + 1, 1), 'ACGTN', 'TGCAN') ELSE substr(seq, p + centre + 1, 1) END AS observed, m, aligned FROM h WHERE m <= 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY context_id ORDER BY aligned - m - 3 * m DESC, 1 - m / aligned DESC, aligned DESC, m) AS r, count(*) OVER (PARTITION BY context_id) AS total FROM hits),
best AS (SELECT context_id, min({{'a': subject_id, 'b': at_, 'c': strand, 'd': observed, 'e': m, 'f': aligned}}) AS b, count(*) AS n, any_value(total) AS total FROM ranked WHERE r = 1 GROUP BY context_id)"""


def _contexts(s, d):
    seq = F.translate(F.upper("url"), "BEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGT")
    x = a.table(s, d, "pages").select(F.col("page_id").alias("subject_id"), seq.alias("seq"))
    ctx = x.where("subject_id % 100 = 0 AND length(seq) >= 26").select(F.col("subject_id").alias("context_id"), F.substring("seq", 6, 21).alias("context"), (10 + F.col("subject_id") % 3).cast("int").alias("centre"))  # the search's queries
    return ctx, x


@query(f"WITH {_CONTEXTS} SELECT context_id, b.a AS subject_id, b.b::INT AS \"at\", b.c AS strand, b.d AS observed, b.e::INT AS mismatches, b.f::INT AS aligned, CASE WHEN n = 1 THEN 'mapped_unique_context' ELSE 'multi_hit_context' END AS status, n AS n_equivalent_best_hits, total AS n_context_hits FROM best")
def best_context(s, d):
    """Each context's best place on either strand, and whether there are others as good."""
    ctx, x = _contexts(s, d)
    return lookup.best_contexts(x, ctx, 2, 0.8).drop("coverage")


@query(f"""WITH {_CONTEXTS}, e AS (SELECT c.context_id, substr(c.context, centre::INT + 1, 1) AS ref, translate(substr(c.context, centre::INT + 1, 1), 'ACGT', 'CGTA') AS alt, best.b, best.n FROM ctx0 c LEFT JOIN best USING (context_id))
SELECT context_id, CASE WHEN n IS NULL OR n > 1 OR b.d NOT IN ('A', 'C', 'G', 'T') OR b.d NOT IN (ref, alt) THEN NULL WHEN b.d = ref THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value,
  CASE WHEN n IS NULL THEN 'unresolved_context_not_encoded_as_zero' WHEN n > 1 THEN 'multi_hit_context_not_encoded_as_zero' WHEN b.d NOT IN ('A', 'C', 'G', 'T') THEN 'mapped_ambiguous_base_not_encoded_as_zero' WHEN b.d NOT IN (ref, alt) THEN 'mapped_non_training_allele_not_encoded_as_zero' ELSE 'mapped_unique_context' END AS mapping_status,
  CASE WHEN n IS NULL THEN 'not_called' WHEN n > 1 THEN 'not_called_multi_hit_context' WHEN b.d NOT IN ('A', 'C', 'G', 'T') THEN 'ambiguous_base' WHEN b.d NOT IN (ref, alt) THEN 'non_training_allele' WHEN b.d = ref THEN 'baseline_match' ELSE 'alt_match' END AS allele_call,
  CASE WHEN n IS NULL OR n > 1 OR b.d NOT IN ('A', 'C', 'G', 'T') OR b.d NOT IN (ref, alt) THEN 'UNRESOLVED_OR_AMBIGUOUS' WHEN b.d = ref THEN 'CALLED_REFERENCE' ELSE 'CALLED_ALTERNATE' END AS call_state FROM e""")
def context_encoding(s, d):
    """Contexts mapped and encoded against their baseline."""
    ctx, x = _contexts(s, d)
    best = lookup.best_contexts(x, ctx, 2, 0.8).select("context_id", "observed", "status")
    letter = F.expr("substring(context, centre + 1, 1)")
    df = ctx.select("context_id", letter.alias("ref"), F.translate(letter, "ACGT", "CGTA").alias("alt")).join(best, "context_id", "left")
    return df.select("context_id", encode.context_encode(F.col("status"), F.col("observed"), F.col("ref"), F.col("alt"), F.lit(""), F.lit(True)).alias("e")).select("context_id", "e.*")


@query(f"""WITH {_CONTEXTS}, w AS (SELECT subject_id AS sample, context_id, arg_min(observed, {{'m': m, 'a': at_, 's': strand}}) AS observed FROM hits WHERE aligned = 21 AND observed IN ('A', 'C', 'G', 'T') GROUP BY ALL), smp AS (SELECT DISTINCT sample FROM w)
SELECT smp.sample, c.context_id AS marker, CASE WHEN w.observed IS NULL THEN 'nd' WHEN w.observed = substr(c.context, centre::INT + 1, 1) THEN '0' ELSE '1' END AS state FROM smp CROSS JOIN ctx0 c LEFT JOIN w ON w.sample = smp.sample AND w.context_id = c.context_id WHERE substr(c.context, centre::INT + 1, 1) IN ('A', 'C', 'G', 'T')""")
def marker_states(s, d):
    """Binary states of all markers in each sequence that has any, by the context's nearest place."""
    ctx, x = _contexts(s, d)
    letter = F.expr("substring(context, centre + 1, 1)")
    markers = ctx.select(F.col("context_id").alias("marker"), letter.alias("common")).where("common IN ('A', 'C', 'G', 'T')")
    hits, names, samples = lookup.distinct_context_hits(x, ctx, 2, 0.8)
    best = lookup.nearest_to_context(hits.withColumn("sample", F.col("subject_id")), ["sample", "context_id"]).select("sample", F.col("context_id").alias("of"), "observed")
    best = best.join(names, "of").drop("of").withColumnRenamed("sample", "of").join(samples.withColumnRenamed("subject_id", "sample"), "of").drop("of")
    return lookup.marker_states(best, markers, "binary")


_CAPITALS = lambda x: f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
PASSAGES = f"""subj AS (SELECT doc_id AS subject_id, {_CAPITALS('text')} AS seq FROM documents WHERE text IS NOT NULL), ctx0 AS (SELECT item_id AS context_id, {_CAPITALS('substr(text, 11, 41)')} AS context, 20 AS centre FROM benchmark WHERE length(text) >= 51),
ctx AS (SELECT context_id, context, centre, 'plus' AS strand FROM ctx0 UNION ALL SELECT context_id, {_RC("context")}, 40 - centre, 'minus' FROM ctx0),
parts AS (SELECT context_id, strand, centre, context, k * 41 // 3 AS f, substr(context, k * 41 // 3 + 1, 13) AS seed FROM ctx, (SELECT unnest(range(3)) AS k)),
grams AS (SELECT subject_id, seq, p, substr(seq, p + 1, 13) AS seed FROM (SELECT subject_id, seq, unnest(range(0, length(seq) - 12)) AS p FROM subj)),
inside AS (SELECT DISTINCT context_id, strand, centre, context, subject_id, seq, p - f AS p FROM grams JOIN parts USING (seed) WHERE p >= f AND p - f + 41 <= length(seq)),
over AS (SELECT context_id, strand, centre, context, subject_id, seq, p FROM (SELECT subject_id, seq, unnest(list_distinct(range(-8, 0) || range(greatest(-8, length(seq) - 40), length(seq) - 32))) AS p FROM subj), ctx),
al AS (SELECT *, greatest(0, -p) AS lo, least(41, length(seq) - p) AS hi FROM (SELECT * FROM inside UNION ALL SELECT * FROM over)),
both_ AS (SELECT *, substr(context, lo + 1, hi - lo) AS x, substr(seq, p + lo + 1, hi - lo) AS y FROM al WHERE hi - lo >= 33 AND centre >= lo AND centre < hi),
hits AS (SELECT context_id, subject_id, p + centre + 1 AS at_, strand, substr(seq, p + centre + 1, 1) AS letter, CASE WHEN strlen(x) = length(x) AND strlen(y) = length(y) THEN hamming(x, y) ELSE len(list_filter(range(1, hi - lo + 1), lambda i: substr(x, i::INT, 1) <> substr(y, i::INT, 1))) END AS m, hi - lo AS aligned FROM both_)"""


def _passages(s, d):
    """Whole documents, and contexts from the benchmark."""
    x = a.table(s, d, "documents").select(F.col("doc_id").alias("subject_id"), F.col("text").alias("seq"))
    return x, a.table(s, d, "benchmark").where(F.length("text") >= 51).select(F.col("item_id").alias("context_id"), F.substring("text", 11, 41).alias("context"), F.lit(20).alias("centre"))


@query(f"""WITH {PASSAGES} SELECT context_id, subject_id, at_::INT AS "at", strand, CASE WHEN strand = 'minus' THEN translate(letter, 'ACGTN', 'TGCAN') ELSE letter END AS observed, m::INT AS mismatches, aligned::INT AS aligned FROM hits WHERE m <= 2""")
def document_context_search(s, d):
    """Contexts of 41 letters from the benchmark in whole documents, on both strands, up to two letters replaced."""
    return lookup.context_hits(*_passages(s, d), 2, 0.8).drop("coverage")


@query(None)
def gapped_context_search(s, d):
    """Each such context's best local alignment with gaps, on either strand, in whole documents."""
    return lookup.best_context_hits(lookup.gapped_context_hits(*_passages(s, d), 2, 0.8), ["context_id"])


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[ACGT]'))), '') AS alleles FROM part")
def allowed_alleles(s, d):
    return a.table(s, d, "part").select("p_partkey", F.array_join(lookup.allowed_alleles(F.col("p_name")), "").alias("alleles"))


# stored models --------------------------------------------------------------------------------------

_SYMBOLS = f"{a.MATRIX}, {a.LABELS}, sym AS (SELECT sample, feature, value::INT::VARCHAR AS state FROM matrix)"


def _symbols(s, d):
    m = a.matrix(s, d)
    return m.select("sample", "feature", F.col("value").cast("int").cast("string").alias("state")), a.sample_labels(s, d).select(F.col("sample").alias("id"), F.col("labels")[0].alias("label"))


@query(f"""WITH {_SYMBOLS}, m AS (SELECT sym.*, r_name AS label FROM sym JOIN slabels USING (sample) WHERE state IS NOT NULL), n AS (SELECT feature, state, label, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT feature, label, count(*) AS total FROM m GROUP BY ALL), k AS (SELECT feature, count(DISTINCT state) AS k FROM m GROUP BY ALL),
cells AS (SELECT x.sample, t.label, ln((coalesce(n.n, 0) + 1) / (t.total + k.k)) AS lp FROM sym x JOIN t ON t.feature = x.feature JOIN k ON k.feature = x.feature LEFT JOIN n ON n.feature = x.feature AND n.label = t.label AND n.state = x.state WHERE x.state IS NOT NULL),
pr AS (SELECT r_name AS label, ln(count(*) / (SELECT count(*) FROM slabels)) AS lq FROM slabels GROUP BY ALL), sc AS (SELECT sample, label, round(sum(lp) + any_value(lq), 6) AS s FROM cells JOIN pr USING (label) GROUP BY ALL), sh AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample)) AS e FROM sc)
SELECT sample, label AS predicted, round(e / sum(e) OVER (PARTITION BY sample), 4) AS support FROM sh QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, label) = 1""")
def categorical_bayes(s, d):
    """A categorical naive Bayes model, kept as tables, over all samples."""
    x, labels = _symbols(s, d)
    t, prior = stats.categorical_tables(x, labels)
    return stats.categorical_nb(x, t, prior).withColumn("support", F.round("support", 4))


@query(f"""WITH {_SYMBOLS}, mk AS (SELECT DISTINCT feature FROM matrix), smp AS (SELECT DISTINCT sample FROM matrix), g AS (SELECT s.sample, f.feature, x.state FROM smp s CROSS JOIN mk f LEFT JOIN sym x ON x.sample = s.sample AND x.feature = f.feature)
SELECT sample, feature, CASE WHEN feature % 3 = 0 AND coalesce(state, 'A') NOT IN ('A', '1') THEN '1' WHEN feature % 3 = 1 AND coalesce(state, 'A') NOT IN ('A', '2') THEN 'A' ELSE coalesce(state, 'A') END AS state FROM g""")
def stored_model_imputing(s, d):
    """Missing and unknown states of all samples as a stored model takes them."""
    x, _ = _symbols(s, d)
    k = F.col("feature") % 3
    known = F.when(k == 0, F.array(F.lit("A"), F.lit("1"))).when(k == 1, F.array(F.lit("A"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    markers = x.select("feature").distinct().select("feature", F.lit("a").alias("common"), known.alias("known"))
    return models.imputed_symbols(x, markers, "character")


@query(f"WITH {_SYMBOLS}, f AS (SELECT DISTINCT 'f' || feature AS f FROM matrix WHERE feature % 4 = 0), n AS (SELECT sample, count(DISTINCT feature) FILTER (state IS NOT NULL AND feature % 4 = 0) AS n FROM sym GROUP BY sample) SELECT sample, n AS n_given, round(n / (SELECT count(*) FROM f), 6) AS coverage, n / (SELECT count(*) FROM f) >= 0.5 AS enough FROM n")
def marker_coverage(s, d):
    x, _ = _symbols(s, d)
    named = x.select("sample", F.concat(F.lit("F_"), "feature").alias("feature"), "state")
    asked = x.where("feature % 4 = 0").select(F.concat(F.lit("f"), "feature").alias("feature")).distinct()
    return models.coverage(named, asked).withColumn("coverage", r6("coverage"))


# node models ----------------------------------------------------------------------------------------


@query(f"""WITH {a.PROFILES}, top AS (SELECT DISTINCT feature FROM profiles WHERE node = ''), smp AS (SELECT DISTINCT sample FROM matrix), kids AS (SELECT DISTINCT child FROM profiles WHERE node = ''),
sc AS (SELECT s.sample, p.child, least(greatest(coalesce(avg(1 - abs(x.value - p.mean)), 0), 0), 1) AS score, count(x.value) AS n, count(*) AS asked FROM smp s CROSS JOIN (SELECT * FROM profiles WHERE node = '') p LEFT JOIN matrix x ON x.sample = s.sample AND x.feature = p.feature GROUP BY ALL),
md AS (SELECT sample, child, CASE WHEN sample % 5 = 0 THEN NULL WHEN (sample + ascii(child)) % 5 = 0 THEN 0.9 ELSE CASE WHEN sample % 2 = 0 THEN 0.9 ELSE 0.01 END END::DOUBLE AS p FROM smp CROSS JOIN kids),
j AS (SELECT sc.*, md.p, sum(coalesce(md.p, 0)) OVER w AS t, count(md.p) OVER w AS has, count(*) OVER w AS kids, 100 * (1 - max(n / asked) OVER w) AS missing FROM sc JOIN md USING (sample, child) WINDOW w AS (PARTITION BY sample)),
en AS (SELECT *, -sum(CASE WHEN t > 0 AND coalesce(p, 0) > 0 THEN p / t * log2(p / t) WHEN t > 0 THEN 0 ELSE 1.0 / kids * log2(1.0 / kids) END) OVER (PARTITION BY sample) / log2(kids) AS entropy FROM j),
so AS (SELECT *, CASE WHEN has = 0 THEN 'profile' WHEN missing > 90 THEN 'profile_missing' WHEN entropy > 0.8 THEN 'profile_entropy' ELSE 'model' END AS source FROM en)
SELECT sample, child, round(CASE WHEN source = 'model' THEN coalesce(p, 0) ELSE score END, 6) AS score, source FROM so""")
def node_scores(s, d):
    """Scores of the root's children: by the node's model, or by profiles where it has none, or too little or too even evidence."""
    m, _, prof = a.trained(s, d)
    samples = m.select("sample").distinct()
    scores = hierarchy.profile_scores(samples.withColumn("node", F.lit("")), m, prof)
    k = F.col("sample")
    p = F.when(k % 5 == 0, F.lit(None)).when((k + F.ascii("child")) % 5 == 0, 0.9).when(k % 2 == 0, 0.9).otherwise(0.01)
    model = scores.select("sample", "node", "child", p.cast("double").alias("p"))
    return hierarchy.choose_scores(scores, model, 90.0, 0.8).select("sample", "child", r6("score").alias("score"), "source")


@query(None)
def mantel_test(s, d):
    """Two-sided p value of the Mantel correlation under 19 label permutations."""
    v = a.vectors(s, d)
    return stats.permutation_p(stats.permuted_tests(stats.member_sets(stats.ones(v)), v.select("id", "label"), 19, 1, of=("r",)), "r", two_sided=True)


@query(None)
def decision_paths(s, d):
    """The conditions that lead a fitted decision tree to each sample's label."""
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("label"))
    features = list(range(1, 201))
    wide = models.table(a.matrix(s, d), features)
    return models.tree_paths(models.train(wide, labels, features, models.ESTIMATORS["decision_tree"]()), wide, features)


# boosting -------------------------------------------------------------------------------------------


@query(f"""WITH {a.MATRIX}, stumps AS (SELECT p_size - 1 AS r, p_partkey % 3 AS k, min(p_partkey) AS m FROM part GROUP BY ALL), samples AS (SELECT DISTINCT sample FROM matrix WHERE value IS NOT NULL),
ends AS (SELECT s.sample, k, CASE WHEN coalesce(value <= 0, m % 2 = 0) THEN m % 7 - 3 ELSE m % 5 - 2 END::DOUBLE AS v FROM samples s CROSS JOIN stumps t LEFT JOIN matrix x ON x.sample = s.sample AND x.feature = t.m % 200 + 1)
SELECT sample, round(sum(v) FILTER (k = 0), 6) AS m0, round(sum(v) FILTER (k = 1), 6) AS m1, round(sum(v) FILTER (k = 2), 6) AS m2 FROM ends GROUP BY sample""")
def boosted_scoring(s, d):
    """Margins of all samples by trees that are given as a table: a stump for each size and residue class of the parts."""
    t = a.table(s, d, "part").groupBy((F.col("p_size") - 1).cast("int").alias("round"), (F.col("p_partkey") % 3).cast("int").alias("class")).agg(F.min("p_partkey").alias("m"))
    null = lambda kind: F.lit(None).cast(kind)
    node = lambda n, feature, threshold, left, value: F.struct(F.lit(n).cast("long").alias("node"), feature.alias("feature"), threshold.alias("threshold"), left.alias("missing_left"), value.alias("value"))
    root = node(0, F.col("m") % 200 + 1, F.lit(0.0), F.col("m") % 2 == 0, null("double"))
    leaves = [node(n, null("bigint"), null("double"), null("boolean"), v.cast("double")) for n, v in ((1, F.col("m") % 7 - 3), (2, F.col("m") % 5 - 2))]
    trees = materialise(t.select("round", "class", F.inline(F.array(root, *leaves))), "given-trees", few=True)
    rounds = trees.agg(F.max("round")).first()[0] + 1
    found = boosting.margins(a.matrix(s, d), trees, 3, rounds, 1)
    return found.select("sample", *[F.round(F.col("margins")[k], 6).alias(f"m{k}") for k in range(3)])


@query(None)
def boosted_trees(s, d):
    """Regions of all suppliers by boosted trees, with the probability of the predicted one."""
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("label"))
    m = materialise(a.matrix(s, d), "boosted-matrix")
    return boosting.predict(m, boosting.fit(m, labels, rounds=3, depth=2, rate=0.3)).select("sample", "predicted", F.round("support", 6).alias("support"))


# from cells to a guarded path -----------------------------------------------------------------------

_CONF = lambda sup: f"CASE WHEN coalesce(res, 0) = 0 THEN 'low_confidence' WHEN {sup} IS NULL THEN 'evidence_available_support_unavailable' WHEN {sup} >= 0.7 AND nb > 0 AND rf >= 0.5 AND act = 0 THEN 'high_confidence_baseline_pattern' WHEN {sup} >= 0.7 AND nb > 0 AND rf >= 0.5 THEN 'high_confidence' WHEN {sup} >= 0.5 THEN 'moderate_confidence' WHEN es IN ('resolved_marker_evidence_present', 'partial_resolved_marker_evidence') THEN 'low_to_moderate_confidence' ELSE 'low_confidence' END"
_WHY = "CASE WHEN s = 'unavailable' THEN 'branch_node_unavailable' WHEN s = 'success' AND confidence IN ('low_confidence', 'low_to_moderate_confidence') THEN 'low_branch_confidence' WHEN s = 'success' AND branch <> other AND os IS NOT NULL AND os >= sup THEN 'global_lineage_disagreement_recovery' END"
_GUARDED = f"""{a.MATRIX}, slabels AS (SELECT s_suppkey AS sample, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'susceptible' ELSE 'resistant' END AS amr FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
members AS (SELECT sample, '' AS node, r_name AS child FROM slabels UNION ALL SELECT sample, r_name, r_name || '|' || amr FROM slabels), profiles AS (SELECT node, child, feature, avg(value) AS mean FROM matrix JOIN members USING (sample) WHERE value IS NOT NULL GROUP BY ALL),
sc AS (SELECT x.sample, p.node, p.child, power(round(avg(1 - abs(x.value - p.mean)), 9), 40) AS score FROM matrix x JOIN profiles p USING (feature) WHERE x.value IS NOT NULL GROUP BY ALL), tot AS (SELECT sample, node, sum(score) AS t FROM sc GROUP BY ALL),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY sample, node ORDER BY score DESC, child) = 1), br AS (SELECT sample, node, string_split(child, '|')[-1] AS branch, round(score / t, 9) AS sup FROM top JOIN tot USING (sample, node)),
e0 AS (SELECT sample, count(*) AS n, avg((value IS NOT NULL)::INT) AS c, count(*) FILTER (value <> 0) AS act, count(*) FILTER (value = 1 AND (sample % 4 <> 0 OR feature % 40 = 0)) AS nb, count(*) FILTER (value IS NOT NULL AND (sample % 4 <> 0 OR feature % 40 = 0)) AS res FROM matrix GROUP BY sample),
ev AS (SELECT *, res / n AS rf, CASE WHEN res / n >= .8 THEN 'resolved_marker_evidence_present' WHEN res / n >= .5 THEN 'partial_resolved_marker_evidence' WHEN res > 0 THEN 'low_resolved_marker_evidence' ELSE 'no_resolved_marker_evidence' END AS es, CASE WHEN c >= 0.6 AND c > 0 THEN 'predict' ELSE 'abstain' END AS verdict FROM e0),
p1 AS (SELECT e.*, '' AS node, 'region' AS lc, CASE WHEN verdict = 'predict' THEN branch END AS branch, CASE WHEN verdict = 'predict' THEN sup END AS sup, CASE WHEN verdict = 'abstain' THEN 'abstained' ELSE 'success' END AS s, CASE WHEN e.sample % 3 = 0 THEN 'ASIA' END AS other, CASE WHEN e.sample % 3 = 0 THEN 0.9 END AS os FROM ev e LEFT JOIN br ON br.sample = e.sample AND br.node = ''),
q1 AS (SELECT *, {_CONF("sup")} AS confidence FROM p1), w1 AS (SELECT *, {_WHY} AS why FROM q1), o1 AS (SELECT *, why IS NOT NULL AND other IS NOT NULL AS takes FROM w1),
one AS (SELECT *, 1 AS depth, CASE WHEN s = 'abstained' THEN s WHEN takes THEN 'global_lineage_fallback' ELSE s END AS status, CASE WHEN s = 'abstained' THEN NULL WHEN takes THEN other ELSE branch END AS label, CASE WHEN takes THEN os WHEN s = 'success' THEN sup END AS support FROM o1),
p2 AS (SELECT e.*, o.label AS node, 'amr' AS lc, CASE WHEN e.verdict = 'predict' AND o.label <> 'AFRICA' THEN b.branch END AS branch, CASE WHEN e.verdict = 'predict' AND o.label <> 'AFRICA' THEN b.sup END AS sup, CASE WHEN o.label = 'AFRICA' THEN 'unavailable' WHEN e.verdict = 'abstain' THEN 'abstained' WHEN b.branch IS NULL THEN 'unavailable' ELSE 'success' END AS s,
  CASE WHEN e.sample % 5 = 0 THEN 'resistant' END AS other, CASE WHEN e.sample % 5 = 0 THEN 0.6 END AS os FROM one o JOIN ev e USING (sample) LEFT JOIN br b ON b.sample = o.sample AND b.node = o.label WHERE o.label IS NOT NULL),
q2 AS (SELECT *, {_CONF("sup")} AS confidence FROM p2), w2 AS (SELECT *, {_WHY} AS why FROM q2), o2 AS (SELECT *, why IS NOT NULL AND other IS NOT NULL AS takes FROM w2),
two AS (SELECT *, 2 AS depth, CASE WHEN s = 'abstained' THEN s WHEN takes THEN 'global_lineage_fallback' WHEN s = 'success' THEN s ELSE 'stopped' END AS status, CASE WHEN s = 'abstained' THEN NULL WHEN takes THEN other ELSE branch END AS label, CASE WHEN takes THEN os WHEN s = 'success' THEN sup END AS support FROM o2),
steps AS (SELECT * FROM one UNION ALL SELECT * FROM two), g AS (SELECT *, coalesce(lc = 'amr' AND label = 'susceptible' AND (coalesce(res, 0) <= 0 OR es = 'low_resolved_marker_evidence' OR rf < 0.05), false) AS weak, sample % 8 = 0 AS resistant FROM steps)"""


@query(f"""WITH {_GUARDED} SELECT sample, depth, node, lc AS label_column, status, label, CASE WHEN weak AND resistant THEN 'resistant' ELSE label END AS reported, CASE WHEN weak AND resistant THEN 'resistant' ELSE label END AS routing,
CASE WHEN weak AND resistant THEN 'amr_terminal_fallback_escalation' WHEN weak THEN 'amr_weak_evidence_warning' ELSE 'none' END AS guard, CASE WHEN weak AND resistant THEN 'terminal' END AS source, round(support, 6) AS support, CASE WHEN takes THEN why END AS reason, confidence, round(rf, 6) AS resolved, res AS n_resolved, es AS evidence_status FROM g""")
def query_walk(s, d):
    """From all samples' cells to guarded paths: gates, evidence, confidence, the global model's fallback, and the guard of susceptible calls."""
    m = materialise(a.matrix(s, d).repartition("sample"), "walk-matrix")  # so a task adds up the cells of whole samples
    nation = a.table(s, d, "nation").select("n_nationkey", "n_name")
    labels = a.sample_labels(s, d).join(nation, F.col("labels")[1] == F.col("n_name")).select("sample", F.array(F.col("labels")[0], F.when(F.col("n_nationkey") % 2 == 0, "susceptible").otherwise("resistant")).alias("labels"))
    members = labels.select("sample", F.explode(F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, 1, k), '|'))")).alias("child"))
    prof = materialise(hierarchy.profiles(m, members, hierarchy.prefixes(labels)), "walk-profiles", few=True)
    scorer = lambda f: hierarchy.profile_scores(f, m, prof).where("n > 0").withColumn("score", F.pow(F.round("score", 9), 40))
    region = a.table(s, d, "region")
    root = s.createDataFrame([("", "region", "success", None)], "node string, label_column string, status string, constant string")
    nodes = root.unionByName(region.select(F.col("r_name").alias("node"), F.lit("amr").alias("label_column"), F.when(F.col("r_name") == "AFRICA", "failed").otherwise("success").alias("status"), F.lit(None).cast("string").alias("constant")))
    mapped = F.col("value").isNotNull() & ((F.col("sample") % 4 != 0) | (F.col("feature") % 40 == 0))
    call = F.when(~mapped, "not_called").when(F.col("value") == 1, "alt_match").otherwise("baseline_match")
    names = nodes.agg(F.collect_list("node").alias("nodes"))  # a row
    cells = m.crossJoin(F.broadcast(names)).select("sample", F.explode("nodes").alias("node"), "feature", "value", F.when(mapped, "mapped_unique_context").otherwise("unresolved_context_not_encoded_as_zero").alias("mapping_status"), call.alias("allele_call"), F.col("value").isNotNull().alias("available"))
    samples = m.select("sample").distinct()
    third, fifth = F.col("sample") % 3 == 0, F.col("sample") % 5 == 0
    fallback = samples.select("sample", F.lit(1).alias("depth"), F.when(third, "ASIA").alias("label"), F.when(third, 0.9).alias("support")).unionByName(samples.select("sample", F.lit(2).alias("depth"), F.when(fifth, "resistant").alias("label"), F.when(fifth, 0.6).alias("support")))
    terminal = samples.select("sample", F.when(F.col("sample") % 8 == 0, "resistant").otherwise("susceptible").alias("prediction"), F.lit(0.8).alias("resistant_probability"), F.lit("terminal").alias("source"))
    policy = hierarchy.support_policy(labels.select(F.lit("amr").alias("label_column"), F.col("labels")[1].alias("label")), 2, 1)
    out = traverse.query_walk(cells, nodes, scorer, policy, fallback, 2, ("amr",), terminal, min_recovery=0.6, min_callable=0.6)
    return out.withColumns({"support": r6("support"), "resolved": r6("resolved")})


@query(None)
def kernel_machine(s, d):
    """Labels of all vectors by a machine with an RBF kernel, with the operator's own landmarks and iterations."""
    x = a.table(s, d, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("string").alias("label"))
    features = list(range(x.agg(F.max(F.size("x"))).first()[0]))
    wide = x.select("sample", *[F.get("x", F.lit(k)).alias(f"f_{k}") for k in features])
    return kernels.predict(kernels.train(wide, x.select("sample", "label"), features), wide, features)
