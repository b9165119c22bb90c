"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

from .mixing import KEY, MAX_COPIES, WEIGHTS
from .quality_rules import DENOMINATORS, MAX_REPEAT_PERCENT, MEASURES, MIN_WORDS, REACH, SHRINK, SUB_BITS

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Counts of each document, with base_failed.
QUALITY_COUNTS = rf"""
q_words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), q_tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q_words)
), q_cover AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i FROM q_tri QUALIFY count(*) OVER (PARTITION BY rid, t) > 1), (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY rid
), q_counts AS (
  SELECT q.*, len(w) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
         coalesce(c.n, 0) AS n_repeat_words
  FROM q_words q LEFT JOIN q_cover c USING (rid)
), q_base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q_counts
)"""


def _bucket(v: str) -> str:
    shift = f"greatest(length(bin({v})) - {SUB_BITS + 1}, 0)"
    return f"({shift} * {2**SUB_BITS} + ({v} >> {shift}))"


def _value(b: str) -> str:
    shift = f"greatest({b} // {2**SUB_BITS} - 1, 0)"
    return f"(({b} - {shift} * {2**SUB_BITS}) << {shift})"


def _quality_rules() -> str:
    each = ", ".join(f"coalesce({f} * {n} // nullif({d}, 0), 0)::BIGINT AS {m}" for m, (n, d, f, _, _) in MEASURES.items())
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_bucket(m)} AS bucket FROM q_measured WHERE NOT base_failed" for m in (*MEASURES, *DENOMINATORS))
    at = lambda p, end, q: f"min({end}) FILTER (upto * 100 >= total * {p})::DOUBLE AS {q}"
    level = lambda name, keys: f"{name} AS (SELECT {keys}measure, max(total)::DOUBLE AS total, {at(10, 'least_', 'low')}, {at(50, 'least_', 'mid')}, {at(90, 'most', 'high')} FROM (SELECT {keys}measure, {_value('bucket')} AS least_, {_value('(bucket + 1)')} - 1 AS most, sum(n) OVER (PARTITION BY {keys}measure) AS total, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM q_sketch GROUP BY ALL)) GROUP BY ALL)"
    drawn = lambda q: f"(a.total * a.{q} + {SHRINK}::DOUBLE * ((b.total * b.{q} + {SHRINK}::DOUBLE * c.{q}) / (b.total + {SHRINK}::DOUBLE))) / (a.total + {SHRINK}::DOUBLE) AS {q}"
    wide = ", ".join([f"max({q}) FILTER (measure = '{m}') AS {m}_{q}" for m in MEASURES for q in ("low", "mid", "high")] + [f"max(mid) FILTER (measure = '{d}') AS {d}_typical" for d in DENOMINATORS])
    bounds = []
    for m, (_, den, factor, event, low) in MEASURES.items():
        beyond = lambda q: f"{REACH}::DOUBLE * greatest(abs({m}_{q} - {m}_mid), {factor * event}::DOUBLE / greatest({den}_typical, 1::DOUBLE))"  # noqa: B023, E731
        bounds.append(f"{m}_high + {beyond('high')} AS hi_{m}, " + (f"{m}_low - {beyond('low')} AS lo_{m}" if low else f"-1 AS lo_{m}"))
    rule = "CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {m} > hi_{m} OR {m} < lo_{m} THEN '{m}'" for m in MEASURES) + " END"
    return f"""
WITH {QUALITY_COUNTS}, q_measured AS (SELECT *, {each} FROM q_base),
q_sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({rows}) GROUP BY ALL),
{level("q_a", "lang, source, ")}, {level("q_b", "lang, ")}, {level("q_c", "")},
q_levels AS (SELECT a.lang, a.source, a.measure, {drawn("low")}, {drawn("mid")}, {drawn("high")} FROM q_a a JOIN q_b b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN q_c c ON a.measure = c.measure),
q_wide AS (SELECT lang, source, {wide} FROM q_levels GROUP BY lang, source),
q_bounds AS (SELECT lang, source, {", ".join(bounds)} FROM q_wide),
q_verdict AS (SELECT m.*, {rule} AS rule FROM q_measured m LEFT JOIN q_bounds t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, rule IS NULL AS kept, rule FROM q_verdict"""


QUALITY_RULES = _quality_rules()

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{KEY}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, {MAX_COPIES} * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(f"{float(x)}::DOUBLE" for x in WEIGHTS)}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, place) FROM l WHERE cap / weight > level) * weight, cap::DOUBLE)) AS target FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, (k * source_size + before_ + size)::DOUBLE / target AS finish, k * source_size + before_ AS from_
  FROM q, (SELECT unnest(range({MAX_COPIES})) AS k) WHERE size > 0 AND target > 0
), x AS (
  SELECT *, sum(size) OVER (ORDER BY finish, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END, from_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c
), n AS (
  SELECT source, before_, digest, size, count(*) AS copies FROM x WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(n.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.before_ = n.before_ AND q.digest = n.digest AND q.size = n.size"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: (16 >> j::INT) * substr(bits, (i * 5 + j + 1)::INT, 1)::INT))::INT]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (html)"""

#: Windows of the items as strings of words; a document's window of that many words that equals one is hit, word by word.
DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_places AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS p FROM item_words
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + 9], ' ') AS words FROM item_places
), sizes AS (
  SELECT DISTINCT size FROM windows
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes
), met AS (
  SELECT k, p, s.size, v.item_id FROM (SELECT k, size, p, array_to_string(w[p : p + size - 1], ' ') AS words FROM places) s JOIN windows v ON s.size = v.size AND s.words = v.words
), hit AS (
  SELECT k, count(DISTINCT word) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS word FROM met) GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM met) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""

#: Scores of all documents with a term of the item; the ten best of each item.
LEXICAL_SEARCH = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs WHERE len(terms) > 0
), postings AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM docs) GROUP BY k, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), factors AS (
  SELECT k, doc_id, 100 - 75 + (75 * len(terms) * n_docs) // length AS m FROM docs, totals WHERE len(terms) > 0
), items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT i, item_id, unnest(terms) AS term FROM items
), scores AS (
  SELECT i, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN factors USING (k) GROUP BY i, item_id, k, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
