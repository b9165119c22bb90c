"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. Base spans are the patterns' leftmost matches. The method adds spans of kind
`random`: tokens of at least MIN_TOKEN characters, with a letter, outside all base spans, whose mean
log-likelihood ratio per transition is above LEVEL. Both models are first-order Markov chains over the
token alphabet, counted from labelled samples: random strings drawn by rule from digests of a counter
(hexadecimal, and base 64 with either of its alphabets), and ordinary identifiers, which are the words of
about `sample_docs` documents of each language (those whose doc_id's digest lies below the language's share)
as they stand, in capitals and in lower case, joined by `_`, `.`, `-` or in camel case, and numbered. The
ratio table has a fixed size.

Positions are in code points, ends are exclusive. They are found by splitting the text at the matches and
adding up lengths, in blocks, so a text with many matches costs about their number times its block count.

Defined results: null and empty texts have no spans; repeated rows are scanned each, and learned from once;
rows without doc_id are never learned from; null is a language; without documents the identifier model is
uniform; input columns with the name of an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, with_outputs

#: The base patterns.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs of 20 and more: leftmost matches of the open pattern end where the run does
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6

ALPHABET = "[A-Za-z0-9+/_.=-]"
MIN_TOKEN, LEVEL = 16, 0.35
TOKEN = f"(?<!{ALPHABET}){ALPHABET}{{{MIN_TOKEN},}}"
#: Documents of each language that identifiers are learned from (expected number), and random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 200, 3000
#: Character codes of the token alphabet lie in FIRST..FIRST + SPAN - 1; it has SYMBOLS characters.
FIRST, SPAN, SYMBOLS = 43, 80, 68
SMOOTH = 0.5
BLOCK = 256


def _matches(text: str, pattern: str, kind: int, here: Column) -> Column:
    """All matches in a text as structs (start, kind, end, value); null where `here` is false."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{p}', 0)"
    gaps = f"split({text}, '{p}', -1)"
    zipped = f"transform(arrays_zip(transform({gaps}, g -> length(g)), {found}), z -> struct(z['0'] AS gap, z['1'] AS v))"
    none = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>)"
    step = f"(a, x) -> struct(a.at + x.gap + coalesce(length(x.v), 0) AS at, CASE WHEN x.v IS NULL THEN a.found ELSE concat(a.found, array(struct(a.at + x.gap AS start, {kind} AS kind, a.at + x.gap + length(x.v) AS end, x.v AS value))) END AS found)"
    whole = f"aggregate(transform(sequence(0, size({{z}}) div {BLOCK}), b -> slice({{z}}, b * {BLOCK} + 1, {BLOCK})), struct(0 AS at, {none} AS found), (acc, block) -> aggregate(block, struct(acc.at AS at, {none} AS found), {step}, a -> struct(a.at AS at, concat(acc.found, a.found) AS found)), acc -> acc.found)"
    return F.when(here, F.expr(f"transform(array({zipped}), z -> {whole.format(z='z')})[0]"))


def _base(text: str) -> dict[str, Column]:
    t = F.col(text)
    assign = F.filter(_matches(text, ASSIGN, 0, t.rlike("[:=]") & t.rlike(ASSIGN)), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_VALUE)
    return {"assign": assign, "access": _matches(text, ACCESS, 1, t.contains("AKIA")), "hex": _matches(text, HEX, 2, t.rlike(HEX))}


def _pairs(strings: DataFrame) -> DataFrame:
    """Transitions (code, n) of all strings in column s; code combines both characters."""
    chars = strings.select(F.split("s", "").alias("c")).where(F.size("c") > 1)
    codes = chars.select(F.explode(F.expr(f"transform(sequence(1, size(c) - 1), i -> (ascii(c[i - 1]) - {FIRST}) * {SPAN} + ascii(c[i]) - {FIRST})")).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession) -> DataFrame:
    digest = F.unhex(F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256))
    plain = F.regexp_replace(F.base64(digest), "[=\\s]", "")
    form = F.col("id") % 3
    return spark.range(SAMPLE_RANDOM).select(F.when(form == 0, F.lower(F.hex(digest))).when(form == 1, plain).otherwise(F.translate(plain, "+/", "-_")).alias("s"))


def sampled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (t): the texts of a sample of doc_ids that is bounded for each language, in the shared folder."""
    docs = docs.select("doc_id", "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    per = docs.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("__hx_lang"), (F.lit(float(sample_docs)) / F.col("n")).alias("__hx_share"))
    per = materialise(per, "secret-languages", few=True)  # so that its size is known, and texts stay where they are
    low = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40) < F.col("__hx_share")
    chosen = docs.where("doc_id IS NOT NULL").join(per, F.col("lang").eqNullSafe(F.col("__hx_lang"))).where(low)
    texts = chosen.groupBy("doc_id", "__hx_lang").agg(F.min("text").alias("t"))
    return materialise(texts.select(F.coalesce("t", F.lit("")).alias("t")), "secret-sample", few=True)


def identifiers(texts: DataFrame) -> DataFrame:
    """Ordinary identifiers from the words of texts (t), without what base patterns find."""
    for pattern in (ASSIGN, ACCESS, HEX):
        texts = texts.select(F.regexp_replace("t", pattern, " ").alias("t"))
    words = texts.select(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    low, title = F.transform("w", F.lower), F.transform("w", F.initcap)
    numbered = F.transform("w", lambda x, i: F.concat(F.lower(x), F.when(i % 4 == 0, i.cast("string")).otherwise(F.lit(""))))
    forms = F.array(F.concat_ws("_", numbered), F.concat_ws(".", low), F.concat_ws("-", low), F.concat_ws("", title), F.concat_ws("_", F.transform("w", F.upper)), F.concat_ws("/", "w"))
    return words.select(F.explode(forms).alias("s"))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The log-likelihood ratio of each transition, random against ordinary; SPAN * SPAN numbers."""
    spark = docs.sparkSession
    texts = sampled(docs, sample_docs)
    spread = texts.repartition(max(2, spark.sparkContext.defaultParallelism))  # few rows, but much work for each
    rows = _pairs(random_strings(spark)).withColumn("random", F.lit(True)).unionByName(_pairs(identifiers(spread)).withColumn("random", F.lit(False)))
    n = {True: {}, False: {}}
    for code, count, which in rows.select("code", "n", "random").collect():  # at most 2 * SPAN * SPAN rows
        n[which][code] = count
    from math import log

    out = []
    starts = {which: [sum(n[which].get(a * SPAN + b, 0) for b in range(SPAN)) for a in range(SPAN)] for which in n}
    for a in range(SPAN):
        for b in range(SPAN):
            p, q = ((n[which].get(a * SPAN + b, 0) + SMOOTH) / (starts[which][a] + SMOOTH * SYMBOLS) for which in (True, False))
            out.append(log(p / q))
    discard(texts)
    return out


def scanned(docs: DataFrame, ratios: list[float], level: float = LEVEL) -> DataFrame:
    """docs with __hx_base and __hx_spans, each sorted structs (start, kind, end)."""
    df = docs.withColumn("__hx_text", F.coalesce(F.col("text"), F.lit("")))
    base = _base("__hx_text")
    empty = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>)")
    df = df.withColumns({f"__hx_{k}": F.coalesce(v, empty) for k, v in base.items()})
    df = df.withColumn("__hx_tokens", F.coalesce(_matches("__hx_text", TOKEN, 3, F.col("__hx_text").rlike(TOKEN)), empty))
    plain = lambda c: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    df = df.withColumn("__hx_base", F.array_sort(plain(F.concat("__hx_assign", "__hx_access", "__hx_hex"))))
    table = "cast(split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',') AS array<double>)"
    mean = f"transform(array(split(m.value, '')), c -> aggregate(sequence(1, size(c) - 1), 0D, (s, i) -> s + {table}[(ascii(c[i - 1]) - {FIRST}) * {SPAN} + ascii(c[i]) - {FIRST}]) / (size(c) - 1))[0]"
    outside = "NOT exists(__hx_base, b -> b.start < m.end AND m.start < b.end)"
    df = df.withColumn("__hx_random", F.expr(f"CASE WHEN size(__hx_tokens) > 0 THEN filter(__hx_tokens, m -> m.value RLIKE '[A-Za-z]' AND {outside} AND {mean} > {level}D) ELSE __hx_tokens END"))
    return df.withColumn("__hx_spans", F.when(F.size("__hx_random") > 0, F.array_sort(F.concat("__hx_base", plain("__hx_random")))).otherwise(F.col("__hx_base")))


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])))


def scan(docs: DataFrame, ratios: list[float], level: float = LEVEL) -> DataFrame:
    """docs' columns but text, numbers of base spans, and base and all spans as strings."""
    outputs = {f"n_{k}": F.size(f"__hx_{k}").cast("long") for k in KINDS}
    given = [c for c in docs.columns if c.lower() != "text"]
    return with_outputs(scanned(docs, ratios, level), given, outputs | {"base_spans": written("__hx_base"), "spans": written("__hx_spans")})


def redact(docs: DataFrame, ratios: list[float], level: float = LEVEL, mark: str = "[secret]") -> DataFrame:
    """docs with a mark in place of each span (of overlapping ones together); n_chars follows, where it's a column."""
    df = scanned(docs, ratios, level)
    pieces = "aggregate(__hx_spans, struct(0 AS at, '' AS s), (a, m) -> struct(greatest(a.at, m.end) AS at, CASE WHEN m.start >= a.at THEN concat(a.s, substring(__hx_text, a.at + 1, m.start - a.at), '%s') ELSE a.s END AS s), a -> concat(a.s, substring(__hx_text, a.at + 1)))"
    df = df.withColumn("__hx_new", F.when(F.size("__hx_spans") > 0, F.expr(pieces % mark)).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(F.col("__hx_new").alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(F.size("__hx_spans") > 0, F.length("__hx_new").cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)
