import hashlib
import re

import pytest
from pyspark.sql import functions as F

from helixmark.llm import mixing as M


def mix(rows):
    """Brute force over (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    target, free = {}, set(names)
    while free:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * total[s]}
        for s in full or free:
            target[s] = float(3 * total[s]) if full else level * weight[s]
        free -= full or free
    copies = []
    for s in names:
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        queue = sorted((md5(f"{M.KEY}:{'' if i is None else i}:{md5(t or '')}"), size(t), k) for k, (i, t, x) in enumerate(rows) if x == s)
        at = 0
        for c in range(3):
            for _, n, k in queue:
                if n:
                    copies.append(((at + n) / target[s], "n" if s is None else "s" + s, at, n, k))
                at += n
    taken, spent = [0] * len(rows), 0
    for _, _, _, n, k in sorted(copies):
        spent += n
        if spent > sum(total.values()):
            break
        taken[k] += n
    return [(i, size(t), total[s], target[s], w) for (i, t, s), w in zip(rows, taken)]


def test_against_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    wanted = {r[0]: r[1:] for r in mix(rows)}
    for per_bucket in (20_000, 7):
        df = M.prepared(documents)
        got = M.with_copies(df, M.plan(df, rows_per_bucket=per_bucket), F.col("__hx_size") > 0).select("doc_id", "__hx_size", "__hx_source_size", "__hx_target", "__hx_copies").collect()
        assert len(got) == len(rows)
        for i, size, source, target, copies in got:
            assert (size, source, copies * size) == (wanted[i][0], wanted[i][1], wanted[i][3]) and target == pytest.approx(wanted[i][2])


def test_sources_come_near_their_targets(spark):
    out = M.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ).toPandas()
    per = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.longest).all() and (out.taken <= 3 * out["size"]).all()


def test_mix_repeats_documents(documents):
    report = {r["doc_id"]: r["copies"] for r in M.mix_report(documents).collect()}
    mixed = M.mix_documents(documents)
    assert mixed.columns == documents.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in report.items() if v}


def test_edge_cases(edge, nothing):
    out = M.mix_report(edge).toPandas()
    assert len(out) == edge.count() and (out.taken <= 3 * out["size"]).all() and "text" not in out
    assert dict(M.mix_report(edge).dtypes)["target"] == "double"
    assert M.mix_documents(edge).columns == edge.columns
    assert M.mix_report(nothing).count() == 0 and M.mix_documents(nothing).count() == 0


def test_rows_that_are_alike(spark):
    """Repeated rows, null and repeated ids, many copies of one row; the budget ends among rows that are alike."""
    rows = [(None, "a b c", "x")] * 40 + [(None, "d e", "x")] * 5 + [(1, f"w{i} " * (i % 5 + 1), "x") for i in range(20)] + [(2, "p q r s", "y")] * 30 + [(3, "t", None), (4, None, "z"), (5, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = mix(rows)
    got = M.mix_report(docs.withColumn("lang", F.lit("en"))).collect()
    shown = lambda x: sorted((str(i), n, s, round(t, 6), w) for i, n, s, t, w in x)
    assert shown((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == shown(wanted)
    again = M.mix_report(docs.repartition(7).withColumn("lang", F.lit("en"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sum(r["size"] for r in M.mix_report(docs).collect() for _ in range(r["copies"])) == sum(len(r["text"].split()) for r in M.mix_documents(docs).collect())


def test_many_sources(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 700}" if i % 50 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = {r[0]: r[1:] for r in mix(rows)}
    for r in M.mix_report(docs).collect():
        n, s, t, w = wanted[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (n, s, w) and r["target"] == pytest.approx(t)


def test_rows_that_differ_in_maps_or_variants_only_stay_apart(spark):
    docs = spark.range(21).selectExpr("cast(id div 7 AS string) AS source", "1L AS doc_id", "'a b c d e' AS text", "map('k', id % 7, 'same', 1L) AS meta", "parse_json('{\"v\": ' || id || '}') AS v", "cast(null AS string) AS lang")
    counted = lambda df: {(r["source"], r["k"], r["v"]): r["n"] for r in df.selectExpr("source", "meta['k'] AS k", "to_json(v) AS v").groupBy("source", "k", "v").agg(F.count("*").alias("n")).collect()}
    for weights in ((7, 3, 2),):
        mixed = counted(M.mix_documents(docs, weights))
        assert set(mixed) <= set(counted(docs)) and max(mixed.values()) <= M.MAX_COPIES
        report = M.mix_report(docs, weights)
        taken = {(r["source"], r["k"], r["v"]): r["taken"] // 5 for r in report.selectExpr("source", "meta['k'] AS k", "to_json(v) AS v", "taken").collect()}
        assert len(taken) == 21 and {k: n for k, n in taken.items() if n} == mixed
        assert 100 <= 5 * sum(mixed.values()) <= 105


def test_rows_alike_in_all_columns_are_dealt_out_by_number(spark):
    docs = spark.range(40).selectExpr("cast(id % 2 AS string) AS source", "1L AS doc_id", "'a b c' AS text", "map('k', 1) AS meta")
    out = M.mix_report(docs)
    assert out.count() == 40 and out.agg(F.sum("taken")).first()[0] == M.mix_documents(docs).count() * 3 == 120
