import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from helixmark.llm import common, mixing, quality_rules, simhash

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Each stage against its operator's own result on all that the stage before kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        out = common.materialise(stage(spark, docs, DIR), f"test-{k}")
        if k < 4:
            assert out.columns == columns
        seen.append(out)
        if k < 4:
            docs = out
    first = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_report(first).where("kept").collect()}
    assert {r["doc_id"] for r in seen[0].collect()} == kept
    near = simhash.near_duplicates(seen[0]).toPandas()
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(set(near.component_id))
    assert seen[2].count() == seen[1].count()
    assert seen[3].count() == sum(r["copies"] for r in mixing.mix_report(seen[2]).collect())
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    for r in seen[4].collect():
        ids = ref.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = P.run(spark, DIR)
    assert whole.exceptAll(seen[4]).count() == 0 and seen[4].exceptAll(whole).count() == 0


def test_stages_take_odd_rows(spark, edge, nothing):
    """What becomes of nulls, empty, long, tied and repeated rows at each stage."""
    good, near, secret, mixed, last = (f for _, f in P.STAGES)
    ids = lambda df: sorted((str(r["doc_id"]) for r in df.select("doc_id").collect()))
    for stage in (good, near, secret, mixed):
        assert stage(spark, edge, DIR).columns == edge.columns and stage(spark, nothing, DIR).count() == 0
    # texts of 50 words and more that don't repeat themselves: the prose, under each of its ids
    assert ids(good(spark, edge, DIR)) == ["5", "5", "6", "None"]
    # one row for all texts without words, one for the prose, and the others
    assert ids(near(spark, edge, DIR)) == ["1", "4", "5", "7", "8"]
    before = {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] is not None}
    after = secret(spark, edge, DIR).collect()
    assert len(after) == edge.count()
    for r in after:
        if r["doc_id"] == 4:
            assert r["text"] == before[4][: before[4].index("token = ")] + "[secret]"
        elif r["doc_id"] is not None:
            assert r["text"] == before[r["doc_id"]]
    # texts without words are never taken; others as often as the mix says
    taken = mixed(spark, edge, DIR).collect()
    assert all((r["text"] or "").strip() for r in taken)
    assert len(taken) == sum(r["copies"] for r in mixing.mix_report(edge).collect())
    digests = last(spark, edge, DIR).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(digests) == edge.count() and last(spark, nothing, DIR).count() == 0
    for r in digests:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]] or "").encode()).hexdigest()
        if r["doc_id"] in (1, 2):
            assert (r["n_tokens"], r["ids_sha256"]) == (0, empty)
