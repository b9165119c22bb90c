"""The jobs over copies of the smallest tables: reruns, growing input, a batch that is run again, and the command line."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from jobs import cohort_release, common, marker_screen

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_release_is_the_same_again_and_by_contigs(spark, tmp_path):
    out, config = f"file://{tmp_path}/out", {"min_recovery": 0.1, "min_callable": 0.02}
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    numbers = cohort_release.run(spark, DIR, out, config)
    first = rows(cohort_release.matrix(spark, out)), rows(cohort_release.samples(spark, out))
    assert numbers["cells"] == len(first[0]) > 0 and numbers["samples"] == len(first[1]) > 0
    assert {p.name for p in (tmp_path / "out/matrix").iterdir() if p.is_dir()} == {"chrom=F", "chrom=O"}
    assert all(p.name.startswith("verdict=") for p in (tmp_path / "out/samples").iterdir() if p.is_dir())
    kept = {p.name for p in (tmp_path / "out/matrix/chrom=O").iterdir()}
    for again in ({}, {"contigs": ["F"]}):
        if again:
            kept = {p.name for p in (tmp_path / "out/matrix/chrom=O").iterdir()}
        cohort_release.run(spark, DIR, out, config | again)
        assert (rows(cohort_release.matrix(spark, out)), rows(cohort_release.samples(spark, out))) == first
    assert {p.name for p in (tmp_path / "out/matrix/chrom=O").iterdir()} == kept  # not touched
    after = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    assert after == before


def test_absent_sites_may_stay_uncalled(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    cohort_release.run(spark, DIR, out, {"absent_is_reference": False})
    m = cohort_release.matrix(spark, out)
    assert m.where("assumed").isEmpty() and not m.where("value IS NULL").isEmpty()


def screen(spark, tmp_path, name, **config):
    run = lambda: marker_screen.run(spark, f"file://{tmp_path}/in", f"{DIR}/benchmark.parquet", f"file://{tmp_path}/{name}/out", f"file://{tmp_path}/{name}/checkpoint", config)
    return run, lambda: rows(marker_screen.calls(spark, f"file://{tmp_path}/{name}/out").drop("batch"))


def put(spark, tmp_path, df, name):
    df.coalesce(1).write.parquet(f"file://{tmp_path}/made-{name}")
    os.makedirs(tmp_path / "in", exist_ok=True)
    for p in (tmp_path / f"made-{name}").glob("*.parquet"):
        shutil.copy(p, tmp_path / "in" / f"{name}-{p.name}")


def test_growing_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    passage = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 60").first()
    more = spark.createDataFrame([(9001, "xx " + passage["text"] + " yy", "en"), (9001, "xx " + passage["text"] + " yy", "en"), (9002, None, None), (9003, "", "de"), (None, passage["text"], "en")], marker_screen.SEQUENCES)
    run, found = screen(spark, tmp_path, "steps", files_per_batch=2)
    put(spark, tmp_path, docs.where("doc_id < 80"), "a")
    numbers = run()
    assert numbers["batches"] == 1 and numbers["documents"] == docs.where("doc_id < 80").distinct().count()
    before = found()
    assert run() == {"documents": 0, "calls": 0, "batches": 0} and found() == before
    put(spark, tmp_path, docs.where("doc_id >= 80"), "b")
    put(spark, tmp_path, more, "c")
    numbers = run()
    assert numbers["batches"] == 1 and numbers["documents"] > 0
    whole = found()
    assert len(whole) > len(before) and any("9001" in r for r in whole)
    # all at once gives the same
    run_once, found_once = screen(spark, tmp_path, "once")
    run_once()
    assert found_once() == whole
    # a batch whose end wasn't noted is run again, in place of what it wrote
    for p in (tmp_path / "steps/checkpoint/commits").iterdir():
        if p.name.strip(".").startswith("1"):
            p.unlink()
    assert run()["batches"] == 1 and found() == whole
    # a document that comes again counts as it is now
    put(spark, tmp_path, spark.createDataFrame([(9001, "nothing of the kind", "en")], marker_screen.SEQUENCES), "d")
    run()
    assert found() == [r for r in whole if "9001" not in r]


def test_empty_input(spark, tmp_path):
    put(spark, tmp_path, spark.createDataFrame([], marker_screen.SEQUENCES), "a")
    run, found = screen(spark, tmp_path, "none")
    run()
    assert found() == []


def test_command_line(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"mismatches": 0}))
    paths = {"documents": f"{DIR}/documents.parquet", "panel": f"{DIR}/benchmark.parquet", "out": f"file://{tmp_path}/out", "checkpoint": f"file://{tmp_path}/checkpoint"}
    args = [x for k, v in paths.items() for x in (f"--{k}", v)]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.marker_screen", *args, "--config", f"file://{config}"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "new documents" in done.stderr, done.stderr[-2000:]
    assert marker_screen.calls(spark, f"file://{tmp_path}/out").where("mismatches > 0").isEmpty()
    config.write_text(json.dumps({"mismatch": 0}))
    with pytest.raises(ValueError, match="mismatch"):
        common.settings(spark, f"file://{config}", marker_screen.DEFAULTS)
    for name, module in (("cohort_release", cohort_release), ("marker_screen", marker_screen)):
        assert common.settings(spark, f"file://{root}/jobs/{name}.json", module.DEFAULTS).keys() == module.DEFAULTS.keys()
