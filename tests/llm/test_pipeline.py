from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import queries, secret_scan, toxicity
from lamina.llm.text_stats import remainder

from test_models import plain_score  # isort: skip
from test_near_copies import brute_groups  # isort: skip

ROOT = Path(__file__).resolve().parents[2]


def test_stages_against_plain_versions(spark, sf, documents, labels):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == documents.columns
        seen.append((name, docs, out))
        docs = out
    (_, before, after), (_, b2, a2), (_, b3, a3), (_, b4, a4) = seen
    model = toxicity.fit(before, labels, where=remainder(F.col("doc_id"), 5) != 0)
    clean = {r.doc_id for r in before.collect() if plain_score(model, r.text) < 0.5}
    assert {r.doc_id for r in after.collect()} == clean
    assert {r.doc_id for r in a2.collect()} == set(brute_groups({r.doc_id: r.text for r in b2.collect()}).values())
    assert a3.count() == b3.count()
    assert all(not s for (s,) in secret_scan.scan(a3).select(F.exists("spans", lambda s: s["kind"] < 3)).collect())
    assert {r.doc_id for r in a4.collect()} <= {r.doc_id for r in b4.collect()} and a4.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, a4, sf)
    assert packed.select("doc_id").distinct().count() == a4.count()


def test_run_gives_the_last_stage(spark, sf):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)


@pytest.mark.parametrize("name", ["op6_secret_scan", "op7_stratified_sharding", "op10_decision_list"])
def test_native_operators_run_no_python(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_rest_works_without_this_subpackage(tmp_path):
    for part in ("lamina", "__spark_entry__.py"):
        source = ROOT / part
        if source.is_dir():
            for f in source.rglob("*.py"):
                if "llm" not in f.parts:
                    to = tmp_path / f.relative_to(ROOT)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(f.read_text())
        else:
            (tmp_path / part).write_text(source.read_text())
    (tmp_path / "tests").mkdir()
    for f in (ROOT / "tests").glob("*.py"):
        (tmp_path / "tests" / f.name).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'adsl' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    run = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests"]
    subprocess.run([*run, "--collect-only"], cwd=tmp_path, check=True, timeout=300, stdout=subprocess.DEVNULL)
    few = "test_operators or adsl or layer_counts or ri_clean_event or test_references or strict_gate or test_registry or test_sparse"
    subprocess.run([*run, "-k", few], cwd=tmp_path, check=True, timeout=1800)


@pytest.mark.parametrize("frame", ["messy", "clashing", "empty"])
def test_stages_on_messy_rows(request, spark, labels, tmp_path, frame):
    df = request.getfixturevalue(frame)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id < 12").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        again = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert again.columns == df.columns, name
            assert {r.doc_id for r in again.collect()} <= {r.doc_id for r in docs.collect()}
        docs, last = again, docs
        if k == 1 and frame != "empty":
            # copies and texts without words leave one document each; the others stay
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == [1, 3, 6, 8, 9, 10]
        if k == 2 and frame != "empty":
            assert all("AKIA" not in (r.text or "") and (r.n_chars == len(r.text) if r.text is not None else r.n_chars is None) for r in docs.collect())
    assert docs.count() >= last.count() and (frame != "empty" or docs.count() == 0)
