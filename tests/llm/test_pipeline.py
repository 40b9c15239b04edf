"""The pipeline's stages against brute force, and the rules that hold for all of it."""

import random
import weakref
from types import SimpleNamespace

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F

from quillstone.llm import common, decontamination, toxicity
from quillstone.llm.queries import QUERIES

from .test_operators import check_packing, leaks, near_by_force

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    top = f"file://{tmp_path_factory.mktemp('sf')}"
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(words) for _ in range(30))
    docs, labels = [], []
    for i in range(200):
        w = [r.choice(words) for _ in range(r.randrange(15, 80))]
        toxic = i % 9 == 0
        if toxic:
            w = [x if k % 5 else "moron" for k, x in enumerate(w)]
        t = " ".join(w)
        if i % 11 == 1:
            t += " " + passage
        if i % 13 == 2:
            t += " 4845168114407329 at 97.51.17.173"
        if i % 10 == 5:
            t = docs[-1][1]
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int("moron" in t)))
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (None, "quite alone here", "en", "s", 16), (302, "short", "en", "s", 5), (302, "short", "en", "s", 5)]
    few = " ".join([f"lone{k}" for k in range(900)] + passage.split()[:14])  # windows cover less than a twentieth
    docs += [(303, few, "en", "s", len(few))]
    spark.createDataFrame(docs, COLUMNS).withColumn("row", F.lit(1)).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
    after = {n: [(r.doc_id, r.text) for r in d.collect()] for n, (_, d) in kept.items() if n != "packing"}
    assert all("moron" not in (t or "") for _, t in after["toxicity"])
    assert sum(1 for _, t in kept["toxicity"][0] if "moron" not in (t or "")) == len(after["toxicity"])
    stay = {i for i, _, _, k in near_by_force(kept["near_duplicates"][0], pipeline.SHINGLE) if k}
    assert sorted(map(str, (i for i, _ in after["near_duplicates"]))) == sorted(map(str, stay))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks(kept["decontamination"][0], items) if x[2]}
    assert 303 in bad and sorted(map(str, (i for i, _ in after["decontamination"]))) == sorted(str(i) for i, _ in kept["decontamination"][0] if i not in bad)
    old = dict(kept["pii"][0])
    assert {i for i, t in after["pii"] if t != old[i]} == {i for i, t in kept["pii"][0] if "4845168114407329" in (t or "")}
    check_packing(kept["pii"][1].collect(), kept["packing"][1].collect(), 4096)


def test_the_driver_gives_the_model_back(spark, folder, monkeypatch):
    fitted, held = [], []
    fit, seen = toxicity.fit, SimpleNamespace(**vars(common))

    def watched(*args):
        model = fit(*args)
        fitted.append(weakref.ref(model))
        return model

    monkeypatch.setattr(toxicity, "fit", watched)
    seen.give_back = lambda: held.append([x() for x in fitted])
    monkeypatch.setattr(pipeline, "common", seen)
    out = pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert fitted and held[-1] == [None] and out.count()


def test_run_is_the_stages(spark, folder):
    rows = QUERIES["pipeline"](spark, folder).collect()
    assert rows and sum(r.length for r in rows if r.doc_id == 301) == 1 and not any(r.doc_id == 0 for r in rows)


def test_empty_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.collect() == []


def test_every_operator_has_one_query():
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert decontamination.WINDOW == 13
