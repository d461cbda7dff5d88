"""The quality model, the pipeline, and the registered queries."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from crowdtide.llm import ngram_join, quality_model
from crowdtide.llm.catalog import load
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
QUERIES, SQL = load()


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, quality_model.FEATURES)).astype(np.float64)
    bag, y = np.array([0, 0, 0, 1, 2, 2, 2, 2, 3, 3, 4, 4]), np.array([1, 0, 1, 0, 1.0])
    model = quality_model.Model()
    before = model.scores(x, bag)
    assert before.shape == (5,) and ((before > 0) & (before < 1)).all()
    model.fit(x, bag, y)
    assert ((model.scores(x, bag) > 0.5) == (y > 0.5)).all()
    weights = model.forward(x, bag)[4]
    assert np.allclose(np.add.reduceat(weights, [0, 3, 4, 8, 10]), 1)


def test_held_out_accuracy_and_inputs(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    scored = quality_model.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(scored["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in scored["doc_id"]])
    held = scored[scored["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    # other ids, sources and languages give the same score
    moved = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'yy' as source", "n_chars")
    again = quality_model.score(moved, model).toPandas()
    assert np.allclose(sorted(again["score"]), sorted(quality_model.score(docs, model).toPandas()["score"]))


def test_edge_rows_of_the_quality_model(docs_of, spark):
    good, bad = "the quiet river walks. " * 30, "$$$ ### " * 60
    rows = [(k, good if k % 2 else bad) for k in range(40)] + [(None, good), (50, None), (51, ""), (52, bad * 300), (52, bad * 300)]
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(40)] + [(None, 1, "x"), (60, None, "x"), (61, 1, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    model = quality_model.fit(docs_of(rows), labels)
    got = quality_model.score(docs_of(rows), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["predicted"] == 1 and not by[None]["held_out"] and by[52]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = quality_model.keep_good(docs_of(rows), model)
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])
    assert quality_model.fit(docs_of(rows), labels.where("quality = 1")) is None
    assert {r["score"] for r in quality_model.score(docs_of(rows), None).collect()} == {0.5}
    assert quality_model.score(docs_of([]), model).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, FOLDER).toPandas()
    key, source = ("page_id", "pages") if name.startswith("op8") else ("doc_id", "documents")
    assert set(rows[key]) == set(spark.read.parquet(f"{FOLDER}/{source}.parquet").toPandas()[key])


def planted(spark):
    """Documents with near copies, boilerplate, personal data, junk and awkward rows."""
    draw = random.Random(6)
    words = "river stone walk quiet lantern garden night morning letter bridge winter summer candle window street music paper silver forest harbour".split()
    prose = lambda n: ". ".join(" ".join(draw.choices(words, k=8)) for _ in range(n)) + "."
    rows = []
    for k in range(60):
        rows.append((k, f"Subscribe to our letter today\n{prose(12)}", "en", f"src{k % 2}", 0))
    for k in range(60, 70):
        rows.append((k, rows[k - 60][1].replace("\n", "\nnew ", 1), "en", "src2", 0))
    rows += [(70 + k, "### $$$ %%% " * 80, "en", "src0", 0) for k in range(10)]
    rows += [(80, prose(10) + " Mail jo.doe@corp.com now.", "en", "src3", 0), (81, None, None, None, None), (82, "", "en", "src3", 0), (None, prose(9), "en", "src3", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages_work_on_what_is_left(spark, tmp_path):
    labels = spark.createDataFrame([(k, int(k < 70), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    planted(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert not set(range(70, 80)) & set(seen["quality"]) and set(range(70)) <= set(seen["quality"])
    assert all("Subscribe" not in (r["text"] or "") for r in seen["boilerplate"].values())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["boilerplate"].values() if r["text"] is not None)
    lines = {k: r["text"] for k, r in seen["boilerplate"].items()}
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(list(lines.items()), "doc_id long, text string")).collect()}
    assert set(seen["near_duplicates"]) == {k for k, c in groups.items() if k == c} and not set(range(60, 70)) & set(seen["near_duplicates"])
    assert "jo.doe@corp.com" not in seen["personal_data"][80]["text"] and seen["personal_data"][80]["text"].endswith(" now.")
    assert set(seen["packing"]) == set(seen["personal_data"])
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert run["length"].sum() == spark.read.parquet(f"{tmp_path}/packing").toPandas()["length"].sum()


def test_pipeline_on_empty_tables(spark, tmp_path):
    planted(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
