"""The corpus pipeline stage by stage, and the registered queries' oracles."""

import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from veridelta.llm import exact_dedup, jaccard, mixing, packing, quality_rules, queries

SF = "/root/testdata/sf0.001"


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(30)]
    out = [(i, t, "en", rng.choice(["web", "web", "books"]), len(t)) for i, t in enumerate(good)]
    out += [(100 + i, t.upper(), "en", "web", len(t)) for i, t in enumerate(good[:5])]  # exact copies
    out += [(200 + i, t + " more", "en", "books", len(t)) for i, t in enumerate(good[5:9])]  # near copies
    return out + [(300, "too short", "en", "web", 9), (301, None, None, None, None), (302, "a b c " * 80, "en", "web", 480)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    (_, rules), (_, exact), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES

    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert kept == set(range(30)) | set(range(100, 105)) | set(range(200, 204))
    docs = rules(spark, docs, folder)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    first = {r["doc_id"] for r in exact_dedup.exact_duplicates(docs).filter("kept").collect()}
    assert first == kept - set(range(5))  # of equal texts the largest id stays
    docs = exact(spark, docs, folder)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == first

    found = jaccard.near_duplicates(docs).collect()
    docs = near(spark, docs, folder)
    stay = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == columns and stay == {r["component_id"] for r in found} and len(stay) < len(found)

    want = sorted(r["doc_id"] for r in mixing.mix(docs).collect())
    docs = mixed(spark, docs, folder)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == want

    got = packed(spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] in texts[r["doc_id"]] for r in got)
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["length"]) for r in again.collect()) == sorted((r["doc_id"], r["length"]) for r in got)
    assert again.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_beside_its_oracle(spark, name):
    df = queries.queries()[name](spark, SF)
    columns, want = compare.oracle(compare.connection(SF), queries.oracle_sql()[name])
    assert sorted(columns) == sorted(df.columns)
    assert compare.bag(df.columns, df.collect()) == compare.bag(columns, want)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_query_gives_every_row(spark, name):
    table = "pages" if name == "op4_html_text" else "documents"
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select("page_id" if table == "pages" else "doc_id").collect()]
    got = queries.queries()[name](spark, SF)
    if name == "op5_best_fit_packing":
        got = got.filter("piece = 0")
    assert sorted(r[0] for r in got.select(got.columns[0]).collect()) == sorted(ids)
