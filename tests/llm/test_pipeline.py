"""The pipeline's stages: each keeps the columns, and its decisions hold against brute force."""

import importlib

import pytest

pipeline = importlib.import_module("corpus_pipeline")


def test_stages(spark, tmp_path):
    prose = [f"p{i * 7 % 101}q{i * i % 83} and" for i in range(400)]
    long = " ".join(prose[:120])
    near = " ".join(prose[:60] + ["new"] + prose[61:120])
    item = " ".join(f"item{i} word" for i in range(10))
    line = "A line that stands in two documents."
    texts = [(1, long, "en"), (2, near, "en"), (3, f"{line}\nfirst text here", "en"), (4, f"{line}\nsecond text there", "en"), (5, item, "en"), (6, "123 %%%", "en"), (7, None, None), (8, " ".join(prose[200:260]), "en")]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted({r.doc_id for r in docs.select("doc_id").collect()}))
        if name != "packed":
            assert docs.columns == columns
        if name == "lines":
            assert {r.doc_id: r.text for r in docs.collect()}[4] == "second text there"
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert kept == [[1, 2, 3, 4, 5, 8], [1, 2, 3, 4, 5, 8], [1, 3, 4, 5, 8], [1, 3, 4, 8], [1, 3, 4, 8]]
    out = pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in out.collect()}) == kept[-1]


def test_language_without_labels(spark):
    texts = [(1, "plain words here"), (2, "123 %%%"), (3, None), (4, ""), (5, "Ünïcödé"), (None, "no id"), (1, "plain words here")]
    docs = spark.createDataFrame([(i, t, None, 7) for i, t in texts], "doc_id long, text string, lang string, size int")
    out = pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and sorted((r.text, r.size) for r in out.collect()) == [("no id", 7), ("plain words here", 7), ("plain words here", 7), ("Ünïcödé", 7)]


def test_lines_keep_rows_without_id(spark):
    line = "A line that stands in two documents."
    texts = [(1, f"{line}\nfirst"), (2, f"{line}\nsecond"), (None, f"{line}\nno id"), (None, f"{line}\nno id"), (None, None)]
    docs = spark.createDataFrame([(t and "en", t, i, 99) for i, t in texts], "lang string, text string, doc_id int, n_chars int")
    out = pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, f"{line}\nfirst", 42), (2, "second", 6), (None, f"{line}\nno id", 99), (None, None, 99)}
    assert out.where("doc_id is null").count() == 3


CLASHING = "doc_id int, text string, lang string, verdict string, gone string, component string, chunk long, n_chars int, row string, sha string"


def _awkward(spark):
    long = " ".join(f"word{i} here" for i in range(40))
    rows = [(1, long, "en"), (1, long, "en"), (2, None, None), (3, "", "en"), (None, long, None), (None, None, None), (4, "ÄÖ ü\n\nß", "de"), (5, long + " end", None)]
    return spark.createDataFrame([(i, t, g, "v", "g", "c", 7, 1, "r", "s") for i, t, g in rows], CLASHING)


@pytest.mark.parametrize("stage", pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_awkward_rows(spark, tmp_path, stage):
    """Clashing names, nulls, repeated rows and an empty table: columns and other values stay, nothing is multiplied."""
    spark.createDataFrame([(1, "no such words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _awkward(spark)
    out = stage[1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    given = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    if stage[0] == "language":
        assert got == [g for g in given if g[1]]
    elif stage[0] == "near":  # 1 and 5 are near, rows without an id and empty ones stay
        assert got == [g for g in given if g[0] != 5]
    else:
        assert got == given
    assert {(r.verdict, r.gone, r.component, r.chunk, r.row, r.sha) for r in out.collect()} == {("v", "g", "c", 7, "r", "s")}
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_packing_stage_on_awkward_rows(spark, tmp_path):
    out = pipeline.packed(spark, _awkward(spark), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 2, 3, 4, 5] and pipeline.packed(spark, _awkward(spark).limit(0), str(tmp_path)).count() == 0


def test_stage_contract():
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near", "decontaminated", "packed"]


@pytest.mark.parametrize("name", ["pipeline", *[f"op{n}_" for n in range(1, 11)]])
def test_registered(name):
    entry = importlib.import_module("__spark_entry__")
    assert any(k.startswith(name) for k in entry.queries())
