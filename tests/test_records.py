"""Records, evaluation, mutation and streaming on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from plinth.functions import scalars as S
from plinth.operators import evaluation as E
from plinth.operators import mutate
from plinth.operators import records as R
from plinth.sources import records_io
from plinth.streaming import incremental


def record(**given):
    zero = dict.fromkeys(S.RISK_CLASSES, 0.0)
    return {"input_dsl": "some text", "label": 1, "risk_score": 0.1, "category": "clean_pass", "language": "go", "taxonomy_labels": zero, "symbolic_gate_passed": True, "source_type": "mined"} | given


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[k] for k in record()) for r in rows], R.SCHEMA)


def test_quality_gate(spark):
    hot = dict.fromkeys(S.RISK_CLASSES, 0.0) | {"SecuritySurface": 0.9}
    rows = [record(), record(symbolic_gate_passed=False), record(input_dsl="x " * 401), record(language="java"), record(risk_score=0.5), record(label=0, risk_score=0.8), record(label=0, risk_score=0.8, taxonomy_labels=hot), record(input_dsl="")]
    reasons = [sorted(r.why) for r in frame(spark, *rows).withColumn("why", R.gate_reasons()).collect()]
    assert reasons == [[], ["gate"], ["tokens"], ["language"], ["pass_risk"], ["reject_class"], [], ["tokens"]]


def test_stratified_counts_and_shortage(spark):
    rows = [record(input_dsl=f"{g} {n} {i}", language=g, label=n) for g in S.LANGUAGES for n in (0, 1) for i in range(30)]
    out = R.stratified(frame(spark, *rows), 40, 0.2)
    assert {(r.split, r.language, r.label): r["count"] for r in out.groupBy("split", "language", "label").count().collect()} == {(s, g, n): {"train": 4, "val": 1}[s] for s in ("train", "val") for g in S.LANGUAGES for n in (0, 1)}
    with pytest.raises(ValueError):
        R.stratified(frame(spark, *rows), 400)


def test_inspection_finds_faults(spark):
    rows = [record(label=99), record(risk_score=0.99), record(category="nonsense"), record(input_dsl=" "), record(language="cobol"), record(label=0, risk_score=0.7), record(input_dsl="a " * 450)]
    rules = {r.rule for r in R.violations(frame(spark, *rows)).collect()}
    assert rules == {"label", "risk_high_for_pass", "category", "empty", "language", "risk_low_for_reject", "tokens"}


def test_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.2), (0, 0.35), (0, 0.8)], "label int, risk double")
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in E.sweep(rows, [0.3, 0.5]).collect()}
    assert got == {0.5: (1, 1, 1, 0), 0.3: (1, 0, 2, 0)}
    assert 0.1 <= E.fitted_temperature(rows) <= 10


def test_temperature_recovers_scale(spark):
    rows = spark.range(4000).select((F.col("id") % 100 / 100 + 0.005).alias("p"), "id")
    rows = rows.select(F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < F.col("p"), 0).otherwise(1).alias("label"), S.sigmoid(S.logit(F.col("p")) * 2).alias("risk"))
    assert abs(E.fitted_temperature(rows) - 2) < 0.25


def test_scalars(spark):
    rows = spark.createDataFrame([("café naïve é", "a.b::c:d", "findMany", "pkg/tests/a.go")], "t string, n string, m string, p string")
    r = rows.select(S.token_count(F.col("t")), S.last_segment(F.col("n")), S.snake_case(F.col("m")), S.language_of(F.col("p")), S.is_test_path(F.col("p")), S.receiver_overlaps(F.lit("myDbConn"), ["db"])).first()
    assert tuple(r) == (3, "c:d", "find_many", "go", True, True)


def test_commit_texts(spark):
    r = spark.createDataFrame([("This reverts commit abcdef1234.", "see https://x/commit/0123abc")], "b string, a string").select(S.reverted_commit(F.col("b")), S.advisory_commit(F.col("a"))).first()
    assert tuple(r) == ("abcdef1234", "0123abc")
    said = spark.createDataFrame([("Reverting commit ABCDEF12",), ("reverts commit 123",), ("",), (None,)], "b string").select(S.reverted_commit(F.col("b")).alias("h"))
    assert [x.h for x in said.collect()] == ["abcdef12", None, None, None]


def test_risk_maps(spark):
    rows = spark.createDataFrame([("x", 0, 0.9, "fix data race in cache", ["ARITY_MISMATCH: a"]), ("circular_imports", 0, 0.8, "", []), ("anything", 1, 0.1, "race", [])], "c string, l int, r double, t string, v array<string>")
    got = [r.m for r in rows.select(S.risk_map(F.col("c"), F.col("l"), F.col("r"), F.col("t"), F.col("v")).alias("m")).collect()]
    assert got[0]["ConcurrencyHazard"] == got[0]["BreakingPublicAPI"] == 0.9 and got[0]["SilentLogicDrift"] == 0
    assert got[1]["BreakingPublicAPI"] == 0.56 and got[1]["SilentLogicDrift"] == 0.64 and set(got[2].values()) == {0.0}


def test_tolerant_reading(spark, tmp_path):
    good = record(category="clean_pass")
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n\nnot json\n" + json.dumps({"input_dsl": "x", "label": 0, "risk_score": 0.9, "category": "security_surface", "language": "go"}) + "\n")
    rows = {r.input_dsl: r for r in records_io.read_records(spark, str(tmp_path / "r.jsonl")).collect()}
    assert set(rows) == {"some text", "x"} and rows["x"].taxonomy_labels["SecuritySurface"] == 0.9 and rows["x"].symbolic_gate_passed


def test_mutants():
    kinds = lambda s, g: {m[0] for m in mutate.mutants(s, g)}
    assert kinds("def f(a=None):\n    if a:\n        return q.get('k')\n    with open('x') as h:\n        pass\n", "python") == {"mutable_defaults", "truthiness_inversion", "optional_chaining_drift", "unclosed_resource"}
    assert kinds("async function f() { const a = await go(); if (!a) { return b?.c; } }", "typescript") == {"floating_promises", "truthiness_inversion", "optional_chaining_drift"}
    assert kinds("func f() {\n\tif err != nil { return }\n\tv, ok := <-ch\n\tdefer x.Close()\n}", "go") == {"truthiness_inversion", "unhandled_channel_read", "unclosed_resource"}
    assert kinds("fn f() {\n    if a == c { }\n    drop(b);\n}", "rust") == {"truthiness_inversion", "unclosed_resource"}


def test_streaming_windows(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id AS user_id, 'a' AS event_type, 1.0D AS value FROM range(60)")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = incremental.event_windows(stream, "20 minutes").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM w").collect()) == [20, 20, 20]
    assert incremental.sessions(events, late=None).count() == 60


def test_numbering_by_buckets_is_one_order(spark):
    from pyspark.sql import Window

    from plinth.operators import records

    rows = spark.range(3000).select(F.concat(F.lit("t"), F.col("id") % 900).alias("input_dsl"), F.lit("c").alias("category"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("label"), "id")
    got = records.numbered(rows, ("label",))
    places = {k: sorted(r.place for r in got.where(F.col("label").eqNullSafe(F.lit(k))).collect()) for k in (0, 1, None)}
    assert all(v == list(range(1, len(v) + 1)) for v in places.values()) and sum(map(len, places.values())) == 3000
    order = F.row_number().over(Window.partitionBy("label").orderBy(records.seeded_order(), "input_dsl", "category"))
    one = {(r.label, r.p): r.input_dsl for r in rows.withColumn("p", order).collect()}
    assert {(r.label, r.place): r.input_dsl for r in got.collect()} == one
