import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, states

NOW = "2024-04-01 12:00:00"


def at(s):
    return F.lit(s).cast("timestamp")


@pytest.fixture(scope="module")
def artifact(spark):
    return spark.sql("select 'vectors' artifact_name, 'ready' status, 1 generation, cast(null as string) active_build_token, cast(null as timestamp) build_started_at, cast(null as timestamp) lease_expires_at, 'old' last_error, 'r' last_reason, cast(null as timestamp) last_built_at")


def test_lease(spark, artifact):
    a = states.claim(artifact, "vectors", "one", at(NOW), "rebuild")
    row = a.first()
    assert row.took_effect and row.active_build_token == "one" and row.last_error is None and row.lease_expires_at.minute == 5
    assert not states.claim(a, "vectors", "two", at("2024-04-01 12:05:00"), "again").first().took_effect
    assert states.claim(a, "vectors", "two", at("2024-04-01 12:05:01"), "again").first().active_build_token == "two"
    assert not states.complete(a, "vectors", "two", at(NOW), "done").first().took_effect
    done = states.complete(a, "vectors", "one", at(NOW), "done")
    assert (done.first().generation, done.first().status, done.first().active_build_token) == (2, "ready", None)
    lost = states.fail(a, "vectors", "one", "failed", "broken", "why").first()
    assert (lost.status, lost.last_error, lost.active_build_token, lost.lease_expires_at) == ("ready", "why", None, None)
    first = states.fail(a.withColumn("generation", F.lit(0)), "vectors", "one", "failed", "broken", "why").first()
    assert first.status == "failed"
    assert states.expire(a.withColumn("generation", F.lit(0)), at("2024-04-01 13:00:00"), "x").first().status == "stale"
    gens = spark.sql("select 'vectors' artifact_name, 1 generation, 'g1' bundle_path, 'committed' state, cast(null as timestamp) delete_after union all select 'other', 1, 'o1', 'committed', null")
    bundles = spark.sql("select 'vectors' artifact_name, 'g2' bundle_path")
    after = {(r.artifact_name, r.generation): (r.state, r.delete_after is not None) for r in states.retired(gens, done, bundles, at(NOW)).collect()}
    assert after == {("vectors", 1): ("retained", True), ("vectors", 2): ("committed", False), ("other", 1): ("committed", False)}


def test_plans(spark):
    plans = spark.sql("select 'p' plan_id, 'move' operation_type, 'draft' status, cast(null as timestamp) approved_at, cast(null as timestamp) executed_at union all select 'q', 'delete', 'approved', null, null")
    with pytest.raises(ValueError):
        states.executed(plans, "p", at(NOW), print, "me", "t")
    with pytest.raises(ValueError):
        states.executed(plans, "q", at(NOW), print, "me", "t")
    ready = states.approve(plans, "p", at(NOW)).drop("took_effect")
    after, audit = states.executed(ready, "p", at(NOW), lambda plan: None, "me", "t")
    assert {r.plan_id: r.status for r in after.collect()} == {"p": "executed", "q": "approved"}
    assert (audit.first().operation, audit.first().result) == ("move_execute", "success")

    def broken(plan):
        raise OSError("disk full")

    after, audit = states.executed(ready, "p", at(NOW), broken, "me", "t")
    assert {r.plan_id: r.status for r in after.collect()}["p"] == "failed"
    assert audit.first().result == "failure" and "disk full" in audit.first().detail_json


def test_pages_and_export(spark, tmp_path):
    cites = "array(named_struct('path', 'a.md', 'char_range', '0-3', 'quote', 'abc'))"
    rows = spark.sql(f"select {cites} c, filter({cites}, x -> false) none, array(named_struct('kind', 'risk', 'text', 'late', 'path', 'a.md', 'char_range', '0-3'), named_struct('kind', 'risk', 'text', 'dear', 'path', null, 'char_range', null)) items")
    got = rows.select(
        answers.answer_page(F.lit("T"), F.lit("A"), F.col("c")).alias("a"), answers.answer_page(F.lit("T"), F.lit("A"), F.col("none")).alias("b"), answers.insight_page(F.lit("T"), F.lit("O"), F.col("items")).alias("i"),
    ).first()
    assert got.a == "# T\n\nA\n\n## 引用\n1. `a.md` @0-3 — abc\n" and got.b == "# T\n\nA\n\n## 引用\n- 无\n"
    assert got.i == "# T\n\n## 概览\nO\n\n## 决策\n- 无\n\n## 风险\n- late (`a.md` @0-3)\n- dear\n\n## 待办\n- 无\n"
    target = f"file://{tmp_path}/new/page.md"
    with pytest.raises(ValueError):
        answers.export(spark, got.a, target, confirmed=False)
    answers.export(spark, got.a, target, confirmed=True)
    assert (tmp_path / "new/page.md").read_text() == got.a
    with pytest.raises(FileExistsError):
        answers.export(spark, got.a, target, confirmed=True)


def test_refusal_without_sources(spark):
    rows = spark.sql("select array('x') lines, cast(array() as array<string>) sources, array('n') notes, cast(null as array<string>) checked, cast(array() as array<struct<summary:string,label:string>>) conflicts")
    got = answers.rendered(rows).first()
    assert got.result_type == "insufficient_evidence" and "1. 当前未检索到可用来源" in got.answer
