"""Steps whose work must not grow with the square of the rows that share a key, nor one task's memory with the input."""

from pyspark.sql import functions as F
from quarry.operators import names as N


def join_rows(spark, make):
    """The most rows that a join of the query of make() gave, by its metrics."""
    df = make()
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_variants_of_a_name_that_many_share_are_found_once(spark):
    records = spark.range(400).select(F.concat(F.lit("red ring (Earth-"), (F.col("id") % 20).cast("string"), F.lit(")")).alias("headline"), F.col("id").alias("size"), F.col("id").alias("doc_id"))
    questions = spark.range(300).select(F.col("id").alias("qid"), F.lit("who is red ring").alias("question"))
    got = N.variants(records, questions).where("qid = 7").orderBy("rnk").collect()
    assert [(r.n_variants, r.headline) for r in got] == [(400, f"red ring (Earth-{k})") for k in range(19, 7, -1)]
    assert join_rows(spark, lambda: N.variants(records, questions)) <= 300 * 12


def test_claims_to_names_are_gathered_by_part(spark, tmp_path, monkeypatch):
    from quarry.plans import name_plans

    monkeypatch.setattr(name_plans, "PARTS_OF_TASK", 5, raising=False)
    spark.range(20).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(3).alias("p_size"), F.lit(9.5).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    claims = name_plans.part_claims(spark, str(tmp_path))
    plan = claims._jdf.queryExecution().executedPlan().toString()
    assert claims.count() == 60
    # One exchange, by part, into tasks of a bounded number of parts, below both aggregates.
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(p_partkey" in plan and ", 5)" in plan


def test_an_index_moves_no_postings_and_scores_are_added_where_they_are(spark, tmp_path, monkeypatch):
    from quarry.operators import search as S

    monkeypatch.setattr(S, "PAIRS_OF_TASK", 10, raising=False)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("red red rings b"), F.col("id").cast("string")).alias("text"), F.lit("red").alias("headline"))
    asked = spark.range(3).select(F.col("id").alias("qid"), F.lit("red b1").alias("question"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(S.index_of(docs).docs)
    index = S.save_index(docs, f"file://{tmp_path}/index")
    scores = S.bm25_scores(index, asked)
    # One exchange of asked postings, by document; no pair of question and document is dealt out again.
    assert plan(scores).count("hashpartitioning(doc_id") == 1 and "hashpartitioning(qid" not in plan(scores)
    assert scores.count() == 90
    assert {tuple(r) for r in index.terms.where("term in ('red', 'ring', 'rings')").collect()} == {("red", 30, 60), ("ring", 30, 30), ("rings", 30, 30)}
