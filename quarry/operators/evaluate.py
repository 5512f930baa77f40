"""Evaluation of resolution and answers: drawn records, probes, scores of probes and of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X


def sample_unambiguous(claims: DataFrame, n: int, seed: str = "probe") -> DataFrame:
    """(name, doc_id): n drawn records among those whose name (of identity standing) belongs to nobody else. A sample is what is asked for."""
    alone = claims.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("prov").alias("prov")).where(f"n = 1 and prov = {c.PROV_IDENTITY}")
    return alone.orderBy(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(seed))), "name").limit(n).select("name", "doc_id")


def probes(records: DataFrame) -> DataFrame:
    """(doc_id, label, question) of records (doc_id, name, full_name): questions whose right answer is the record."""
    name, full = F.col("name"), F.regexp_replace("full_name", r'^"+|"+$', "")
    fixed = [("headline", F.concat(F.lit("who created "), name)), ("profile", F.concat(F.lit("tell me about "), name)), ("field", F.concat(F.lit("what powers does "), name, F.lit(" have")))]
    real = F.when((full != "") & (F.lower(full) != F.lower(name)) & (F.length(full) < 40), F.struct(F.lit("real name").alias("label"), F.concat(F.lit("who is "), full).alias("question")))
    rows = F.array_compact(F.array(*[F.struct(F.lit(k).alias("label"), q.alias("question")) for k, q in fixed], real))
    return records.select("doc_id", F.explode(rows).alias("p")).select("doc_id", "p.label", "p.question")


def round_trip(asked: DataFrame, resolved: DataFrame, claims: DataFrame) -> DataFrame:
    """(label, n, exact, owns) of asked (qid, label, doc_id, name) and resolved (qid, doc_id, headline_key): the share resolved to the record itself, and to any that holds the name."""
    owners = claims.select(F.col("name").alias("owned"), F.col("doc_id").alias("owner"), F.lit(1).alias("owns")).distinct()
    got = asked.join(resolved.select("qid", F.col("doc_id").alias("got")), "qid", "left").join(owners, (F.col("got") == F.col("owner")) & (F.col("name") == F.col("owned")), "left")
    share = lambda x: F.round(F.avg(F.coalesce(x.cast("int"), F.lit(0))), 9)
    return got.groupBy("label").agg(F.count("*").alias("n"), share(F.col("got") == F.col("doc_id")).alias("exact"), share(F.col("owns") == 1).alias("owns"))


def case_scores(cases: DataFrame) -> DataFrame:
    """Cases (case_id, answer, must_include, must_not_include, page, expect) with passed and the first failure: a phrase missing, one forbidden, another page.

    Phrases are compared in lower case; a null answer holds nothing; a null expect asks for no page.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    missing = F.filter(F.coalesce("must_include", F.array().cast("array<string>")), lambda s: ~F.contains(answer, F.lower(s)))
    barred = F.filter(F.coalesce("must_not_include", F.array().cast("array<string>")), lambda s: F.contains(answer, F.lower(s)))
    why: Column = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.get(missing, F.lit(0))))
        .when(F.size(barred) > 0, F.concat(F.lit("forbidden: "), F.get(barred, F.lit(0))))
        .when(F.col("expect").isNotNull() & ~F.col("page").eqNullSafe(F.col("expect")), F.concat(F.lit("page: "), F.coalesce("page", F.lit("none"))))
    )
    return cases.select("case_id", why.isNull().alias("passed"), F.coalesce(why, F.lit("")).alias("why"))


def provenance(shown: DataFrame, claims: DataFrame) -> DataFrame:
    """(qid, doc_id, badge) of shown (qid, key, doc_id): how the record holds the name that was asked: identity, codename or alias; alias where it has no claim."""
    # A record's claims are one row, so that they are joined where they are.
    own = claims.groupBy("doc_id").agg(F.collect_list(F.struct("name", "prov")).alias("claims"))
    of_key = F.array_max(F.transform(F.filter("claims", lambda x: x["name"] == F.col("key")), lambda x: x["prov"]))
    held = shown.join(own, "doc_id", "left").select("qid", "doc_id", of_key.alias("prov"))
    badge = F.when(F.col("prov") == c.PROV_IDENTITY, "identity").when(F.col("prov") == c.PROV_CODENAME, "codename").otherwise("alias")
    return held.select("qid", "doc_id", badge.alias("badge"))


def asked_keys(questions: DataFrame) -> DataFrame:
    """(qid, key): the key of each question."""
    return questions.select("qid", X.query_key_or_all(F.col("question")).alias("key"))
