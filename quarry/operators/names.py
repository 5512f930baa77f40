"""Entity names: index, resolution, confidence and listings for a batch of questions.

A name is an array of tokens. Candidates meet questions on exploded tokens, an equi-join, and subset tests are left to the joined rows; nothing is
compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.sources import records as R


def _list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ";"), lambda v: F.trim(v)), lambda v: v != "")


def _all_keys(values: Column) -> Column:
    return F.flatten(F.transform(values, X.keys_of))


def names_of_records(records: DataFrame) -> DataFrame:
    """(name, doc_id, size, main, prov, page) of records (sources.records.records); a record's strongest claim to a name counts.

    Identity is the headline, the page title without parentheses, the full name and its quoted nickname form; codenames and aliases follow; a
    record without a page claims no more than a codename; one with fewer than MIN_FIELDS fields is known by its title alone.
    """
    t, head = F.col("text"), F.col("headline")
    page = F.regexp_replace("page", r"(\s*\([^()]*\))+\s*$", "")
    full = R.field_value(t, "Full name")
    nick = F.regexp_extract(full, '"([^"]+)"', 1)
    short = F.when(nick != "", F.concat(nick, F.lit(" "), F.substring(full, F.locate('"', full, 1) + F.length(nick) + 2, F.length(full)))).otherwise(F.lit(""))
    identity = F.concat(_all_keys(F.array(X.drop_reality(head), F.col("_page"), F.col("_full"), F.col("_short"))), F.array(X.norm(X.drop_paren(head)), X.norm(F.col("_full"))))
    aliases = F.concat(_list(R.field_value(t, "Also known as")), _list(R.field_value(t, "Other aliases")))
    aliases = F.filter(F.transform(aliases, X.drop_paren), lambda a: (F.length(a) > 0) & (F.length(a) < 60))
    tagged = lambda names, prov: F.transform(names, lambda n: F.struct(n.alias("name"), prov.cast("int").alias("prov")))
    top = F.when(F.col("has_page"), F.lit(c.PROV_IDENTITY)).otherwise(F.lit(c.PROV_CODENAME))
    rich = F.concat(tagged(identity, top), tagged(_all_keys(_list(R.field_value(t, "Codename"))), F.lit(c.PROV_CODENAME)), tagged(_all_keys(aliases), F.lit(c.PROV_ALIAS)))
    plain = tagged(X.keys_of(X.untitled(head)), F.lit(c.PROV_IDENTITY))
    claims = F.when(F.col("field_count") < c.MIN_FIELDS, plain).otherwise(rich)
    parts = records.withColumn("_page", page).withColumn("_full", full).withColumn("_short", short)
    rows = parts.select("doc_id", F.col("size").cast("long").alias("size"), F.col("is_main").alias("main"), F.col("has_page").alias("page"), F.explode(claims).alias("n"))
    return rows.where(F.size("n.name") > 0).groupBy(F.col("n.name").alias("name"), "doc_id").agg(F.first("size").alias("size"), F.first("main").alias("main"), F.max("n.prov").alias("prov"), F.first("page").alias("page"))


def name_index(claims: DataFrame, notable: DataFrame | None = None) -> DataFrame:
    """(name, rnk, doc_id, size, main, prov, page, famous): the best NAMES_KEPT claims to each name.

    Order: main continuity, more than an alias, digits of the size, provenance, size, doc_id. For notable names (name) the largest record leads
    instead if it is NOTABLE_SIZE_RATIO times the first's size. Ranks come from two windows over one partitioning by name.
    """
    usual = Window.partitionBy("name").orderBy(F.desc("main"), F.desc(F.col("prov") > 0), F.desc(X.size_class(F.col("size"))), F.desc("prov"), F.desc("size"), "doc_id")
    first = claims.withColumn("r1", F.row_number().over(usual))
    if notable is None:
        return first.where(F.col("r1") <= c.NAMES_KEPT).withColumnRenamed("r1", "rnk").withColumn("famous", F.lit(False))
    known = first.join(notable.select("name").distinct().withColumn("known", F.lit(True)), "name", "left")
    by_size = Window.partitionBy("name").orderBy(F.desc("page"), F.desc("prov"), F.desc("size"), F.desc("main"), "r1")
    second = known.withColumn("r2", F.row_number().over(by_size))
    whole = Window.partitionBy("name")
    lead = F.max(F.when(F.col("r2") == 1, F.col("size"))).over(whole)
    was = F.max(F.when(F.col("r1") == 1, F.col("size"))).over(whole)
    famous = F.coalesce("known", F.lit(False)) & (lead >= c.NOTABLE_SIZE_RATIO * was)
    ranked = second.withColumn("famous", famous).withColumn("rnk", F.when(F.col("famous"), F.col("r2")).otherwise(F.col("r1")))
    return ranked.where(F.col("rnk") <= c.NAMES_KEPT).drop("r1", "r2", "known")


def matches(index: DataFrame, questions: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, name, tier, n_extra) of questions (qid, question): every name that equals the question's key (tier 2), lies within it (1) or holds it with at most EXTRA_TOKENS more tokens (0).

    A name within the question counts only if all other words of the question are known: in `vocabulary` (term), or, without it, in any name.
    """
    key = questions.select("qid", X.query_key_or_all(F.col("question")).alias("key")).where(F.size("key") > 0)
    names = index.select("name").distinct()
    by_token = names.select(F.explode(F.array_distinct("name")).alias("token"), "name")
    met = key.select("qid", "key", F.explode(F.array_distinct("key")).alias("token")).join(by_token, "token").select("qid", "key", "name").distinct()
    within = F.size(F.array_except("name", "key")) == 0
    holds = (F.size(F.array_except("key", "name")) == 0) & (F.size("name") - F.size("key") <= c.EXTRA_TOKENS)
    tier = F.when(F.col("key") == F.col("name"), 2).when(within, 1).when(holds, 0)
    tiers = met.withColumn("tier", tier).where("tier is not null")
    words = vocabulary.select("term").distinct() if vocabulary is not None else by_token.select(F.col("token").alias("term")).distinct()
    asked = key.select("qid", F.explode(F.array_distinct("key")).alias("term"))
    unknown = asked.join(words, "term", "left_anti").groupBy("qid").agg(F.collect_set("term").alias("unknown"))
    guarded = tiers.join(unknown, "qid", "left")
    return guarded.where((F.col("tier") != 1) | F.col("unknown").isNull() | (F.size(F.array_except("unknown", "name")) == 0)).select("qid", "name", "tier")


def _rank() -> Column:
    """Higher wins: not a mere part of the question, main continuity or fame, more than an alias, size, tier, the smaller doc_id."""
    return F.struct((F.col("tier") != 1).alias("a"), (F.col("main") | F.col("famous")).alias("b"), (F.col("prov") > 0).alias("c"), F.col("size").alias("d"), F.col("tier").alias("e"), (-F.col("doc_id")).alias("f"))


def resolve(index: DataFrame, questions: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, name): the record that each question names; questions that name none have no row. Of each name only its first claim counts."""
    best = matches(index, questions, vocabulary).join(index.where("rnk = 1"), "name").where(f"tier <> 0 or prov = {c.PROV_IDENTITY}")
    return best.groupBy("qid").agg(F.max_by(F.struct("doc_id", "name"), _rank()).alias("b")).select("qid", "b.doc_id", F.array_join("b.name", " ").alias("name"))


def confidence(index: DataFrame, questions: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, confidence): the first record's size over the second's, over all claims to all matching names; infinite with fewer than two. Only claims of the first's identity standing contest it."""
    rows = matches(index, questions, vocabulary).join(index, "name").withColumn("rank", _rank())
    docs = rows.groupBy("qid", "doc_id").agg(F.max(F.struct("rank", "size", "prov")).alias("b")).select("qid", "doc_id", "b.*")
    lead = F.max_by("prov", "rank").over(Window.partitionBy("qid"))
    peers = docs.withColumn("lead", lead).where(f"lead <> {c.PROV_IDENTITY} or prov = {c.PROV_IDENTITY}")
    two = peers.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank")))).where("r <= 2")
    ratio = two.groupBy("qid").agg(F.max(F.when(F.col("r") == 1, F.col("size"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("size"))).alias("two"))
    known = questions.select("qid").join(ratio, "qid", "left")
    return known.select("qid", F.when(F.coalesce("two", F.lit(0)) > 0, F.col("one") / F.col("two")).otherwise(F.lit(float("inf"))).alias("confidence"))


def legacy(claims: DataFrame) -> DataFrame:
    """(name, rnk, doc_id, prov): the LEGACY_KEPT largest records that go by a name without being it."""
    order = Window.partitionBy("name").orderBy(F.desc("size"), F.desc("doc_id"), F.desc("prov"))
    return claims.where(F.col("prov") < c.PROV_IDENTITY).withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= c.LEGACY_KEPT).select("name", "rnk", "doc_id", "prov")


def variants(records: DataFrame, questions: DataFrame, most: int = 12) -> DataFrame:
    """(qid, n_variants, rnk, headline): records whose headline without its reality has the question's key; of each headline the largest, largest first."""
    keyed = records.select(X.norm(X.drop_reality(F.col("headline"))).alias("key"), "headline", "size", "doc_id")
    # A key's records are counted and its best headlines found once, however many questions ask for it.
    one = keyed.groupBy("key", "headline").agg(F.max(F.struct("size", "headline", "doc_id")).alias("b"), F.count("*").alias("n"))
    total = one.groupBy("key").agg(F.sum("n").alias("n"))
    placed = one.select("key", "b", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("b"))).alias("at")).where(F.col("at") <= most)
    met = questions.select("qid", X.query_key_or_all(F.col("question")).alias("key")).join(placed.join(total, "key"), "key")
    asked = met.withColumn("n_variants", F.sum(F.when(F.col("at") == 1, F.col("n"))).over(Window.partitionBy("qid")))
    each = asked.groupBy("qid", "b").agg(F.first("n_variants").alias("n_variants"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("b")))
    return each.withColumn("rnk", rank).where(F.col("rnk") <= most).select("qid", "n_variants", "rnk", F.col("b.headline").alias("headline"))
