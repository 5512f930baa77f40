"""Answers from records: fields, profiles, passages, contexts and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.sources import records as R

# What a question asks for (pattern), the field that answers, and how; the first that matches counts.
INTENTS = (
    ("creator", "Created by", r"\bwho\s+(created|made|wrote|drew|designed)\b|\bcreators?\s+of\b|\bwho\s+(is|are)\s+the\s+creators?\b", "{e} was created by {v}."),
    ("first_appearance", "First appearance", r"\bfirst\s+appear\w*|\bdebut\w*|\bwhich\s+(comic|issue|book)\b|\bwhere\s+(do|should|can|would)\s+i\s+(start|begin)|\bstart\s+(with|reading)\b", "{e} first appeared in {v}."),
    ("real_name", "Full name", r"\breal\s+name\b|\bsecret\s+identity\b|\btrue\s+identity\b|\bwho\s+is\s+.+\s+really\b|\bunder\s+the\s+(mask|hood|helmet)\b", "{e}'s real name is {v}."),
    ("powers", "Powers", r"\bwhat\s+powers?\b|\bpowers?\s+(?:does|do|has|have|of)\b|\b(?:his|her|its|their)\s+powers?\b|\bwhat\s+can\s+.+\s+do\b|\bhow\s+strong\b", "{e}'s powers include {v}."),
    ("abilities", "Abilities", r"\babilit\w*|\bskill\w*|\btrained\s+in\b|\bgood\s+at\b", "{e} is skilled in {v}."),
    ("reality", "Reality", r"\bwhich\s+(earth|reality|continuity|universe)\b|\bwhat\s+(earth|reality|continuity|universe)\b|\bwhere\s+is\s+.+\s+from\b", "{e} is from {v}."),
    ("species", "Species / origin", r"\bspecies\b|\bwhat\s+kind\s+of\b|\borigin\b", "{e} is {v}."),
    ("affiliation", "Affiliation", r"\bwhat\s+teams?\b|\bwhich\s+teams?\b|\baffiliat|\bwho\s+does\s+.+\s+work\s+(with|for)\b", "{e} is affiliated with {v}."),
    ("occupation", "Occupation", r"\boccupation\b|\bfor\s+a\s+living\b|\bwhat.s\s+.+\s+job\b", "{e} works as {v}."),
    ("base", "Base of operations", r"\bwhere\s+(does|do)\s+.+\s+(live|operate|based)\b|\bbase\s+of\s+operations\b", "{e} is based in {v}."),
)
PROFILE_FIELDS = (("Powers", "Powers"), ("Created by", "Created by"), ("First appearance", "First appearance"), ("Occupation", "Occupation"), ("Affiliation", "Teams"))
PROFILE_ROWS, ANSWER_CHARS, ANSWER_ITEMS, PASSAGE_SENTENCES, PASSAGE_FLOOR = 4, 320, 6, 3, 0.5
BOILERPLATE = r"(?i)abridged version|expanded history|for a complete history"
CITATION = r"^[A-Z0-9].*\bVol\s+\d+\s+\d+\S*$"


def intent(question: Column) -> Column:
    """(name, label, template) of the first intent that matches, null if none."""
    out = F.lit(None).cast("struct<name:string,label:string,template:string>")
    for name, label, pattern, template in reversed(INTENTS):
        out = F.when(F.lower(question).rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(template).alias("template"))).otherwise(out)
    return out


def clean_items(value: Column) -> Column:
    """The ';' items of a field: trailing filing cut off, bare sub-labels and bare punctuation left out."""
    items = F.transform(F.split(value, ";"), lambda v: F.trim(F.regexp_replace(v, r"\s*Category:.*$", "")))
    return F.filter(items, lambda v: (v != "") & ~v.rlike(r"^[^:]{1,30}:$") & ~v.rlike(r"^\W+$"))


def without_citations(items: Column) -> Column:
    """citations go, unless nothing would be left."""
    kept = F.filter(items, lambda v: ~v.rlike(CITATION))
    return F.when(F.size(kept) > 0, kept).otherwise(items)


def first_sentence(item: Column) -> Column:
    at = F.locate(". ", item)
    return F.when((at > 1) & (at <= ANSWER_CHARS), F.substring(item, F.lit(1), at - 1)).otherwise(F.rtrim(F.substring(item, 1, ANSWER_CHARS)))


def _short(item: Column) -> Column:
    return F.when(F.length(item) <= ANSWER_CHARS, item).otherwise(first_sentence(item))


def _fitted(items: Column) -> Column:
    """The leading items, shortened, whose sizes stay within ANSWER_CHARS and ANSWER_ITEMS; the first always; after the first that doesn't fit none."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, v: Column) -> Column:
        over = acc["stop"] | ((F.size(acc["kept"]) > 0) & ((acc["used"] + F.length(v) > ANSWER_CHARS) | (F.size(acc["kept"]) >= ANSWER_ITEMS)))
        more = F.struct((acc["used"] + F.length(_short(v))).alias("used"), F.lit(False).alias("stop"), F.concat(acc["kept"], F.array(_short(v))).alias("kept"))
        return F.when(over, F.struct(acc["used"].alias("used"), F.lit(True).alias("stop"), acc["kept"].alias("kept"))).otherwise(more)

    return F.aggregate(items, start, add)["kept"]


def field_answers(questions: DataFrame) -> DataFrame:
    """Q1: (qid, intent, answer) of questions (qid, question, text: the record they resolved to); those without an intent have no row.

    A record without the field is said not to have it; nothing is made up.
    """
    rows = questions.withColumn("i", intent(F.col("question"))).where("i is not null")
    value = F.lit("")
    for _, label, _, _ in INTENTS:
        value = F.when(F.col("i.label") == label, R.field_value(F.col("text"), label)).otherwise(value)
    items = clean_items(F.col("value"))
    items = F.when(F.col("i.label").isin("Powers", "Abilities"), without_citations(items)).otherwise(items)
    entity = X.drop_reality(X.headline(F.col("text")))
    said = F.replace(F.replace(F.col("i.template"), F.lit("{e}"), entity), F.lit("{v}"), X.humanize(F.array_join("parts", "; ")))
    none = F.concat(F.lit("I don't have "), entity, F.lit("'s "), F.lower("i.label"), F.lit(" in my sources."))
    answer = F.when(F.size("parts") == 0, none).otherwise(F.regexp_replace(said, r"\.{2,}$", "."))
    return rows.withColumn("value", value).withColumn("parts", _fitted(items)).select("qid", F.col("i.name").alias("intent"), answer.alias("answer"))


def _profile(t: Column) -> Column:
    """[(label, value)] of the profile fields that a record has, in order, PROFILE_ROWS at most."""
    rows = []
    for key, label in PROFILE_FIELDS:
        items = clean_items(R.field_value(t, key))
        items = without_citations(items) if key == "Powers" else items
        rows.append(F.struct(F.lit(label).alias("label"), F.array_join(F.transform(items, _short), "; ").alias("value")))
    return F.slice(F.filter(F.array(*rows), lambda r: r["value"] != ""), 1, PROFILE_ROWS)


def profile_count(t: Column) -> Column:
    """How many rows the record's profile has."""
    return F.size(_profile(t))


def profile_rows(records: DataFrame) -> DataFrame:
    """Q2: (doc_id, place, label, value): up to PROFILE_ROWS of the profile fields that a record has, in order."""
    return records.select("doc_id", F.posexplode(_profile(F.col("text"))).alias("place", "r")).select("doc_id", (F.col("place") + 1).alias("place"), "r.label", "r.value")


def passages(asked: DataFrame, skip: int = 0) -> DataFrame:
    """Q4: (qid, passage) of asked (qid, question, headline, page, body): sentences of the body that say what the question asks beyond the record's own name.

    Terms weigh one over the number of the body's sentences that hold them; the best PASSAGE_SENTENCES of at least PASSAGE_FLOOR of the best score are given in
    their order. Without such terms the opening sentences are; where no sentence holds a term there is no row. skip: sentences shown before.
    """
    found = F.filter(X.sentences(F.col("body")), lambda s: ~s.rlike(BOILERPLATE))
    own = F.concat(X.norm(F.col("headline")), X.norm(F.coalesce("page", F.lit(""))))
    base = asked.select("qid", found.alias("s"), F.array_distinct(F.array_except(X.query_key_or_all(F.col("question")), own)).alias("terms")).where("size(s) > 0")
    bare = base.where("size(terms) = 0 and size(s) > " + str(skip)).select("qid", F.array_join(F.slice("s", skip + 1, PASSAGE_SENTENCES), " ").alias("passage"))
    each = base.where("size(terms) > 0").select("qid", "terms", F.posexplode("s").alias("i", "sentence"))
    hits = each.select("qid", "i", "sentence", F.explode(F.array_intersect("terms", X.norm(F.col("sentence")))).alias("term"))
    seen = hits.groupBy("qid", "term").agg((1 / F.count("*")).alias("weight"))
    scored = hits.join(seen, ["qid", "term"]).groupBy("qid", "i").agg(F.round(F.sum("weight"), 9).alias("score"), F.first("sentence").alias("sentence"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "i")
    ranked = scored.withColumn("r", F.row_number().over(order)).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    kept = ranked.where((F.col("r") > skip) & (F.col("r") <= skip + PASSAGE_SENTENCES) & (F.col("score") >= PASSAGE_FLOOR * F.col("best")))
    told = kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("passage"))
    return told.union(bare)


def trimmed_record(head: Column, fields: Column, most: int = c.RECORD_CHARS) -> Column:
    """The headline and those fields, in order, that still fit in `most` characters; one that doesn't fit is skipped, later ones may."""
    start = F.struct(F.length(head).alias("used"), F.array(head).alias("kept"))

    def add(acc: Column, f: Column) -> Column:
        line = X.clip(F.concat(f["label"], F.lit(": "), f["value"]))
        more = F.struct((acc["used"] + F.length(line)).alias("used"), F.concat(acc["kept"], F.array(line)).alias("kept"))
        return F.when(acc["used"] + F.length(line) > most, acc).otherwise(more)

    return F.array_join(F.aggregate(fields, start, add)["kept"], "\n")


def context_blocks(blocks: DataFrame, most: int = c.CONTEXT_CHARS) -> DataFrame:
    """(qid, n_blocks, context) of blocks (qid, rnk, block): in order while they fit in `most` characters; the first always, after one that doesn't none."""
    before = F.sum(F.length("block")).over(Window.partitionBy("qid").orderBy("rnk"))
    kept = blocks.withColumn("upto", before).where((F.col("upto") <= most) | (F.col("rnk") == 1))
    return kept.groupBy("qid").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def candidates(ranked: DataFrame, k: int = 8) -> DataFrame:
    """(qid, place, doc_id, score, ambiguous) of ranked (qid, doc_id, score, headline, identity, field_count, size).

    Of each identity the best, then the k best; among near ties of the first that share its headline the richest record leads; a question is ambiguous if the
    first two then differ by less than AMBIGUITY_MARGIN of the first, or the first's score isn't positive.
    """
    best = F.row_number().over(Window.partitionBy("qid", "identity").orderBy(F.desc("score"), "doc_id"))
    one = ranked.withColumn("_i", best).where("_i = 1").drop("_i")
    q = Window.partitionBy("qid")
    placed = one.withColumn("r", F.row_number().over(q.orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= k)
    lead = placed.withColumn("top", F.max("score").over(q)).withColumn("head", F.max(F.when(F.col("r") == 1, F.col("headline"))).over(q))
    tied = (F.col("headline") == F.col("head")) & (F.col("top") > 0) & ((F.col("top") - F.col("score")) / F.abs("top") < c.FLAGSHIP_MARGIN)
    rich = F.max(F.when(tied, F.struct("field_count", "size", (-F.col("r")).alias("back")))).over(q)
    first = lead.withColumn("rich", rich).withColumn("promoted", F.coalesce(F.col("rich.back") == -F.col("r"), F.lit(False)))
    order = F.row_number().over(q.orderBy(F.desc("promoted"), "r"))
    out = first.withColumn("place", order)
    score = lambda p: F.max(F.when(F.col("place") == p, F.col("score"))).over(q)
    two = out.withColumn("s1", score(1)).withColumn("s2", score(2))
    unclear = F.when(F.col("s2").isNull(), False).when(F.col("s1") <= 0, True).otherwise((F.col("s1") - F.col("s2")) / F.abs("s1") < c.AMBIGUITY_MARGIN)
    return two.select("qid", "place", "doc_id", "score", unclear.alias("ambiguous"))
