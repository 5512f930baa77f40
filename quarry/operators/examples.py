"""Question and answer examples from records (G1-G5, J13, J14, A13). Every draw is a function of record, purpose and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.operators.ranks import range_of, with_places
from quarry.sources import records as R

#: Shapes of examples by field: question and answer; {e} the record, {v} the value.
TEMPLATES = (
    ("Created by", "Who created {e}?", "{e} was created by {v}."),
    ("First appearance", "Where did {e} first appear?", "{e} first appeared in {v}."),
    ("Full name", "What is the full name of {e}?", "The full name of {e} is {v}."),
    ("Powers", "What can {e} do?", "{e} has these powers: {v}."),
    ("Occupation", "What does {e} work as?", "{e} works as {v}."),
    ("Affiliation", "Which teams does {e} belong to?", "{e} belongs to {v}."),
)
VALUE_CHARS, MAX_PAIRS = 220, 4
#: Shape: how often a record gives an example of it.
GATES = {"qa": 0.85, "open": 0.55, "unknown": 0.12}
#: Records before one that its decoy is drawn from, and those that an unknown name is drawn from.
NEIGHBOURS, STRANGERS = 300, 500


def _with_values(records: DataFrame) -> DataFrame:
    """records with _e, the entity's name, and _v, the readable values of the templates' fields; each text is taken apart once."""
    values = R.field_values(F.col("text"), [label for label, _, _ in TEMPLATES])
    return records.withColumn("_e", X.drop_reality(X.headline(F.col("text")))).withColumn("_v", F.transform(values, X.humanize))


def qa_pairs(records: DataFrame, seed: str = "qa") -> DataFrame:
    """G1: (doc_id, kind, user, assistant) of records (doc_id, text): one for each templated field that the record has, MAX_PAIRS at most, those of least draw."""
    gated = _with_values(records.where(X.draw(F.col("doc_id").cast("string"), F.lit("gate-qa"), F.lit(seed)) < GATES["qa"]))
    rows = gated.select("doc_id", "_e", F.posexplode("_v").alias("k", "v")).where((F.col("v") != "") & (F.length("v") <= VALUE_CHARS))
    shape = F.element_at(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(y).alias("ask"), F.lit(z).alias("say")) for x, y, z in TEMPLATES]), F.col("k") + 1)
    drawn = rows.withColumn("s", shape).withColumn("d", X.draw(F.col("doc_id").cast("string"), F.col("s.label"), F.lit(seed)))
    kept = drawn.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("d", "k"))).where(F.col("r") <= MAX_PAIRS)
    fill = lambda t: F.replace(F.replace(t, F.lit("{e}"), F.col("_e")), F.lit("{v}"), F.col("v"))
    return kept.select("doc_id", F.lit("qa").alias("kind"), fill(F.col("s.ask")).alias("user"), fill(F.col("s.say")).alias("assistant"))


def open_ended(records: DataFrame, seed: str = "qa") -> DataFrame:
    """Who is X: up to three clauses from the record's fields, the name only in the first."""
    rows = _with_values(records.where(X.draw(F.col("doc_id").cast("string"), F.lit("gate-open"), F.lit(seed)) < GATES["open"]))
    labels = F.array(*[F.lit(label.lower()) for label, _, _ in TEMPLATES])
    said = F.zip_with(labels, "_v", lambda a, v: F.when(v != "", F.concat(a, F.lit(": "), X.clip(v, 120))))
    some = rows.where(R.field_count(F.col("text")) >= c.MIN_FIELDS).withColumn("_s", F.slice(F.array_compact(said), 1, 3)).where("size(_s) > 0")
    return some.select("doc_id", F.lit("open").alias("kind"), F.concat(F.lit("Who is "), "_e", F.lit("?")).alias("user"), F.concat("_e", F.lit(" - "), F.array_join("_s", "; "), F.lit(".")).alias("assistant"))


def with_neighbour(records: DataFrame, by: str, seed: str = "decoy", most: int = NEIGHBOURS) -> DataFrame:
    """Each record with one of the up to `most` before it in its group, drawn; none for a group's first."""
    place = with_places(records, by, ["doc_id"], range_of(records, "doc_id")).withColumn("_p", F.col("place") + 1).drop("place", "before")
    back = 1 + F.floor(X.draw(F.col("doc_id").cast("string"), F.lit(seed)) * F.least(F.lit(most), F.col("_p") - 1)).cast("int")
    asked = place.withColumn("_q", F.col("_p") - back).where("_p > 1")
    other = place.select(F.col(by).alias("_by"), F.col("_p").alias("_op"), F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"))
    return asked.join(other, (F.col(by) == F.col("_by")) & (F.col("_q") == F.col("_op"))).drop("_p", "_q", "_by", "_op")


def unknown_pairs(records: DataFrame, by: str, seed: str = "qa") -> DataFrame:
    """A question about another record's name, put with this record's text: the right answer is not to know."""
    rows = with_neighbour(records, by, most=STRANGERS).where(X.draw(F.col("doc_id").cast("string"), F.lit("gate-unknown"), F.lit(seed)) < GATES["unknown"])
    name = X.drop_reality(X.headline(F.col("other_text")))
    return rows.where(name != X.drop_reality(X.headline(F.col("text")))).select("doc_id", F.lit("unknown").alias("kind"), F.concat(F.lit("Who is "), name, F.lit("?")).alias("user"), F.concat(F.lit("I don't have "), name, F.lit(" in my sources.")).alias("assistant"))


def decoy_context(records: DataFrame, by: str, most: int = c.CONTEXT_CHARS, seed: str = "decoy") -> DataFrame:
    """(doc_id, context): the record's own block, always whole, and a neighbour's in what room is left, in drawn order."""
    rows = with_neighbour(records, by, seed)
    room = F.greatest(F.lit(0), most - F.length("text"))
    other = F.substring(F.col("other_text"), F.lit(1), room)
    own_first = X.draw(F.col("doc_id").cast("string"), F.lit("order"), F.lit(seed)) < 0.5
    both = F.when(F.length(other) == 0, F.col("text")).when(own_first, F.concat("text", F.lit("\n\n"), other)).otherwise(F.concat(other, F.lit("\n\n"), F.col("text")))
    return rows.select("doc_id", "other_id", both.alias("context"))


def dataset(records: DataFrame, by: str) -> DataFrame:
    """All shapes of examples."""
    return qa_pairs(records).unionByName(open_ended(records)).unionByName(unknown_pairs(records, by))


def mix_report(examples: DataFrame) -> DataFrame:
    """Examples of each kind and their share."""
    n = examples.groupBy("kind").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("m")))).select("kind", "n", F.round(F.col("n") / F.col("m"), 9).alias("share"))
