"""What to do with each question of a batch: the plan of a turn, and the prompt of one that a model must answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import surface as U
from quarry.functions import text as X
from quarry.operators import answers as A
from quarry.sources import records as R


def _let(x: Column, say: Callable[[Column], Column]) -> Column:
    """say(x), where x is worked out once however often `say` names it."""
    return F.get(F.transform(F.array(x), say), F.lit(0))


def profile_prose(text: Column) -> Column:
    """Q3: who a record is about, in a sentence for each of up to three fields; without fields its opening prose; null if there is neither."""
    name = X.drop_reality(X.headline(text))
    read = F.transform(R.field_values(text, [label for _, label, _, _ in A.INTENTS]), lambda v: _let(F.array_join(A.clean_items(v), "; "), lambda j: _let(X.humanize(j), A._short)))
    said = F.zip_with(read, F.array(*[F.lit(say) for _, _, _, say in A.INTENTS]), lambda v, t: F.when(v != "", F.replace(F.replace(t, F.lit("{e}"), name), F.lit("{v}"), v)))
    return _let(F.slice(F.array_compact(said), 1, 3), lambda told: F.when(F.size(told) > 0, U.tidy(F.array_join(told, " "))).otherwise(U.prose_summary(text)))


def plan_turns(asked: DataFrame) -> DataFrame:
    """Q7: (qid, branch, text, n_rows, quoted, leads) of asked (qid, question, doc_id, text: the record it resolved to or null, kind, confidence, n_variants, settled).

    Branches in their order: chitchat (a model answers with no context), choice (two records or more could be meant), field, list (of variants), profile, prompt (a model answers
    from the record), unknown (nothing is named). quoted: a passage of the record goes with the answer; leads: before it.
    """
    q, text = F.col("question"), F.col("text")
    facts = F.struct(
        U.is_chitchat(q).alias("small"), A.intent(q).isNotNull().alias("field"), X.query_key(q).alias("key"), U.wants_variants(q).alias("list"), U.wants_profile(q).alias("whole"),
        F.when(U.wants_profile(q), profile_prose(text)).alias("prose"), A.profile_count(text).alias("rows"),
    )

    def branch(f: Column) -> Column:
        choice = U.wants_choice(q, text.isNotNull(), f["key"], F.col("settled"), F.col("confidence")) & (F.col("n_variants") > 1)
        which = (
            F.when(f["small"], "chitchat").when(text.isNull(), "unknown").when(choice, "choice").when(f["field"], "field").when(f["list"], "list").when(f["whole"] & f["prose"].isNotNull(), "profile").otherwise("prompt")
        )
        return F.struct(which.alias("branch"), f["prose"].alias("prose"), f["rows"].alias("rows"))

    planned = asked.withColumn("_p", _let(facts, branch))
    fields = A.field_answers(planned.where("_p.branch = 'field'").select("qid", "question", "text")).select("qid", F.col("answer").alias("_field"))
    said = F.when(F.col("_p.branch") == "field", U.tidy(F.col("_field"))).when(F.col("_p.branch") == "profile", F.col("_p.prose"))
    placed = planned.join(fields, "qid", "left").select("qid", "question", "kind", F.col("_p.branch").alias("branch"), said.alias("said"), F.when(F.col("_p.branch") == "profile", F.col("_p.rows")).alias("n_rows"))
    quoted = F.col("branch").isin("field", "list", "profile", "prompt") & U.wants_passage(q, F.col("said"), F.col("n_rows"), F.col("kind"))
    leads = U.passage_leads(q, F.col("n_rows"), F.col("kind"))
    return placed.select("qid", "branch", F.col("said").alias("text"), "n_rows", quoted.alias("quoted"), (quoted & leads).alias("leads"))


def prompts(planned: DataFrame, contexts: DataFrame) -> DataFrame:
    """Q8: (qid, prompt) of planned (qid, question, branch) and contexts (qid, context): what a model continues. Small talk and unknown names get no context."""
    context = F.when(F.col("branch").isin("chitchat", "unknown"), F.lit("")).otherwise(F.coalesce("context", F.lit("")))
    head = F.when(context != "", F.concat(F.lit("Context:\n"), context, F.lit("\n\n"))).otherwise(F.lit(""))
    return planned.join(contexts, "qid", "left").select("qid", F.concat(head, F.lit("User: "), F.col("question"), F.lit("\nAssistant:")).alias("prompt"))


def top_record(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id): the first of each question's candidates (qid, place, doc_id)."""
    return candidates.where("place = 1").select("qid", "doc_id")


def contexts_of(records: DataFrame, most: int = c.CONTEXT_CHARS) -> DataFrame:
    """The context of one record for each question: records (qid, text)."""
    block = A.trimmed_record(X.headline(F.col("text")), R.fields(F.col("text")))
    return A.context_blocks(records.select("qid", F.lit(1).alias("rnk"), block.alias("block")), most).select("qid", "context")
