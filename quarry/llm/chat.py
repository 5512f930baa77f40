"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

Everything is DataFrame functions. A template marks each turn as START role NEWLINE text END; control strings inside texts are
escaped reversibly: each `<`, any backslashes, `|` gets one more backslash, so that `<|` never occurs in an escaped text, and texts without
such a run stay as they are. Newlines and backslashes in roles are escaped too, so that a role ends at the first newline.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """start, end: what marks a turn; loss_roles: whose texts the loss covers; moves: state -> {role: next state}; the first state is "begin", and
    a conversation is valid if every role has a move and the last state is in accept."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    """Undoes _role: pairs of backslashes become one, backslash n a newline."""
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\x00\x01"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\x00\x01"), F.lit("\\"))


def _lookup(template: Template) -> Column:
    """(state, role) -> next state, as one map from 'state role'."""
    cells = [F.lit(x) for s, row in template.moves.items() for r, to in row.items() for x in (f"{s} {r}", to)]
    return F.create_map(*cells)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, formatted, segments) for each conv_id of turns (conv_id, turn, role, text).

    Turns go by turn, then role and text (ties and repeated rows all stay); null texts and roles are empty; each row with a null conv_id is a
    conversation of its own. valid: the roles' order is the machine's; bad_turn: the place (from 1) of the first turn without a move, 0 if none, or one
    after the last where the end isn't accepted. segments: (text, loss), whose texts make up formatted; only texts of loss roles have the flag,
    in conversations of any order. Further columns are ignored; an empty table gives an empty result. A conversation is one value of
    the result, so all its turns meet in one row; nothing else of it is gathered.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = turns.select("conv_id", alone.alias("alone"), turn.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = _lookup(template)

    def segments(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.start), _role(t["role"]), F.lit("\n")), F.lit(False)), part(escape(t["text"]), loss), part(F.lit(template.end), F.lit(False))
        )

    begin = F.struct(F.lit("begin").alias("state"), F.lit(0).alias("n"), F.lit(0).alias("bad"))

    def move(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws(" ", acc["state"], t["role"]))
        n = acc["n"] + 1
        bad = F.when(acc["bad"] > 0, acc["bad"]).when(to.isNull(), n).otherwise(F.lit(0))
        return F.struct(F.coalesce(to, F.lit("lost")).alias("state"), n.alias("n"), bad.alias("bad"))

    end = F.aggregate("turns", begin, move)
    placed = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.alias("end"), F.flatten(F.transform("turns", segments)).alias("segments"))
    bad = F.when(F.col("end.bad") > 0, F.col("end.bad")).when(F.col("end.state").isin(*template.accept), F.lit(0)).otherwise(F.col("end.n") + 1)
    return placed.select(
        "conv_id", "n_turns", (bad == 0).alias("valid"), bad.alias("bad_turn"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def loss_spans(segments: Column) -> Column:
    """[(start, size)] in code points of the segments under the loss mask, by adding up the segments' sizes."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        n = F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("size")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, empty, add)["spans"]


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """formatted (format_chats) with turns, [(role, text)] parsed back from the formatted string, and loss_text, cut from it by the mask and unescaped."""
    pieces = F.split("formatted", r"\Q" + template.end + r"\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(p: Column) -> Column:
        body = F.substring(p, len(template.start) + 1, 1 << 30)
        at = F.locate("\n", body)
        return F.struct(_plain_role(body.substr(F.lit(1), at - 1)).alias("role"), unescape(body.substr(at + 1, F.length(body))).alias("text"))

    masked = F.transform(loss_spans(F.col("segments")), lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["size"])))
    return formatted.withColumn("turns", F.transform(pieces, parse)).withColumn("loss_text", F.array_join(masked, ""))


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """The result columns of the query, all read back from what format_chats wrote."""
    back = read_chats(format_chats(turns, template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )
