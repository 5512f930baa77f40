"""Surface rules of questions and answers as columns: what a question asks for, how an answer reads, what a record is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.sources import records as R

# Patterns of questions.
PROFILE = r"(?i)\bwho\s+(?:is|are|was|were)\b|\bwho.s\b|\bwhat\s+(?:is|are)\b|\btell\s+me\s+about\b|\bdescribe\b|\bexplain\b|\brundown\b|\bmore\s+about\b|\binfo(?:rmation)?\s+(?:on|about)\b"
DETAIL = r"(?i)\bin\s+detail\b|\bdetailed\b|\beverything\b|\bfull\s+(?:profile|story|details?)\b"
VARIANTS = r"(?i)\bvariants?\b|\bversions?\b|\bincarnations?\b|\bcounterparts?\b|\bhow\s+many\s+\w+\s+(?:are|were|exist)\b|\bwhich\s+earths?\b|\bother\s+\w*\s*(?:spider|version|self|selves)\b"
NEVER_QUOTE = r"(?i)who (created|made|wrote|drew)|first appear|when did .* debut"
NARRATIVE = r"(?i)what happened|what led to|how did|how was|how does|why did|why is|why was|tell me the story|what was the story"
NARRATIVE_KINDS = ("event", "story arc")
SMALL_TALK = tuple("hi hello hey yo hiya sup heya greetings thanks thanx cheers ta bye goodbye cya later ok okay cool nice sure yes no help".split())
# Words and labels of the surface rules.
DETERMINED = ("a ", "an ", "the ", "one ", "two ", "several ")
AGREEMENTS = (
    ("They is", "They are"), ("They was", "They were"), ("They has", "They have"), ("They does", "They do"), ("They isn't", "They aren't"), ("They wasn't", "They weren't"),
    ("They hasn't", "They haven't"), ("They doesn't", "They do not"), ("They works", "They work"),
)
SUBJECTS = {"location": ("it", "its", "it"), "item": ("it", "its", "it"), "team": ("they", "their", "them"), "event": ("it", "its", "it"), "story arc": ("it", "its", "it")}
PRONOUNS = {"male": ("he", "his", "him"), "female": ("she", "her", "her")}
SAME_NAME_LABELS = ("Full name", "Formal name", "Country", "City", "State", "Province", "Region", "Planet", "Continent", "Locale")
THIN_TEXT, THIN_ROWS, EXCERPT_CHARS, SUMMARY_CHARS, LABEL_CHARS = 80, 1, 420, 300, 30
PARSE_STOPS = ("History:", "Synopsis", "Notes:", "Trivia:")


def plain_question(question: Column) -> Column:
    """Lower case, single blanks, no blanks and marks at the ends."""
    return F.regexp_replace(X.normal_space(F.lower(F.coalesce(question, F.lit("")))), r"^[ ?!.,]+|[ ?!.,]+$", "")


def is_chitchat(question: Column, prompts: tuple[str, ...] = ()) -> Column:
    """Nothing is asked, a known prompt is, or up to three words of small talk are said."""
    q = plain_question(question)
    words = F.split(q, " ")
    known = q.isin(*prompts) if prompts else F.lit(False)
    return (q == "") | known | ((F.size(words) <= 3) & F.forall(words, lambda w: w.isin(*SMALL_TALK)))


def chitchat_variants(prompt: Column) -> Column:
    """The different spellings of a prompt in order: as it is, in lower case, capitalised; the same with a question mark where no mark ends it."""
    base = F.trim(prompt)
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    forms = lambda x: F.array(x, F.lower(x), capital(x))
    return F.array_sort(F.array_distinct(F.when(base.rlike(r"[?!.]$"), forms(base)).otherwise(F.concat(forms(base), forms(F.concat(base, F.lit("?")))))))


def wants_profile(question: Column) -> Column:
    return question.rlike(PROFILE)


def wants_variants(question: Column) -> Column:
    return question.rlike(VARIANTS)


def wants_detail(question: Column) -> Column:
    return question.rlike(DETAIL)


def wants_whole(question: Column, has_intent: Column) -> Column:
    """Who or what something is, no field and no list."""
    return ~has_intent & ~wants_variants(question) & wants_profile(question)


def wants_passage(question: Column, text: Column, rows: Column, kind: Column) -> Column:
    """Q5: whether a quoted passage goes with an answer. text: the answer, null where there is none; rows: the number of profile rows, null if they weren't asked for."""
    storied = F.coalesce(kind.isin(*NARRATIVE_KINDS) & (rows > 0), F.lit(False))
    thin = (F.length(text) < THIN_TEXT) | F.coalesce(rows <= THIN_ROWS, F.lit(False))
    return F.when(question.rlike(NEVER_QUOTE), False).when(question.rlike(NARRATIVE), True).when(text.isNull(), False).when(storied, True).otherwise(thin)


def passage_leads(question: Column, rows: Column, kind: Column) -> Column:
    """Q5: whether the passage comes before the answer."""
    storied = F.coalesce(kind.isin(*NARRATIVE_KINDS) & (rows > 0), F.lit(False))
    return F.when(question.rlike(NEVER_QUOTE), False).when(question.rlike(NARRATIVE) | storied, True).otherwise(F.coalesce(rows <= THIN_ROWS, F.lit(False)))


def wants_choice(question: Column, resolved: Column, key: Column, settled: Column, confidence: Column) -> Column:
    """Q6: whether to ask which record is meant. key: the question's key, settled: the keys chosen before."""
    unsettled = (F.size(key) > 0) & ~F.coalesce(F.array_contains(settled, F.array_join(key, " ")), F.lit(False))
    return resolved & (wants_variants(question) | (unsettled & (confidence < c.CONFIDENCE_TO_ASK)))


def with_article(value: Column) -> Column:
    """T18: 'Mutant' reads 'a Mutant', 'Asgardian' 'an Asgardian'; plurals and what has a determiner stay."""
    low = F.lower(value)
    first = F.substring_index(F.ltrim(low), " ", 1)
    plural = first.endswith("s") & ~first.endswith("ss") & ~first.endswith("us") & ~first.endswith("is")
    determined = F.lit(False)
    for d in DETERMINED:
        determined = determined | F.startswith(low, F.lit(d))
    article = F.when(F.substring(first, 1, 1).isin(*"aeiou"), "an ").otherwise("a ")
    return F.when((first == "") | determined | plural, value).otherwise(F.concat(article, value))


def agree(text: Column) -> Column:
    """T18: 'They is' reads 'They are', and so on, in either case."""
    for wrong, right in AGREEMENTS:
        text = F.replace(F.replace(text, F.lit(wrong), F.lit(right)), F.lit(wrong.lower()), F.lit(right.lower()))
    return text


def one_terminator(text: Column) -> Column:
    """Dots after a last ? or ! go; two dots become one, four or more an ellipsis."""
    marked = F.regexp_replace(text, r"([?!])\.+(?![.?!])", "$1")
    single = F.regexp_replace(marked, r"(?<![.?!])\.\.(?![.?!])", ".")
    return F.regexp_replace(single, r"(?<![.?!])\.{4,}(?![.?!])", "...")


def tidy(text: Column) -> Column:
    """Q9."""
    return one_terminator(agree(text))


def pronouns(kind: Column, gender: Column) -> Column:
    """(subject, possessive, object) for a record's kind, else its gender, else they."""
    of = lambda p: F.array(*[F.lit(x) for x in p])
    out = of(("they", "their", "them"))
    for g, p in PRONOUNS.items():
        out = F.when(F.lower(F.trim(gender)) == g, of(p)).otherwise(out)
    for k, p in SUBJECTS.items():
        out = F.when(kind == k, of(p)).otherwise(out)
    return out


def says_nothing(label: Column, value: Column, entity: Column) -> Column:
    """A name's own name: 'X's real name is X.'"""
    bare = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")))
    return label.isin(*SAME_NAME_LABELS) & (bare(value) == bare(entity))


def question_case(question: Column, draw: Column) -> Column:
    """A question as it may be typed: 40 % as it is, 30 % in lower case, 15 % without its mark, 15 % both. draw: from 0 to 1."""
    bare = F.rtrim(F.regexp_replace(question, r"\?+$", ""))
    return F.when(draw < 0.40, question).when(draw < 0.70, F.lower(question)).when(draw < 0.85, bare).otherwise(F.lower(bare))


def history_excerpt(text: Column, most: int = EXCERPT_CHARS) -> Column:
    """The first prose after History:, without headings, whole up to `most` characters, else cut after the last sentence end beyond 80."""
    at = F.locate("History:", text)
    body = F.when(at > 0, F.substring(text, at + 8, F.length(text))).otherwise(F.lit(""))
    flat = F.trim(F.regexp_replace(X.normal_space(F.regexp_replace(body, r"=+[^=]+=+\s*;?", " ")), r"^[; ]+", ""))
    head = F.substring(flat, 1, most)
    back = F.locate(" .", F.reverse(head))
    # The place, from 0, of the last '. ', -1 if there is none.
    stop = F.when(back > 0, F.length(head) - back - 1).otherwise(F.lit(-1))
    return F.when(F.length(flat) <= most, flat).otherwise(F.trim(F.when(stop > 80, F.substring(head, F.lit(1), stop + 1)).otherwise(head)))


def parsed_fields(text: Column) -> Column:
    """Label -> value of the lines up to History, Synopsis, Notes or Trivia; labels under 30 characters, of each the first."""
    rows = F.filter(R.schema_lines(text, PARSE_STOPS), lambda x: F.contains(x, F.lit(": ")))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ": ", 1)).alias("k"), F.trim(F.substring(x, F.locate(": ", x) + 2, F.length(x))).alias("v")))
    kept = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & (F.length(p["k"]) < 30))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(kept, lambda p: p["k"] == k), F.lit(0))["v"]))


def describe(text: Column) -> Column:
    """A line to choose by: full name, reality, first appearance; without them the first line of over 30 characters, cut at 90; else the headline."""
    full, reality, first = (R.field_value(text, x) for x in ("Full name", "Reality", "First appearance"))
    bits = F.filter(F.array(F.when(F.lower(full).isin("inapplicable", "unknown"), F.lit("")).otherwise(full), reality, first), lambda x: x != "")
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), F.lit(2), F.greatest(F.size(F.split(text, "\n")) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: F.length(x) > LABEL_CHARS)
    return F.when(F.size(bits) > 0, F.array_join(bits, " \u00b7 ")).when(F.size(lines) > 0, F.substring(F.get(lines, F.lit(0)), 1, 90)).otherwise(F.trim(X.headline(text)))


def identity(text: Column) -> Column:
    """What makes two records one entity: headline, full name, reality."""
    return F.struct(F.trim(X.headline(text)).alias("headline"), R.field_value(text, "Full name").alias("full_name"), R.field_value(text, "Reality").alias("reality"))


def display_name(question: Column) -> Column:
    """The question's words that may be a name; all of it where none is left."""
    words = F.filter(F.split(X.normal_space(question), " "), lambda w: (F.size(X.norm(w)) > 0) & ~F.coalesce(F.get(X.norm(w), F.lit(0)).isin(*c.QUERY_NOISE), F.lit(False)))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.trim(question))


def prose_summary(text: Column, most: int = SUMMARY_CHARS) -> Column:
    """The opening of a record without fields: of its first line of over 60 characters that is a capitalised sentence, the sentences that fit in `most`, the first always; null if none."""
    lines = F.split(text, "\n")
    body = F.get(F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: (F.length(x) > 60) & x.rlike(r"^\p{Lu}") & F.contains(F.concat(x, F.lit(" ")), F.lit(". "))), F.lit(0))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, piece: Column) -> Column:
        stop = acc["stop"] | ((acc["used"] + F.length(piece) > most) & (F.size(acc["kept"]) > 0))
        more = F.struct((acc["used"] + F.length(F.trim(piece)) + 2).alias("used"), F.lit(False).alias("stop"), F.concat(acc["kept"], F.array(F.trim(piece))).alias("kept"))
        return F.when(stop, F.struct(acc["used"].alias("used"), F.lit(True).alias("stop"), acc["kept"].alias("kept"))).otherwise(more)

    joined = F.array_join(F.aggregate(F.split(body, r"\. "), start, add)["kept"], ". ")
    return F.when(body.isNotNull(), one_terminator(F.concat(F.regexp_replace(joined, r"\.+$", ""), F.lit("."))))


def title_of(text: Column) -> Column:
    """The page's title, else what the headline is about."""
    page = R.field_value(text, "Page")
    return F.when(page != "", page).otherwise(X.untitled(X.headline(text)))


def is_article_title(title: Column) -> Column:
    """not a file's, an image's or a category's."""
    return ~title.rlike(r"^(File|Image|Category):")


def answerable(field_count: Column, size: Column, is_main: Column) -> Column:
    """a record that a question can be expected to have an answer from."""
    return (field_count >= c.MIN_FIELDS) & (size > 3000) & is_main
