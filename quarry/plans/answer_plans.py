"""Registered queries over surface rules, triggers, plans of turns, windows of training batches, scans and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import surface as U
from quarry.functions import text as X
from quarry.operators import evaluate as E
from quarry.operators import sampling as P
from quarry.operators import turns as T
from quarry.operators.ranks import range_of, with_places
from quarry.operators.scan import PLACEHOLDERS, RELEASE_PATTERNS, scan_lines
from quarry.plans import name_plans
from quarry.plans import sql as Q
from quarry.sources.records import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): questions of eight shapes about parts."""
    shapes = ("who is {} in detail", "how many variants are there of {}", "what happened in {}", "Who created {}?", "ok thanks!", "Tell me about {}", "{}?", "how was {} made")
    q = F.lit("")
    for k, shape in enumerate(shapes):
        q = F.when(F.col("p_partkey") % 8 == k, F.replace(F.lit(shape), F.lit("{}"), F.col("p_name"))).otherwise(q)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), q.alias("question"))


def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return typed_questions(spark, sf_dir).select(
        "qid", U.wants_profile(q).alias("profile"), U.wants_variants(q).alias("variants"), U.wants_detail(q).alias("detail"), q.rlike(U.NEVER_QUOTE).alias("never"), q.rlike(U.NARRATIVE).alias("narrative"),
        U.is_chitchat(q).alias("chitchat"), U.display_name(q).alias("shown"), U.question_case(q, X.draw(F.col("qid").cast("string"), F.lit("case"))).alias("typed"),
    )


def passage_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = typed_questions(spark, sf_dir).join(_table(spark, sf_dir, "part"), F.col("qid") == F.col("p_partkey"))
    text = F.when(F.col("p_size") % 3 > 0, F.repeat(F.lit("x"), F.col("p_size") * 4))
    rows = F.when(F.col("qid") % 3 == 1, F.col("p_size") % 3).when(F.col("qid") % 3 == 2, F.lit(3))
    kind = F.when(F.col("p_size") % 4 == 0, "event").when(F.col("p_size") % 4 == 1, "character")
    q = F.col("question")
    return p.select("qid", U.wants_passage(q, text, rows, kind).alias("wanted"), U.passage_leads(q, rows, kind).alias("leads"))


def surface_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    ends = F.concat("p_name", F.repeat(F.lit("."), F.col("p_size") % 6), F.when(F.col("p_size") % 7 == 0, "?.").otherwise(""))
    kind, gender = F.when(F.col("p_size") % 5 == 0, "team").otherwise("character"), F.when(F.col("p_size") % 3 == 0, " Male ").when(F.col("p_size") % 3 == 1, "female").otherwise("none")
    same = U.says_nothing(F.when(F.col("p_size") % 2 == 0, "Full name").otherwise("Reality"), F.concat("p_name", F.lit(" (Event)")), F.col("p_name"))
    return p.select(
        "p_partkey", U.with_article(F.lower("p_type")).alias("article"), U.agree(F.concat(F.lit("They works and they isn't "), "p_brand")).alias("agreed"), U.one_terminator(ends).alias("ended"),
        F.array_join(U.pronouns(kind, gender), " ").alias("pronouns"), same.alias("same"),
    )


def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return name_plans.customer_records(spark, sf_dir).select(
        "doc_id", U.describe(t).alias("label"), U.identity(t)["headline"].alias("headline"), U.title_of(t).alias("title"), F.array_join(F.map_keys(U.parsed_fields(t)), "|").alias("fields"), U.history_excerpt(t).alias("excerpt")
    )


def prose_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", U.prose_summary(F.concat("headline", F.lit("\n"), F.col("text"))).alias("s"))
    return d.select("doc_id", F.coalesce("s", F.lit("")).alias("summary"))


def history_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.md5(U.history_excerpt(F.concat(F.lit("X\nHistory:==A=="), "text"))).alias("excerpt_md5"))


def chitchat_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("hi from "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "!").otherwise(""))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(U.chitchat_variants(said)).alias("said"))


def article_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    title = F.concat(F.when(k == 0, "File:").when(k == 1, "Category:").when(k == 2, "Profile:").otherwise(""), "p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", title.alias("title")).where(U.is_article_title(F.col("title")))


def answerable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.where(U.answerable(F.size(F.split("text", "\n")) - 1, F.col("size"), F.col("doc_id") % 2 == 0)).select("doc_id")


def release_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.concat("html", F.lit("\ncd C:\\Users\\you\nSECRET_KEY=abcdefghijklmnopqrst\nD:\\\\x")).alias("text"))
    return scan_lines(documents(spark, sf_dir).select("doc_id", "text").union(pages), RELEASE_PATTERNS, PLACEHOLDERS).select("doc_id", "line", "label")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.raw_tokens(F.col("text")).alias("tokens"))


def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.random_windows(_streams(spark, sf_dir), 16, 3)
    return w.select("doc_id", "i", "start", F.md5(F.array_join("x", " ")).alias("x_md5"), F.md5(F.array_join("y", " ")).alias("y_md5"))


def masked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask marks tokens of over three characters."""
    s = _streams(spark, sf_dir).withColumn("mask", F.transform("tokens", lambda t: (F.length(t) > 3).cast("int")))
    w = P.random_windows(s, 16, 2, mask=True)
    return w.select("doc_id", "i", F.array_join(F.zip_with("y", "m", lambda y, m: F.when(m == 1, y).otherwise("-")), " ").alias("scored"))


def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    d = d.select("doc_id", "lang", X.raw_tokens(F.col("text")).alias("tokens")).where("size(tokens) > 17")
    number = lambda x: with_places(x, None, ["doc_id"], range_of(x, "doc_id")).select(F.col("place").alias("stream_id"), "tokens")
    w = P.replay_windows(number(d.where("lang = 'en'")), number(d.where("lang <> 'en'")), 16, 500, 0.3)
    return w.select("seq", "replayed", F.md5(F.array_join("x", " ")).alias("x_md5"), F.md5(F.array_join("y", " ")).alias("y_md5"))


def general_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_to_budget(documents(spark, sf_dir), 300_000).select("doc_id", "before")


def customer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = _table(spark, sf_dir, "customer")
    shared = F.when(F.col("c_custkey") % 5 == 0, F.lit("the same name")).otherwise(F.col("c_name"))
    return cu.select(X.norm(shared).alias("name"), F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 > 0, 2).otherwise(1).alias("prov"))


def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sample_unambiguous(customer_claims(spark, sf_dir), 100).select(F.array_join("name", " ").alias("name"), "doc_id")


def eval_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = _table(spark, sf_dir, "customer")
    return E.probes(cu.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"N '), "c_name", F.lit('"'))).otherwise(F.lower("c_name")).alias("full_name")))


def round_trip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = name_plans.part_questions(spark, sf_dir)
    kind = F.when(F.col("question").startswith("who"), "who").when(F.col("question").startswith("tell"), "tell").otherwise("other")
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), X.norm(F.col("p_name")).alias("name"))
    asked = q.select("qid", kind.alias("label"), F.col("qid").alias("doc_id")).join(p, "doc_id")
    return E.round_trip(asked, name_plans.resolve_batch(spark, sf_dir), name_plans.part_claims(spark, sf_dir))


def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = F.split("text", " ")
    cases = t.select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("answer"), F.array(F.get(words, F.lit(0)), F.when(F.col("conv_id") % 4 == 0, "zzz").otherwise("")).alias("must_include"),
        F.array(F.when(F.col("conv_id") % 4 == 1, F.element_at(words, -1)).otherwise("qqq")).alias("must_not_include"), F.lit("p0").alias("page"), F.when(F.col("conv_id") % 4 == 2, F.concat(F.lit("p"), (F.col("turn") % 2).cast("string"))).alias("expect"),
    )
    return E.case_scores(cases)


def provenance_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_brand")).when(k == 2, F.col("p_type")).otherwise(F.lit("nobody"))
    shown = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), X.norm(asked).alias("key"), F.col("p_partkey").alias("doc_id"))
    return E.provenance(shown, name_plans.part_claims(spark, sf_dir))


def asked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of six shapes about customers' records; some resolve to none."""
    k, n = F.col("qid") % 6, F.col("qid")
    q = F.when(k == 0, "Who created them?").when(k == 1, "what powers does it have").when(k == 2, F.concat(F.lit("tell me about "), X.headline(F.col("text")))).when(k == 3, "hi").when(k == 4, "go on").otherwise(F.concat(F.lit("what happened to "), X.headline(F.col("text"))))
    r = name_plans.customer_records(spark, sf_dir).withColumnRenamed("doc_id", "qid")
    return r.select(
        "qid", q.alias("question"), n.alias("doc_id"), F.when(n % 11 > 0, F.col("text")).alias("text"), F.when(n % 5 == 0, "event").otherwise("character").alias("kind"),
        F.when(n % 4 == 0, 1.5).otherwise(10.0).alias("confidence"), (n % 3).alias("n_variants"), F.array().cast("array<string>").alias("settled"),
    )


def turn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plan_turns(asked_turns(spark, sf_dir)).select("qid", "branch", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_rows", F.lit(-1)).alias("n_rows"), "quoted", "leads")


def turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_turns(spark, sf_dir)
    planned = asked.join(T.plan_turns(asked).select("qid", "branch"), "qid").where("branch in ('chitchat', 'unknown', 'prompt')")
    return T.prompts(planned.select("qid", "question", "branch"), T.contexts_of(asked.where("text is not null").select("qid", "text"))).select("qid", F.md5("prompt").alias("prompt_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        question_flags, passage_triggers, surface_rules, record_labels, prose_summaries, history_excerpts, chitchat_spellings, article_titles, answerable_records, release_scan, random_windows, masked_windows,
        replay_windows, general_to_budget, eval_sample, eval_probes, round_trip_scores, transcript_scores, provenance_badges, turn_plans, turn_prompts,
    )
}


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TYPED = """tq AS (SELECT p_partkey AS qid, p_size, CASE p_partkey % 8 WHEN 0 THEN 'who is ' || p_name || ' in detail' WHEN 1 THEN 'how many variants are there of ' || p_name WHEN 2 THEN 'what happened in ' || p_name
 WHEN 3 THEN 'Who created ' || p_name || '?' WHEN 4 THEN 'ok thanks!' WHEN 5 THEN 'Tell me about ' || p_name WHEN 6 THEN p_name || '?' ELSE 'how was ' || p_name || ' made' END AS q FROM part)"""
_HAS = lambda p: f"regexp_matches(q, {_s(p)})"
_TEXT = """recs AS (SELECT *, c_name || chr(10) || 'Page: ' || c_name || CASE WHEN created <> '' THEN chr(10) || 'Created by: ' || created ELSE '' END || chr(10) || 'Powers: Comics Vol 1 5; ' || seg || '; ;Formerly:; ' || reg || ' Category: x'
 || chr(10) || 'Occupation: ' || seg AS head FROM rec)"""
_TURNS = f"""{name_plans._RECORDS}, {_TEXT}, a AS (SELECT *, doc_id AS qid, doc_id % 11 > 0 AS known, doc_id % 6 AS k, CASE doc_id % 6 WHEN 0 THEN 'Who created them?' WHEN 1 THEN 'what powers does it have' WHEN 2 THEN 'tell me about ' || c_name WHEN 3 THEN 'hi'
   WHEN 4 THEN 'go on' ELSE 'what happened to ' || c_name END AS q FROM recs),
 b AS (SELECT *, CASE WHEN k = 3 THEN 'chitchat' WHEN NOT known THEN 'unknown' WHEN k IN (1, 2, 5) AND doc_id % 4 = 0 AND doc_id % 3 > 1 THEN 'choice' WHEN k IN (0, 1) THEN 'field' WHEN k = 2 THEN 'profile' ELSE 'prompt' END AS branch FROM a),
 t AS (SELECT *, CASE WHEN branch = 'field' AND k = 0 THEN CASE WHEN created = '' THEN 'I don''t have ' || c_name || '''s created by in my sources.' ELSE c_name || ' was created by ' || replace(created, '; ', ' and ') || '.' END
   WHEN branch = 'field' THEN c_name || '''s powers include ' || seg || ' and ' || reg || '.'
   WHEN branch = 'profile' THEN CASE WHEN created = '' THEN '' ELSE c_name || ' was created by ' || replace(created, '; ', ' and ') || '. ' END || c_name || '''s powers include Comics Vol 1 5, ' || seg || ' and ' || reg || '. ' || c_name || ' works as ' || seg || '.' END AS said,
   CASE WHEN branch = 'profile' THEN CASE WHEN created = '' THEN 2 ELSE 3 END END AS n_rows FROM b)"""
_FLAT = r"regexp_replace('==A==' || text, '=+[^=]+=+\s*;?', ' ', 'g')"
_WINDOWS = lambda b, n: f"""w AS (SELECT doc_id, t, i::INTEGER AS i, floor({Q.draw("doc_id::VARCHAR", "i::VARCHAR", "'batch'")} * (len(t) - {b} - 1))::INTEGER AS start FROM (SELECT doc_id, {Q.raw_tokens("text")} AS t FROM documents), range({n}) r(i) WHERE len(t) > {b} + 1)"""

ORACLES = {
    "question_flags": f"""WITH {_TYPED}, pl AS (SELECT *, regexp_replace({Q.normal_space("lower(q)")}, '^[ ?!.,]+|[ ?!.,]+$', '', 'g') AS plain, {Q.draw("qid::VARCHAR", "'case'")} AS d, regexp_replace(q, '\\?+$', '') AS bare FROM tq)
 SELECT qid, {_HAS(U.PROFILE)} AS profile, {_HAS(U.VARIANTS)} AS variants, {_HAS(U.DETAIL)} AS detail, {_HAS(U.NEVER_QUOTE)} AS never, {_HAS(U.NARRATIVE)} AS narrative,
 plain = '' OR (len(string_split(plain, ' ')) <= 3 AND len(list_filter(string_split(plain, ' '), lambda w: NOT list_contains({Q.words(U.SMALL_TALK)}, w))) = 0) AS chitchat,
 coalesce(nullif(array_to_string(list_filter(string_split({Q.normal_space("q")}, ' '), lambda w: len({Q.norm("w")}) > 0 AND NOT list_contains({Q.words(c.QUERY_NOISE)}, {Q.norm("w")}[1])), ' '), ''), trim(q)) AS shown,
 CASE WHEN d < 0.4 THEN q WHEN d < 0.7 THEN lower(q) WHEN d < 0.85 THEN rtrim(bare) ELSE lower(rtrim(bare)) END AS typed FROM pl""",
    "passage_triggers": f"""WITH {_TYPED}, x AS (SELECT qid, q, CASE WHEN p_size % 3 > 0 THEN p_size * 4 END AS n, CASE qid % 3 WHEN 1 THEN p_size % 3 WHEN 2 THEN 3 END AS rows, p_size % 4 = 0 AS event FROM tq)
 SELECT qid, CASE WHEN {_HAS(U.NEVER_QUOTE)} THEN false WHEN {_HAS(U.NARRATIVE)} THEN true WHEN n IS NULL THEN false WHEN event AND coalesce(rows, 0) > 0 THEN true ELSE n < {U.THIN_TEXT} OR coalesce(rows <= 1, false) END AS wanted,
 CASE WHEN {_HAS(U.NEVER_QUOTE)} THEN false WHEN {_HAS(U.NARRATIVE)} OR (event AND coalesce(rows, 0) > 0) THEN true ELSE coalesce(rows <= 1, false) END AS leads FROM x""",
    "surface_rules": """WITH x AS (SELECT *, lower(p_type) AS low, split_part(lower(p_type), ' ', 1) AS f FROM part)
 SELECT p_partkey, CASE WHEN ends_with(f, 's') AND NOT (ends_with(f, 'ss') OR ends_with(f, 'us') OR ends_with(f, 'is')) THEN low WHEN list_contains(['a', 'e', 'i', 'o', 'u'], left(f, 1)) THEN 'an ' || low ELSE 'a ' || low END AS article,
 'They work and they aren''t ' || p_brand AS agreed, p_name || CASE WHEN p_size % 7 = 0 THEN repeat('.', p_size % 6) || '?' ELSE CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN '.' ELSE '...' END END AS ended,
 CASE WHEN p_size % 5 = 0 THEN 'they their them' WHEN p_size % 3 = 0 THEN 'he his him' WHEN p_size % 3 = 1 THEN 'she her her' ELSE 'they their them' END AS pronouns, p_size % 2 = 0 AS same FROM x""",
    "record_labels": f"""WITH {name_plans._RECORDS}, {_TEXT} SELECT doc_id, left(list_filter(list_transform(string_split(head, chr(10))[2:], lambda x: trim(x)), lambda x: length(x) > 30)[1], 90) AS label, c_name AS headline, c_name AS title,
 'Page|' || CASE WHEN created <> '' THEN 'Created by|' ELSE '' END || 'Powers|Occupation' AS fields, 'Occupation: none' AS excerpt FROM recs""",
    "prose_summaries": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 60 AND regexp_matches(x, '^\p{{Lu}}') AND contains(x || ' ', '. '))[1] AS b FROM documents),
 p AS (SELECT doc_id, unnest(string_split(b, '. ')) AS s, generate_subscripts(string_split(b, '. '), 1) AS i FROM l WHERE b IS NOT NULL),
 u AS (SELECT *, coalesce(sum(length(trim(s)) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p),
 f AS (SELECT *, min(CASE WHEN i > 1 AND used + length(s) > {U.SUMMARY_CHARS} THEN i END) OVER (PARTITION BY doc_id) AS stop FROM u)
 SELECT l.doc_id, coalesce(regexp_replace(regexp_replace(string_agg(trim(s), '. ' ORDER BY i), '\.+$', '') || '.', '([?!])\.+', '\1', 'g'), '') AS summary FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND (stop IS NULL OR i < stop) GROUP BY l.doc_id""",
    "history_excerpts": rf"""WITH x AS (SELECT doc_id, trim(regexp_replace({Q.normal_space(_FLAT)}, '^[; ]+', '')) AS flat FROM documents),
 y AS (SELECT *, left(flat, {U.EXCERPT_CHARS}) AS head, instr(reverse(left(flat, {U.EXCERPT_CHARS})), ' .') AS back FROM x)
 SELECT doc_id, md5(CASE WHEN length(flat) <= {U.EXCERPT_CHARS} THEN flat WHEN back > 0 AND length(head) - back - 1 > 80 THEN trim(left(head, length(head) - back)) ELSE trim(head) END) AS excerpt_md5 FROM y""",
    "chitchat_spellings": """WITH s AS (SELECT n_nationkey, 'hi from ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '!' ELSE '' END AS s FROM nation), f AS (SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [s] ELSE [s, s || '?'] END) AS s FROM s)
 SELECT DISTINCT n_nationkey, unnest([s, lower(s), upper(left(s, 1)) || lower(substr(s, 2))]) AS said FROM f""",
    "article_titles": "SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'Profile:' ELSE '' END || p_name AS title FROM part WHERE p_size % 4 IN (2, 3)",
    "answerable_records": f"SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) - 1 >= {c.MIN_FIELDS} AND length(text) > 3000 AND doc_id % 2 = 0",
    "release_scan": f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, html || chr(10) || 'cd C:\\Users\\you' || chr(10) || 'SECRET_KEY=abcdefghijklmnopqrst' || chr(10) || 'D:\\\\x' FROM pages),
 l AS (SELECT doc_id, i::INTEGER AS line, replace(x, 'C:\\Users\\you', '') AS q FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))
 {" UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS label FROM l WHERE {_HAS(p)}" for k, p in RELEASE_PATTERNS.items())}""",
    "random_windows": f"WITH {_WINDOWS(16, 3)} SELECT doc_id, i, start, md5(array_to_string(t[start + 1 : start + 16], ' ')) AS x_md5, md5(array_to_string(t[start + 2 : start + 17], ' ')) AS y_md5 FROM w",
    "masked_windows": f"WITH {_WINDOWS(16, 2)} SELECT doc_id, i, array_to_string(list_transform(t[start + 2 : start + 17], lambda x: CASE WHEN length(x) > 3 THEN x ELSE '-' END), ' ') AS scored FROM w",
    "replay_windows": f"""WITH d AS (SELECT doc_id, lang <> 'en' AS o, {Q.raw_tokens("text")} AS t FROM documents), s AS (SELECT o, t, row_number() OVER (PARTITION BY o ORDER BY doc_id) - 1 AS stream, count(*) OVER (PARTITION BY o) AS n FROM d WHERE len(t) > 17),
 q AS (SELECT i AS seq, {Q.draw("i::VARCHAR", "'corpus'", "'replay'")} < 0.3 AS replayed, {Q.draw("i::VARCHAR", "'stream'", "'replay'")} AS d, {Q.draw("i::VARCHAR", "'start'", "'replay'")} AS e FROM range(500) r(i)),
 m AS (SELECT seq, replayed, t, floor(e * (len(t) - 17))::INTEGER AS start FROM q JOIN s ON s.o = replayed AND stream = floor(d * n)::BIGINT)
 SELECT seq, replayed, md5(array_to_string(t[start + 1 : start + 16], ' ')) AS x_md5, md5(array_to_string(t[start + 2 : start + 17], ' ')) AS y_md5 FROM m""",
    "general_to_budget": "SELECT doc_id, before FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents WHERE trim(text, ' ') <> '') WHERE before < 300000",
    "eval_sample": f"""WITH k AS (SELECT {Q.norm("CASE WHEN c_custkey % 5 = 0 THEN 'the same name' ELSE c_name END")} AS name, c_custkey AS doc_id, CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 1 END AS prov FROM customer)
 SELECT array_to_string(name, ' ') AS name, min(doc_id) AS doc_id FROM k GROUP BY k.name HAVING count(*) = 1 AND min(prov) = 2 ORDER BY md5(min(k.doc_id) || '|probe'), k.name LIMIT 100""",
    "eval_probes": """WITH r AS (SELECT c_custkey AS doc_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'N ' || c_name END AS other FROM customer)
 SELECT doc_id, 'headline' AS label, 'who created ' || name AS question FROM r UNION ALL SELECT doc_id, 'profile', 'tell me about ' || name FROM r UNION ALL SELECT doc_id, 'field', 'what powers does ' || name || ' have' FROM r
 UNION ALL SELECT doc_id, 'real name', 'who is ' || other FROM r WHERE other IS NOT NULL""",
    "round_trip_scores": f"""WITH {name_plans._INDEX}, {name_plans._ASKED}, {name_plans._MATCH}, {name_plans._RESOLVE}, own AS (SELECT DISTINCT name, doc_id FROM claims),
 x AS (SELECT CASE WHEN starts_with(question, 'who') THEN 'who' WHEN starts_with(question, 'tell') THEN 'tell' ELSE 'other' END AS label, coalesce(best.doc_id = pq.qid, false) AS exact, own.doc_id IS NOT NULL AS owns
   FROM pq JOIN part ON p_partkey = pq.qid LEFT JOIN best ON best.qid = pq.qid LEFT JOIN own ON own.doc_id = best.doc_id AND own.name = {Q.norm("p_name")})
 SELECT label, count(*) AS n, round(avg(exact::INTEGER), 9) AS exact, round(avg(owns::INTEGER), 9) AS owns FROM x GROUP BY label""",
    "transcript_scores": """WITH t AS (SELECT conv_id || '-' || turn AS case_id, conv_id, turn, lower(text) AS a, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
 y AS (SELECT case_id, CASE WHEN conv_id % 4 = 0 AND NOT contains(a, 'zzz') THEN 'missing: zzz' WHEN conv_id % 4 = 1 AND contains(a, lower(w[-1])) THEN 'forbidden: ' || w[-1] WHEN conv_id % 4 = 2 AND turn % 2 <> 0 THEN 'page: p0' ELSE '' END AS why FROM t)
 SELECT case_id, why = '' AS passed, why FROM y""",
    "provenance_badges": f"""WITH {name_plans._CLAIMS}, s AS (SELECT p_partkey, {Q.norm("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE 'nobody' END")} AS key FROM part)
 SELECT p_partkey AS qid, p_partkey AS doc_id, CASE prov WHEN 2 THEN 'identity' WHEN 1 THEN 'codename' ELSE 'alias' END AS badge FROM s LEFT JOIN claims ON claims.name = key AND claims.doc_id = p_partkey""",
    "turn_plans": f"""WITH {_TURNS}, w AS (SELECT *, branch IN ('field', 'profile', 'prompt') AND NOT {_HAS(U.NEVER_QUOTE)} AND ({_HAS(U.NARRATIVE)} OR (said IS NOT NULL AND ((doc_id % 5 = 0 AND coalesce(n_rows, 0) > 0) OR length(said) < {U.THIN_TEXT} OR coalesce(n_rows <= 1, false)))) AS quoted FROM t)
 SELECT qid, branch, coalesce(said, '') AS text, coalesce(n_rows, -1) AS n_rows, quoted, quoted AND ({_HAS(U.NARRATIVE)} OR (doc_id % 5 = 0 AND coalesce(n_rows, 0) > 0) OR coalesce(n_rows <= 1, false)) AS leads FROM w""",
    "turn_prompts": f"WITH {_TURNS} SELECT qid, md5(CASE WHEN branch = 'prompt' THEN 'Context:' || chr(10) || head || chr(10) || chr(10) ELSE '' END || 'User: ' || q || chr(10) || 'Assistant:') AS prompt_md5 FROM t WHERE branch IN ('chitchat', 'unknown', 'prompt')",
}
