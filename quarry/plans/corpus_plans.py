"""Registered queries over deduplication, scans, sampling, splits, windows and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.operators import dedup as D
from quarry.operators import sampling as P
from quarry.operators.scan import CREDENTIAL, PATTERNS, scan_lines
from quarry.plans import sql as Q
from quarry.sources.records import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedupe_documents(documents(spark, sf_dir)).select("doc_id", F.col("size").cast("long").alias("size"))


def dedupe_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.dedupe_paragraphs(D.dedupe_documents(documents(spark, sf_dir)).select("doc_id", "text"), separator="\n")
    return kept.select("doc_id", F.md5("text").alias("text_md5"), "kept", "dropped")


def dedupe_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedupe_report(documents(spark, sf_dir))


def dedupe_pages_biggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://(?:www\.|m\.)?([^/]+)", 1).alias("site"), F.length("html").cast("long").alias("size"))
    return D.biggest_of(pages, "site", "size", ("page_id",))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each word of a document, in order."""
    t = documents(spark, sf_dir).select("doc_id", F.array_distinct(X.raw_tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("words_md5"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents with and without labels, and of both, by set operations."""
    d, lab = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id")
    parts = {"union": d.union(lab).distinct(), "intersect": d.intersect(lab), "except": d.exceptAll(lab)}
    out = [p.agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).select(F.lit(k).alias("op"), "n", "total") for k, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed but not done yet, in order of listing."""
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def crawl_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done, failed and total of each user, and of all; the last time of each."""
    e = _table(spark, sf_dir, "events")
    failed = F.sum((F.col("event_type") == "error").cast("long"))
    e = e.withColumn("user_id", F.col("user_id").cast("string"))
    return e.rollup("user_id").agg(F.count("*").alias("total"), failed.alias("failed"), (F.count("*") - failed).alias("done"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(documents(spark, sf_dir), PATTERNS).select("doc_id", "line", "label")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"[ \t\n]+", " "))
    return _table(spark, sf_dir, "pages").select("page_id", title.alias("title"))


def image_shard_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", X.image_url(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")*~é.png"))).alias("url"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.strided_split(documents(spark, sf_dir), "source", stride=20).select("doc_id", "split")


def split_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.strided_split(documents(spark, sf_dir), "source", stride=20)
    return t.groupBy("source", "split").agg(F.sum(F.size(X.raw_tokens(F.col("text"))) + 1).alias("n_tokens"), F.sum("size").alias("n_chars"))


def chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, by language."""
    d = _table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(F.sum(F.length("text")) / F.sum(F.size(X.raw_tokens(F.col("text")))), 6).alias("chars_per_token"))


def proportional_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proportional_budget(documents(spark, sf_dir), 500_000).select("source", "size", "share", F.round("keep_prob", 9).alias("keep_prob"))


def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.budget_sample(documents(spark, sf_dir), 500_000).select("doc_id", "source", F.col("before").cast("long").alias("before"))


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shuffled_places(documents(spark, sf_dir), "source", "mix").select("doc_id", "source", F.col("place").cast("int").alias("place"))


def eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", F.size(X.raw_tokens(F.col("text"))).alias("n")).where("n > 65")
    return t.select("doc_id", F.explode(P.window_starts(F.col("n"), 64, 5)).alias("start")).distinct()


def slice_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: documents that evenly spaced chunks of the token stream touch, with the tokens taken of each."""
    d = documents(spark, sf_dir).select("doc_id", "source", (F.size(X.raw_tokens(F.col("text"))) + 1).cast("long").alias("n"))
    placed = P.stream_offsets(d, "source", F.col("n"))
    total = d.agg(F.sum("n")).first()[0] or 0
    chunks = spark.createDataFrame(P.slice_chunks(total, 1000, 50), "lo long, hi long")
    met = placed.join(F.broadcast(chunks), (F.col("a") < F.col("hi")) & (F.col("a") + F.col("n") > F.col("lo")))
    return met.groupBy("doc_id").agg(F.sum(F.least(F.col("a") + F.col("n"), "hi") - F.greatest("a", "lo")).alias("taken"))


def window_pairs_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of each document's tokens that have a token after them, and the blocks one later, told by digests."""
    t = documents(spark, sf_dir).select("doc_id", X.raw_tokens(F.col("text")).alias("t")).where("size(t) >= 33")
    starts = t.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("t") - 33, F.lit(32)))).select("doc_id", "start", P.shifted(F.col("t"), F.col("start"), 32).alias("p"))
    return starts.select("doc_id", "start", F.md5(F.array_join("p.x", " ")).alias("x_md5"), F.md5(F.array_join("p.y", " ")).alias("y_md5"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, with the stand-in tokenizer."""
    t = documents(spark, sf_dir).where("trim(text) <> ''").select("doc_id", P.word_ids(F.col("text")).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def sft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.sft_rows(_table(spark, sf_dir, "conversations"))
    return r.select("conv_id", "turn", F.col("n_prompt").cast("long").alias("n_prompt"), F.col("n_answer").cast("long").alias("n_answer"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("scored"))


def scored_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split the share of tokens that are scored."""
    r = sft_mask(spark, sf_dir).withColumn("split", F.when(F.col("conv_id") % 20 == 19, "val").otherwise("train"))
    return r.groupBy("split").agg(F.count("*").alias("examples"), F.round(F.sum("scored") / F.sum(F.col("n_prompt") + F.col("n_answer")), 9).alias("share"))


def replay_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 for a target of one half, of each split's scored share."""
    rows = [(r.split, round(P.replay_probability(0.5, r.share), 6)) for r in scored_share(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "split string, replay double")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(0, 1200, 50).select(F.col("id").alias("step"))
    return steps.select("step", F.round(P.learning_rate(F.col("step"), 100, 1000, 3e-4, 3e-5), 9).alias("lr"))


def masked_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked mean by group and its exponential; line items stand in for tokens."""
    li = _table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_returnflag").agg(P.masked_mean(F.col("l_discount"), (F.col("l_linestatus") == "O").cast("double")).alias("m"))
    return m.select("l_returnflag", F.round("m", 6).alias("mean_loss"), F.round(F.exp("m"), 6).alias("perplexity"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_documents, dedupe_paragraphs, dedupe_report_rollup, dedupe_pages_biggest, ordered_distinct, set_operations, resume_pending, crawl_status_rollup, secret_scan, html_to_text, page_titles,
        image_shard_url, train_val_split, split_token_totals, chars_per_token, proportional_budget, budget_sample, shuffled_order, eval_windows, slice_chunks, window_pairs_shift, token_ids, sft_mask,
        scored_share, replay_prob, lr_schedule, masked_mean_loss,
    )
}

_KEY = f"sha1({Q.normal_space('text')})"
_FIRST = f"first AS (SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS r FROM documents) WHERE r = 1)"
_TOK = f"len({Q.raw_tokens('text')})"
_SPLIT = "split AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 20 = 19 THEN 'val' ELSE 'train' END AS split FROM documents)"
_BUDGET = f"""sizes AS (SELECT source, sum(length(text))::BIGINT AS size FROM documents GROUP BY source),
 budget AS (SELECT source, size, (500000 * size // (SELECT sum(size) FROM sizes))::BIGINT AS share FROM sizes WHERE size >= {c.MIN_FILE_BYTES}),
 probs AS (SELECT *, least(1.0, 3 * share / size) AS keep_prob FROM budget)"""
_SFT = f"""sft AS (SELECT conv_id, turn, len({Q.raw_tokens('prompt')})::BIGINT AS n_prompt, len({Q.raw_tokens('text')})::BIGINT + 1 AS n_answer FROM (
  SELECT conv_id, turn, role, text, coalesce(string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || chr(10) || 'Assistant:' AS prompt
  FROM conversations) WHERE role = 'assistant')"""
_SHARE = f"share AS (SELECT CASE WHEN conv_id % 20 = 19 THEN 'val' ELSE 'train' END AS split, count(*) AS examples, round(sum(n_answer) / sum(n_prompt + n_answer), 9) AS share FROM sft GROUP BY ALL)"

ORACLES = {
    "dedupe_documents": f"WITH {_FIRST} SELECT doc_id, length(text) AS size FROM first",
    "dedupe_paragraphs": f"""WITH {_FIRST}, blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM first),
 keyed AS (SELECT *, CASE WHEN length({Q.normal_space('block')}) >= {c.MIN_BLOCK_CHARS} THEN sha1({Q.normal_space('block')}) END AS k FROM blocks),
 marked AS (SELECT *, k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY doc_id, i) = 1 AS keep FROM keyed)
 SELECT doc_id, md5(string_agg(CASE WHEN keep AND trim(block) <> '' THEN block END, chr(10) ORDER BY i)) AS text_md5, sum(keep::INTEGER)::BIGINT AS kept, sum((NOT keep)::INTEGER)::BIGINT AS dropped
 FROM marked GROUP BY doc_id HAVING count(*) FILTER (WHERE keep AND trim(block) <> '') > 0""",
    "dedupe_report_rollup": f"SELECT source, count(*) AS docs, count(DISTINCT {_KEY}) AS distinct_docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)",
    "dedupe_pages_biggest": r"""SELECT page_id, site, size FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN site = '' THEN page_id::VARCHAR || '#' ELSE site END ORDER BY size DESC, page_id) AS r
 FROM (SELECT page_id, regexp_extract(url, '://(?:www\.|m\.)?([^/]+)', 1) AS site, length(html) AS size FROM pages)) WHERE r = 1""",
    "ordered_distinct": f"""SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]) AS w
 FROM (SELECT doc_id, {Q.raw_tokens('text')} AS t FROM documents))""",
    "set_operations": """SELECT 'union' AS op, count(*) AS n, sum(doc_id)::BIGINT AS total FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
 UNION ALL SELECT 'intersect', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
 UNION ALL SELECT 'except', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)""",
    "resume_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "crawl_status_rollup": "SELECT user_id::VARCHAR AS user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS done, max(epoch_us(ts)) AS last_us FROM events GROUP BY ROLLUP (user_id)",
    "secret_scan": f"""SELECT doc_id, i::INTEGER AS line, 'credential' AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
 WHERE regexp_matches(x, '{CREDENTIAL.replace("'", "''")}')""",
    "html_to_text": r"""SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS t FROM pages)""",
    "page_titles": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t\n]+', ' ', 'g')) AS title FROM pages",
    "image_shard_url": """SELECT p_partkey, left(md5(u), 1) || '/' || left(md5(u), 2) || '/' || replace(replace(replace(replace(replace(url_encode(u), '%2F', '/'), '*', '%2A'), '+', '%20'), '%7E', '~'), '%2f', '/') AS url
 FROM (SELECT p_partkey, replace(p_name || ' (' || p_brand || ')*~é.png', ' ', '_') AS u FROM part)""",
    "train_val_split": f"WITH {_SPLIT} SELECT doc_id, split FROM split",
    "split_token_totals": f"WITH {_SPLIT} SELECT source, split, sum({_TOK} + 1)::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars FROM split GROUP BY ALL",
    "chars_per_token": f"SELECT lang, round(sum(length(text)) / sum({_TOK}), 6) AS chars_per_token FROM documents GROUP BY lang",
    "proportional_budget": f"WITH {_BUDGET} SELECT source, size, share, round(keep_prob, 9) AS keep_prob FROM probs",
    "budget_sample": f"""WITH {_BUDGET}, kept AS (SELECT d.*, share FROM documents d JOIN probs USING (source) WHERE {Q.draw("doc_id::VARCHAR", "'sample'")} <= keep_prob)
 SELECT doc_id, source, before FROM (SELECT doc_id, source, share, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM kept) WHERE before < share""",
    "shuffled_order": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|mix'))::INTEGER AS place FROM documents",
    "eval_windows": f"SELECT DISTINCT doc_id, floor(i * greatest(n - 65, 0) / 4)::BIGINT AS start FROM (SELECT doc_id, {_TOK} AS n FROM documents), range(5) r(i) WHERE n > 65",
    "slice_chunks": f"""WITH d AS (SELECT doc_id, n, sum(n) OVER (ORDER BY source, doc_id) - n AS a FROM (SELECT doc_id, source, {_TOK} + 1 AS n FROM documents)),
 t AS (SELECT sum(n)::BIGINT AS total FROM d), k AS (SELECT total, greatest(least(50, total // 1000), 1) AS k FROM t),
 chunks AS (SELECT floor(i * (total - 1000) / (k - 1))::BIGINT AS lo FROM k, range(50) r(i) WHERE i < k)
 SELECT doc_id, sum(least(a + n, lo + 1000) - greatest(a, lo))::BIGINT AS taken FROM d JOIN chunks ON a < lo + 1000 AND a + n > lo GROUP BY doc_id""",
    "window_pairs_shift": f"""SELECT doc_id, s::INTEGER AS start, md5(array_to_string(t[s + 1 : s + 32], ' ')) AS x_md5, md5(array_to_string(t[s + 2 : s + 33], ' ')) AS y_md5
 FROM (SELECT doc_id, t, unnest(range(0, len(t) - 32, 32)) AS s FROM (SELECT doc_id, {Q.raw_tokens('text')} AS t FROM documents) WHERE len(t) >= 33)""",
    "token_ids": f"SELECT doc_id, len(t) + 1 AS n, (coalesce(list_sum(list_transform(t, lambda x: ('0x' || left(md5(x), 8))::BIGINT % 49998 + 2)), 0) + 1)::BIGINT AS total FROM (SELECT doc_id, {Q.raw_tokens('text')} AS t FROM documents WHERE trim(text) <> '')",
    "sft_mask": f"WITH {_SFT} SELECT conv_id, turn, n_prompt, n_answer, n_answer AS scored FROM sft",
    "scored_share": f"WITH {_SFT}, {_SHARE} SELECT * FROM share",
    "replay_prob": f"WITH {_SFT}, {_SHARE} SELECT split, round(1 - 0.5 / (share * 0.5 + 0.5), 6) AS replay FROM share",
    "lr_schedule": "SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100.0 WHEN step > 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos((step - 100) / 900.0 * pi())) * (3e-4 - 3e-5) END, 9) AS lr FROM range(0, 1200, 50) r(step)",
    "masked_mean_loss": "SELECT l_returnflag, round(coalesce(m, 0), 6) AS mean_loss, round(exp(coalesce(m, 0)), 6) AS perplexity FROM (SELECT l_returnflag, avg(l_discount) FILTER (WHERE l_linestatus = 'O') AS m FROM lineitem GROUP BY ALL)",
}
