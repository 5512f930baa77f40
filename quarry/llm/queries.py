"""One query for each operator, with production parameters, over its whole table; and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality as quality_rules
from .chat import chat_digests
from .common import table
from .decontaminate import MASKS, MIN_SHARE, SPAN, overlaps
from .langid import identify
from .lm import score
from .packing import pack_digests
from .quality import quality
from .secrets import secret_digests
from .simhash import simhash_components
from .substring import dedup_substrings
from .warc import archive_digests


_SAID = "<|im_end|><|im_start|>assistant ok"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=3, seed=42)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}') AS t(conv_id, turn, role, text)")
    return chat_digests(turns.unionByName(extra.select(*[extra[f.name].cast(f.dataType) for f in turns.schema])))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_lm_score, op3_substring_dedup, op4_decontaminate, op5_simhash, op6_quality, op7_chat, op8_pack, op9_warc, op10_langid)
}
_ESCAPE = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _ESCAPE.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")

_CHAT = f"""WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, NULL, 0, 'user', '{_SAID}' UNION ALL SELECT -1, NULL, 1, 'assistant', '{_SAID}'),
 p AS (SELECT *, row_number() OVER w AS p, first_value(role) OVER w = 'system' AS led FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
 e AS (SELECT *, CASE WHEN p = 1 THEN role IN ('system', 'user') WHEN (p - led::INTEGER) % 2 = 1 THEN role = 'user' ELSE role = 'assistant' END AS fits FROM p),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY p) AS said, coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '') AS loss,
   sum(12 + length({_ROLE}) + 1 + length({_ESCAPE.format('text')}) + 11)::BIGINT AS formatted_chars, coalesce(min(p) FILTER (WHERE NOT fits), CASE WHEN arg_max(role, p) = 'assistant' THEN 0 ELSE count(*) + 1 END)::INTEGER AS bad_turn FROM e GROUP BY conv_id, alone)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, bad_turn = 0 AS valid, bad_turn FROM g"""

_WARC = r"""WITH p AS (SELECT page_id, replace(replace(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS url, coalesce(html, '') AS html FROM pages),
 d AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS lead FROM p),
 b AS (SELECT *, page_id <> lead AS again, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda q:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, i * 5 + 1, 5))::BIGINT // q % 32 + 1)::BIGINT, 1)), '')), '') AS digest FROM d)
 SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to, true AS verified,
   (length('WARC/1.1') + 2 + length('WARC-Type: ') + CASE WHEN again THEN 7 ELSE 8 END + 2 + length('WARC-Record-ID: <urn:page:>') + length(page_id::VARCHAR) + 2 + length('WARC-Date: 1970-01-01T00:00:00Z') + 2
   + length('WARC-Target-URI: ') + strlen(url) + 2 + length('WARC-Payload-Digest: sha1:') + 32 + 2
   + CASE WHEN again THEN length('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest') + 2 + length('WARC-Refers-To: <urn:page:>') + length(lead::VARCHAR) + 2 ELSE 0 END
   + length('Content-Type: text/html') + 2 + length('Content-Length: ') + CASE WHEN again THEN 1 ELSE length(payload_bytes::VARCHAR) END + 2 + 2 + CASE WHEN again THEN 0 ELSE payload_bytes END + 4)::BIGINT AS record_bytes FROM b"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _seeds(source: str, key: str) -> str:
    """(key, pos, h) of the windows of source (key, w), each mask's words joined; items shorter than the masks are whole windows."""
    parts = []
    for mask in (*MASKS, *("1" * n for n in range(1, SPAN))):
        span = len(mask)
        looked = " || ' ' || ".join(f"w[i + {k + 1}]" for k, c in enumerate(mask) if c == "1")
        own = f"len(w) = {span}" if span < SPAN and source == "items" else f"len(w) >= {span}"
        if span < SPAN and source == "docs":
            own += f" AND EXISTS (SELECT 1 FROM items WHERE len(items.w) = {span})"
        parts.append(f"SELECT {key}, i AS pos, '{mask} ' || {looked} AS h FROM (SELECT {key}, w, unnest(range(len(w) - {span - 1})) AS i FROM {source} WHERE {own})")
    return " UNION ALL ".join(parts)


_LEAKS = f"""WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), items AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
 ds AS ({_seeds("docs", "doc_id")}), its AS ({_seeds("items", "item_id")}), hits AS (SELECT DISTINCT doc_id, item_id, (ds.pos - its.pos)::INTEGER AS shift FROM ds JOIN its USING (h)),
 n AS (SELECT doc_id, item_id, shift, len(items.w) AS size, len(list_filter(range(len(items.w)), lambda i: shift + i >= 0 AND docs.w[shift + i + 1] = items.w[i + 1])) AS n FROM hits JOIN docs USING (doc_id) JOIN items USING (item_id)),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) AS r FROM n)
 SELECT doc_id, item_id, n AS n_matched, size AS n_item_words, n / size AS share, shift::BIGINT AS doc_word FROM b WHERE r = 1 AND n >= {MIN_SHARE} * size"""



def _quality_sql() -> str:
    w = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    ratios = {
        "symbol_ratio": "n_symbols / greatest(n_words, 1)", "upper_ratio": "n_upper / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "word_chars_mean": "word_chars / greatest(n_words, 1)",
    }
    sizes = {"size_words": "greatest(n_words, 1)", "size_chars": "greatest(word_chars, 1)", "size_lines": "greatest(n_lines, 1)"}
    gamma, least, prior = repr(quality_rules._GAMMA), quality_rules._LEAST, quality_rules.PRIOR
    long = " UNION ALL ".join(f"SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, '{k}' AS ratio, ({v})::DOUBLE AS x FROM r" for k, v in ({k: k for k in ratios} | sizes).items())

    def level(by: str, name: str) -> str:
        keys = f"{by}, ratio" if by else "ratio"
        return f"""{name}m AS (SELECT {keys}, bucket, sum(n) AS n FROM sk GROUP BY ALL),
 {name}q AS (SELECT {keys}, coalesce(2 * pow({gamma}, bucket) / ({gamma} + 1), 0) AS x, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM {name}m),
 {name} AS (SELECT {keys}, max(total)::DOUBLE AS n, min(x) FILTER (WHERE upto >= 0.5 * total) AS mid, min(x) FILTER (WHERE upto >= 0.5 * total) - min(x) FILTER (WHERE upto >= 0.25 * total) AS low, min(x) FILTER (WHERE upto >= 0.25 * total) AS q25 FROM {name}q GROUP BY {keys})"""

    drawn = ", ".join(f"(a.n * a.{k} + {prior} * ((b.n * b.{k} + {prior} * z.{k}) / (b.n + {prior}))) / (a.n + {prior}) AS {k}" for k in ("mid", "low", "q25"))
    of = lambda r, k: f"max({k}) FILTER (WHERE ratio = '{r}')"
    unit = {r: f"{step} / " + (f"sqrt({of(size, 'q25')})" if root else of(size, "q25")) for r, (size, step, root) in quality_rules.UNITS.items()}
    most = ", ".join(f"{of(r, 'mid')} + {quality_rules.SPREAD} * ({of(r, 'low')} + {u}) AS max_{r}" for r, u in unit.items())
    return f"""WITH c AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lang, source, {w} AS w, {lines} AS ls, coalesce(text, '') AS t FROM documents),
 win AS (SELECT id, i, array_to_string(w[i + 1 : i + 8], ' ') AS k FROM (SELECT id, w, unnest(range(len(w) - 7)) AS i FROM c WHERE len(w) >= 8)),
 rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, k) AS m FROM win) WHERE m > 1) GROUP BY id),
 s AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
   coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper FROM c LEFT JOIN rep USING (id)),
 r AS MATERIALIZED (SELECT *, {", ".join(f"{v} AS {k}" for k, v in ratios.items())} FROM s),
 sk AS (SELECT lang, source, ratio, CASE WHEN x >= {least} THEN ceil(ln(x) / ln({gamma}))::INTEGER END AS bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
 {level("lang, source", "a")}, {level("lang", "b")}, {level("", "z")},
 lim AS (SELECT a.lang, a.source, a.ratio, {drawn} FROM a JOIN b ON a.lang = b.lang AND a.ratio = b.ratio JOIN z ON a.ratio = z.ratio),
 tops AS (SELECT lang AS lg, source AS sc, {most} FROM lim GROUP BY ALL),
 v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r JOIN tops ON coalesce(lang, '') = lg AND coalesce(source, '') = sc)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"{k} <= max_{k}" for k in ratios)} AS kept, {", ".join(ratios)} FROM v"""


ORACLES: dict[str, str] = {"op6_quality": _quality_sql(), "op4_decontaminate": _LEAKS, "op7_chat": _CHAT, "op9_warc": _WARC}
