"""Text functions as columns: tokens, names, keys and the surface rules of answers. All built-in expressions, nothing in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config as c


def _plural(t: Column) -> Column:
    """A simple plural: over three letters, ends in s, but not ss, us or is."""
    return (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is")


def _less_one(t: Column) -> Column:
    return F.substring(t, F.lit(1), F.length(t) - 1)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(c.TOKEN_POSSESSIVE), F.lit(0))


def forms(t: Column) -> Column:
    """What a raw token is found by: itself, its singular if it is a plural, its parts if it is a hyphenated compound."""
    none = F.array().cast("array<string>")
    single = F.when(_plural(t) & ~t.isin(*c.QUESTION_WORDS), F.array(_less_one(t))).otherwise(none)
    parts = F.when(F.contains(t, F.lit("-")), F.split(t, "-")).otherwise(none)
    return F.concat(F.array(t), single, parts)


def tokenize(text: Column) -> Column:
    """Tokens in order, each by its forms; repeats stay."""
    return F.flatten(F.transform(raw_tokens(text), forms))


def singular(t: Column) -> Column:
    """T2."""
    return F.when(_plural(t), _less_one(t)).otherwise(t)


def strip_question(tokens: Column) -> Column:
    """Tokens without question words; all of them where nothing would be left."""
    kept = F.filter(tokens, lambda t: ~t.isin(*c.QUESTION_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def norm(text: Column) -> Column:
    """T5: a name as a comparable key: tokens without hyphens, articles and plurals, in order."""
    plain = F.filter(F.transform(raw_tokens(text), lambda t: F.replace(t, F.lit("-"))), lambda t: ~t.isin("", *c.ARTICLES))
    return F.transform(plain, singular)


def keys_of(text: Column) -> Column:
    """The different non-empty keys of a name, with hyphens closed and with hyphens as blanks."""
    both = F.array_distinct(F.array(norm(text), norm(F.replace(text, F.lit("-"), F.lit(" ")))))
    return F.filter(both, lambda k: F.size(k) > 0)


def query_key(text: Column) -> Column:
    """A question's key without scaffolding words; may be empty."""
    return F.filter(norm(text), lambda t: ~t.isin(*c.QUERY_NOISE))


def query_key_or_all(text: Column) -> Column:
    key = query_key(text)
    return F.when(F.size(key) > 0, key).otherwise(norm(text))


def headline(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def untitled(head: Column) -> Column:
    """What a headline sentence is about: the first sentence up to 'is a' or 'is an'."""
    return F.trim(F.regexp_replace(F.substring_index(head, ". ", 1), r"\s+is an? .*$", ""))


def drop_paren(text: Column) -> Column:
    """A title without one trailing parenthesis."""
    return F.regexp_replace(text, r"\s*\([^()]*\)\s*$", "")


def drop_reality(text: Column) -> Column:
    """A title without one trailing reality."""
    return F.regexp_replace(text, r"\s*\(Earth-[^()]*\)\s*$", "")


def size_class(size: Column) -> Column:
    """Decimal digits of a size."""
    return F.length(F.greatest(size, F.lit(1)).cast("string"))


def join_values(values: Column) -> Column:
    """C14: trimmed non-empty values joined by '; '."""
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), "; ")


def humanize(value: Column) -> Column:
    """T16: 'A; B; C' reads 'A, B and C'."""
    items = F.filter(F.transform(F.split(value, ";"), lambda v: F.trim(v)), lambda v: v != "")
    n = F.size(items)
    lead = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(F.concat(lead, F.lit(" and "), F.element_at(items, -1)))


def clip(text: Column, most: int = c.CLIP_CHARS) -> Column:
    """At most `most` characters, cut at the last '; ', '. ' or ', ' beyond a third, else at the last blank."""
    head = F.substring(text, 1, most)
    back = F.reverse(head)

    def last(mark: str) -> Column:
        """Place (from 0) of the last mark, -1 if none."""
        at = F.locate(mark[::-1], back)
        return F.when(at > 0, F.length(head) - at - len(mark) + 1).otherwise(F.lit(-1))

    cut = F.lit(-1)
    for mark in reversed(("; ", ". ", ", ")):
        cut = F.when(last(mark) > most // 3, last(mark)).otherwise(cut)
    space = last(" ")
    cut = F.when(cut >= 0, cut).when(space > 0, space).otherwise(F.length(head))
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.substring(head, F.lit(1), cut)))


def normal_space(text: Column) -> Column:
    """White space runs (of any script) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column, least: int = c.MIN_SENTENCE_CHARS) -> Column:
    """Sentences of at least `least` characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|;\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def strip_html(html: Column) -> Column:
    """C1, C7, C8 for pages: comments, scripts, styles and tags go, <br> is a line end, blanks collapse, blank lines go."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def image_url(name: Column) -> Column:
    """The sharded path of a file name: first digit and first two digits of the MD5 of the underscored name, then the name percent-encoded."""
    under = F.replace(name, F.lit(" "), F.lit("_"))
    digest = F.md5(under)
    code = F.url_encode(under)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        code = F.replace(code, F.lit(a), F.lit(b))
    return F.concat(F.substring(digest, 1, 1), F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), code)


def draw(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only: the first eight hex digits of their MD5. Stands for a seeded generator."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)
