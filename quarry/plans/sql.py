"""Pieces of DuckDB SQL that the registered queries' twins share."""

from __future__ import annotations

from quarry import config as c


def words(items) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


def plural(t: str) -> str:
    return f"(length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND NOT ends_with({t}, 'us') AND NOT ends_with({t}, 'is'))"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{c.TOKEN}')"


def tokenize(x: str) -> str:
    one = f"CASE WHEN {plural('t')} AND NOT list_contains({words(c.QUESTION_WORDS)}, t) THEN [left(t, length(t) - 1)] ELSE []::VARCHAR[] END"
    parts = "CASE WHEN contains(t, '-') THEN string_split(t, '-') ELSE []::VARCHAR[] END"
    return f"flatten(list_transform({raw_tokens(x)}, lambda t: list_concat(list_concat([t], {one}), {parts})))"


def singular(t: str) -> str:
    return f"CASE WHEN {plural(t)} THEN left({t}, length({t}) - 1) ELSE {t} END"


def norm(x: str) -> str:
    plain = f"list_filter(list_transform({raw_tokens(x)}, lambda t: replace(t, '-', '')), lambda t: NOT list_contains({words(('', *c.ARTICLES))}, t))"
    return f"list_transform({plain}, lambda t: {singular('t')})"


def query_key(x: str) -> str:
    key = f"list_filter({norm(x)}, lambda t: NOT list_contains({words(c.QUERY_NOISE)}, t))"
    return f"CASE WHEN len({key}) > 0 THEN {key} ELSE {norm(x)} END"


def headline(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def normal_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0B]+', ' ', 'g'))"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0"
