"""Secrets in texts: fixed patterns, and formats learned from what the patterns find.

Grammar inference: the labelled credentials (what the fixed patterns match) make a prefix tree over character classes; states
whose outgoing frequencies are statistically compatible (Hoeffding bounds, recursively) are merged, red-blue order, into a probabilistic automaton
for each kind. Every candidate string of the corpus (a run of the credentials' alphabet, as long as the shortest label at least) is then scored by its
format likelihood under each automaton, against a background automaton learned in the same way from ordinary strings; one that the formats explain
much better is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DataType

from .common import cut, small_batches, text_chunks

_ddl = DataType.fromDDL

KINDS = ("assign", "access", "hex")
#: The kind of a span that only the learned formats found.
LEARNED = "learned"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Least characters of a labelled credential of each kind.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: A candidate is a longest run of the labels' alphabet, as long as the shortest of them at least; points at its ends are the sentence's.
MIN_CANDIDATE = min(LEAST.values())
_EDGE = "[A-Za-z0-9+/_=-]"
_RUN = re.compile(rf"{_EDGE}[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE - 2},}}(?<!\.)")
_LONG = re.compile(rf"{_EDGE}{{{LEAST['hex']},}}")
#: Ordinary runs that the background takes from a drawn text at most, and scores that a task remembers.
BACKGROUND_RUNS, REMEMBERED = 5, 200_000
#: Labelled strings of a kind, and background strings, that an automaton is learned from at most.
TRAIN_LIMIT = 1500
#: Longer strings are scored, but not learned from.
TRAIN_LENGTH = 512
#: Confidence of the Hoeffding bound: smaller merges more.
ALPHA = 0.05
#: States seen less often than this are merged without a test.
MIN_SEEN = 12
#: A candidate is reported if its score is at least the labelled strings' quantile, and this many bits a character over the background: twice as many
#: where a format is learned from FEW strings, four times from a third of them, and so on.
KEEP_QUANTILE, MARGIN_BITS, FEW = 0.02, 0.5, 20

#: Character class: its members.
_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = {c: (k, math.log2(len(v))) for k, v in _CLASSES.items() for c in v}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret), leftmost and non-overlapping within each kind, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for run in _LONG.finditer(text):
        found += [(run.start() + m.start(), run.start() + m.end(), "hex", m[0]) for m in _HEX.finditer(run[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, string) of every candidate."""
    return [(m.start(), m.end(), m[0]) for m in _RUN.finditer(text)]


def symbols(s: str) -> tuple[str, float]:
    """The string's character classes (other characters stand for themselves), and the bits that choose the characters within them."""
    out, bits = [], 0.0
    for c in s:
        k, b = _CLASS_OF.get(c, (c, 0.0))
        out.append(k)
        bits += b
    return "".join(out), bits


@dataclass
class Automaton:
    """next[state][class] = (state, count); ends[state]: how often a string ends there. State 0 begins."""

    next: list[dict[str, tuple[int, int]]]
    ends: list[int]

    def bits(self, s: str) -> float:
        """Log2 probability a character of the string, its end included; unseen steps are smoothed."""
        kinds, within = symbols(s)
        total, state = -within, 0
        for k in kinds:
            steps = self.next[state]
            seen = self.ends[state] + sum(n for _, n in steps.values())
            to, n = steps.get(k, (state, 0))
            total += math.log2((n + 0.1) / (seen + 0.1 * 12))
            state = to
        seen = self.ends[state] + sum(n for _, n in self.next[state].values())
        total += math.log2((self.ends[state] + 0.1) / (seen + 0.1 * 12))
        return total / (len(s) + 1)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton that merging compatible prefix-tree states of the strings gives."""
    step: list[dict[str, int]] = [{}]
    seen, ends = [0], [0]
    for s in strings:
        at = 0
        seen[0] += 1
        for k in symbols(s)[0]:
            to = step[at].get(k)
            if to is None:
                to = step[at][k] = len(step)
                step.append({})
                seen.append(0)
                ends.append(0)
            at = to
            seen[at] += 1
        ends[at] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(n1: int, f1: int, n2: int, f2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if seen[a] < MIN_SEEN or seen[b] < MIN_SEEN:
                continue
            if differ(seen[a], ends[a], seen[b], ends[b]):
                return False
            for k in {*step[a], *step[b]}:
                x, y = step[a].get(k), step[b].get(k)
                if differ(seen[a], 0 if x is None else flow.get((a, k), seen[x]), seen[b], 0 if y is None else flow.get((b, k), seen[y])):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    #: How often a step was taken, once its target is merged with others.
    flow: dict[tuple[int, str], int] = {}

    def fold(a: int, b: int) -> None:
        """Merge the tree under b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for k, y in step[b].items():
                n = flow.get((b, k), seen[y])
                x = step[a].get(k)
                if x is None:
                    step[a][k] = y
                    flow[a, k] = n
                else:
                    flow[a, k] = flow.get((a, k), seen[x]) + n
                    todo.append((x, y))

    red, blue = [0], sorted((step[0][k], 0, k) for k in step[0])
    while blue:
        state, parent, k = blue.pop(0)
        for r in red:
            if compatible(r, state):
                flow.setdefault((parent, k), seen[state])
                step[parent][k] = r
                fold(r, state)
                break
        else:
            flow.setdefault((parent, k), seen[state])
            red.append(state)
        reds = set(red)
        blue = sorted((to, r, c) for r in red for c, to in step[r].items() if to not in reds)
    number = {r: i for i, r in enumerate(red)}
    steps = [{k: (number[to], flow.get((r, k), seen[to])) for k, to in step[r].items()} for r in red]
    return Automaton(steps, [ends[r] for r in red])


@dataclass
class Formats:
    """Of each kind an automaton, the least accepted score, and the least margin over the background; and the background's automaton."""

    kinds: dict[str, tuple[Automaton, float, float]]
    background: Automaton | None
    #: Scores of strings seen before: most candidates are words of the language.
    known: dict[str, float | None] = field(default_factory=dict)

    def accept(self, s: str) -> float | None:
        """The best score of a string that a format explains, else None."""
        if s in self.known:
            return self.known[s]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        best = self.known[s] = self._score(s)
        return best

    def _score(self, s: str) -> float | None:
        best = None
        for kind, (automaton, least, margin) in self.kinds.items():
            # Nothing shorter is labelled so: the format doesn't know it.
            if len(s) < LEAST[kind]:
                continue
            score = automaton.bits(s)
            if score >= least and (self.background is None or score - self.background.bits(s) >= margin):
                best = score if best is None else max(best, score)
        return best


def _scan(texts: DataFrame) -> DataFrame:
    """(base): of each text [(kind, secret)], its labelled credentials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("secret", pa.string())]))
        for batch in text_chunks(batches):
            base = [[{"kind": k, "secret": x} for _, _, k, x in base_spans(t or "")] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(base, kind)], ["base"])

    return small_batches(texts).select("text").mapInArrow(run, "base array<struct<kind:string,secret:string>>")


def _ordinary(texts: DataFrame) -> DataFrame:
    """(s): candidates of the texts that aren't labelled, BACKGROUND_RUNS of each text at most, evenly spaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out = []
            for t in batch.column(0).to_pylist():
                taken = [(a, b) for a, b, _, _ in base_spans(t or "")]
                found = [x for a, b, x in candidates(t or "") if len(x) <= TRAIN_LENGTH and not any(a < e and f < b for f, e in taken)]
                out += found[:: max(1, math.ceil(len(found) / BACKGROUND_RUNS))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["s"])

    return small_batches(texts).select("text").mapInArrow(run, "s string")


def learn(scanned: DataFrame, plain: DataFrame) -> Formats:
    """Formats from the labelled credentials of the whole corpus, of which about TRAIN_LIMIT different ones of each kind, drawn by hash, are used.

    plain: (text); about TRAIN_LIMIT texts, drawn by hash, make the background: from each five words of letters, joined, and its ordinary candidates.
    """
    labelled = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.secret").where(F.length("secret") <= TRAIN_LENGTH).distinct()
    kinds = {}
    total = {r.kind: r.n for r in labelled.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    for kind, n in sorted(total.items()):
        rows = labelled.where((F.col("kind") == kind) & _drawn(F.col("secret"), n)).collect()
        strings = sorted(r.secret for r in rows)[:: max(1, math.ceil(len(rows) / TRAIN_LIMIT))]
        if strings:
            automaton = infer(strings)
            scores = sorted(automaton.bits(s) for s in strings)
            kinds[kind] = (automaton, scores[int(KEEP_QUANTILE * len(scores))], MARGIN_BITS * (1 + FEW / len(strings)))
    if not kinds:
        return Formats({}, None)
    # Only drawn texts are taken apart, and of each only five words leave its task.
    drawn = plain.where(_drawn(F.col("text"), plain.count()))
    some = drawn.select(F.xxhash64("text").alias("h"), F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), 0).alias("w")).where("size(w) >= 5")
    five = F.array_join(F.slice("w", (F.pmod("h", F.size("w") - 4) + 1).cast("int"), 5), "-")
    rows = some.select(five.alias("s")).where(F.length("s") <= TRAIN_LENGTH).distinct().limit(4 * TRAIN_LIMIT).collect()
    runs = _ordinary(drawn).orderBy(F.xxhash64("s"), "s").limit(4 * TRAIN_LIMIT).collect()
    thin = lambda x: x[:: max(1, math.ceil(len(x) / TRAIN_LIMIT))]
    ordinary = thin(sorted(r.s for r in rows)) + thin(sorted(r.s for r in runs))
    return Formats(kinds, infer(ordinary) if ordinary else None)


def _drawn(value: Column, n: int) -> Column:
    """True for about TRAIN_LIMIT of n values, by their hash."""
    return F.pmod(F.xxhash64(value), F.lit(1 << 30)) < int(min(1.0, TRAIN_LIMIT / max(n, 1)) * (1 << 30)) + 1


def all_spans(text: str, formats: Formats) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, score) of the text's base spans and of every accepted candidate that isn't inside one of them, by start and then kind."""
    own = base_spans(text)
    found = [(a, b, k, None) for a, b, k, _ in own]
    for a, b, x in candidates(text) if formats.kinds else ():
        if (score := formats.accept(x)) is not None and not any(f <= a and b <= e for f, e, _, _ in own):
            found.append((a, b, LEARNED, score))
    return sorted(found, key=lambda x: (x[0], (*KINDS, LEARNED).index(x[2])))


def _apply(docs: DataFrame, formats: Formats) -> DataFrame:
    """The columns of docs without text, and spans, see all_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def spans(t: str, known: Formats) -> list[dict]:
        return [{"start": a, "stop": b, "kind": k, "score": x} for a, b, k, x in all_spans(t, known)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in text_chunks(batches):
            at = batch.schema.get_field_index("text")
            out = [spans(t or "", shared.value) for t in batch.column(at).to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(out, kind)], [*kept, "spans"])

    schema = docs.drop("text").schema.add("spans", _ddl("array<struct<start:bigint,stop:bigint,kind:string,score:double>>"))
    return small_batches(docs).mapInArrow(run, schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document the spans of secrets in its whole text, by start and kind; code points, end exclusive.

    A null or empty text has none; repeated rows come out as often as they went in; further columns are ignored; the fewer labelled strings a kind
    has, the more a candidate must stand out. An empty table gives an empty result.
    """
    plain = docs.select("text")
    return _apply(docs.select("doc_id", "text"), learn(cut(_scan(plain)), plain))


def secret_digests(docs: DataFrame) -> DataFrame:
    """The result columns of the query: counts, the digest of the base spans, all spans as text."""
    found = find_secrets(docs)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != LEARNED)
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        of(LEARNED).alias("n_learned"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret's span replaced by `mark` (overlapping spans by one), and n_chars set to the new length where docs has it.

    The spans are those of find_secrets. A null text stays null, an empty one empty; repeated rows all stay; other columns stay as they are, whatever their names; an
    empty table gives an empty result. Formats are learned in a first scan; the second scan finds and cuts the spans.
    """
    scanned = cut(_scan(docs.select("text")))
    shared = docs.sparkSession.sparkContext.broadcast(learn(scanned, docs.select("text")))
    names = docs.columns

    def clean(t: str, known: Formats) -> str:
        spans = [(s, e) for s, e, _, _ in all_spans(t, known)]
        out, at, last = [], 0, 0
        for s, e in spans:
            if s >= last:
                out += [t[at:s], mark]
            last = at = max(last, e)
        return "".join(out) + t[at:] if spans else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else clean(t, shared.value) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    out = small_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
