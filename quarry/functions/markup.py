"""Wiki markup as a tree: one parse of the nested braces and brackets, and readers of the tree.

Markup nests without bound, which no regular expression follows; this is the one place of the curation layer that runs in Python, in a single
Arrow pass for each page (see operators.curate).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Templates that carry no prose, and sections of articles that are left out.
DROPPED_TEMPLATES = ("r", "citation", "cite", "cite web", "cite book", "cite news", "navigation", "pagename", "reflist", "image wiki", "marvel database", "seealso", "see also", "main", "further")
DROPPED_SECTIONS = (
    "references", "external links", "see also", "further reading", "bibliography", "notes", "citations", "footnotes", "sources", "collected editions", "reception", "critical reception", "awards",
    "awards and nominations", "gallery", "production", "sales", "publication information", "issues",
)

_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_CLOSE = {"{{": "}}", "[[": "]]"}
_DEBRIS = re.compile(r"(?s)<!--.*?-->|(?i:<gallery[^>]*>.*?</gallery>)|<ref[^>]*/>|<ref[^>]*>.*?</ref>|<math>.*?</math>|</?nowiki>")
_HEADING = re.compile(r"(?m)^[ \t]*={2,}[ \t]*(.+?)[ \t]*={2,}[ \t]*$")
_FILE = re.compile(r"\s*(?:File|Image|Media)\s*:", re.IGNORECASE)
_CATEGORY = re.compile(r"\s*(:?)\s*Category\s*:(.*)", re.IGNORECASE | re.DOTALL)
_FIELD = re.compile(r"\|\s*([A-Za-z0-9_\-]+)\s*=\s*(.*)")


@dataclass
class Node:
    """A template or link: what opens it, and what stands in it, strings and nodes."""

    opened: str
    inside: list = field(default_factory=list)
    start: int = 0
    stop: int = 0


def parse(text: str) -> list:
    """The text as strings and nodes; a mark that nothing closes is text."""
    open_nodes = [Node("")]
    at = 0
    for m in _MARK.finditer(text):
        top = open_nodes[-1]
        if m.start() > at:
            top.inside.append(text[at : m.start()])
        at = m.end()
        if m[0] in _CLOSE:
            open_nodes.append(Node(m[0], start=m.start()))
        elif top.opened and _CLOSE[top.opened] == m[0]:
            open_nodes.pop()
            top.stop = m.end()
            open_nodes[-1].inside.append(top)
        else:
            top.inside.append(m[0])
    open_nodes[-1].inside.append(text[at:])
    while len(open_nodes) > 1:
        lost = open_nodes.pop()
        open_nodes[-1].inside += [lost.opened, *lost.inside]
    return open_nodes[0].inside


def _arguments(node: Node) -> list[list]:
    """What stands between the pipes of the node itself."""
    out: list[list] = [[]]
    for part in node.inside:
        if isinstance(part, Node):
            out[-1].append(part)
            continue
        first, *rest = part.split("|")
        out[-1].append(first)
        out += [[x] for x in rest]
    return out


def _label(node: Node) -> str:
    args = _arguments(node)
    if node.opened == "[[":
        whole = plain(args[0])
        if _FILE.match(whole):
            return ""
        if m := _CATEGORY.match(whole):
            return m[2] if m[1] else ""
        return "|".join(plain(a) for a in args[1:]) if len(args) > 1 else whole
    name = plain(args[0]).strip()
    if name.lower() in DROPPED_TEMPLATES:
        return ""
    if len(args) == 1:
        return name
    unnamed = [a for a in args[1:] if not any(isinstance(x, str) and "=" in x for x in a)]
    label = plain(unnamed[-1]).strip() if unnamed else ""
    return "" if "\n" in label or "=" in label else label


def plain(parts: list) -> str:
    return "".join(x if isinstance(x, str) else _label(x) for x in parts)


def strip_markup(text: str | None) -> str:
    """Clean text: labels of links and templates stay, citations, galleries, files, filing and tags go; blank lines are one at most."""
    if not text:
        return ""
    out = plain(parse(_DEBRIS.sub("", text)))
    out = re.sub(r"<[^>]+>", "", out.replace("<br", "\n<br"))
    out = re.sub(r"'{2,}|__NOTOC__|__NOEDITSECTION__", "", out)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in out.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def clean_headings(text: str) -> str:
    """C10."""
    return _HEADING.sub(r"\1", text)


def main_template(wikitext: str) -> Node | None:
    """C11: the first template whose name says template."""
    todo = [x for x in parse(wikitext) if isinstance(x, Node)]
    found = []
    while todo:
        node = todo.pop()
        if node.opened == "{{" and "template" in plain(_arguments(node)[0]).lower():
            found.append(node)
        todo += [x for x in node.inside if isinstance(x, Node)]
    return min(found, key=lambda n: n.start) if found else None


def template_fields(wikitext: str) -> dict[str, list[str]]:
    """The main template's fields in order, each a list of display values; a ':Label:' line goes before the items after it.

    Lists stand as bulleted lines or with semicolons. The template's own closing braces never reach a value.
    """
    node = main_template(wikitext)
    out: dict[str, list[str]] = {}
    name, sub = None, ""
    for line in (plain(node.inside) if node else "").split("\n"):
        line = line.strip()
        if not line.strip("|"):
            continue
        if m := _FIELD.fullmatch(line):
            name, sub, line = m[1], "", m[2].strip()
            out.setdefault(name, [])
            items = line.split(";")
        elif line.startswith("*"):
            items = line.lstrip("*").split(";")[:1]
        else:
            items = [line]
        if name is None:
            continue
        if line.startswith(":") and line.strip(": "):
            sub = line.strip(": ")
            continue
        items = [x.strip().lstrip("*").strip() for x in items]
        out[name] += [f"{sub}: {x}" if sub else x for x in items if x]
    return out


def body_sections(wikitext: str) -> dict[str, str]:
    """Heading -> text of the sections outside the main template."""
    node = main_template(wikitext)
    rest = wikitext if node is None else wikitext[: node.start] + wikitext[node.stop :]
    parts = re.split(r"(?m)^==+([^=\n]+)==+[ \t]*$", rest)
    return {k.strip(): v.strip() for k, v in zip(parts[1::2], parts[2::2])}


def without_sections(wikitext: str, dropped: tuple[str, ...] = DROPPED_SECTIONS) -> str:
    """The page without the dropped sections and what is nested under them."""
    out, depth = [], None
    for line in wikitext.split("\n"):
        m = re.fullmatch(r"(={2,6})\s*(.+?)\s*(={2,6})\s*", line)
        if m and len(m[1]) == len(m[3]):
            if depth is not None and len(m[1]) <= depth:
                depth = None
            if depth is None and m[2].strip().lower() in dropped:
                depth = len(m[1])
        if depth is None:
            out.append(line)
    return "\n".join(out)


def article(title: str, wikitext: str | None, least: int = 400) -> str:
    """An encyclopedia page as a record; '' if it is shorter than `least`."""
    body = strip_markup(clean_headings(without_sections(wikitext or "")))
    body = "\n".join(x.strip() for x in body.split("\n") if x.strip())
    return f"{title}\nKind: article\n{body}\n" if len(body) >= least else ""
