"""Curation: raw wiki pages to records (C14-C21). One Arrow pass a page; routing and counts are DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import markup as M

# Template field and record label, in the order of a record's lines.
CHARACTER_LABELS = (
    ("Name", "Full name"), ("CurrentAlias", "Also known as"), ("Codenames", "Codename"), ("Aliases", "Other aliases"), ("First", "First appearance"), ("Creators", "Created by"), ("Role", "Role"),
    ("Identity", "Identity status"), ("Origin", "Species / origin"), ("Reality", "Reality"), ("Citizenship", "Citizenship"), ("PlaceOfBirth", "Place of birth"), ("Education", "Education"),
    ("Occupation", "Occupation"), ("BaseOfOperations", "Base of operations"), ("Affiliation", "Affiliation"), ("Relatives", "Relatives"), ("MaritalStatus", "Marital status"), ("Gender", "Gender"),
    ("Powers", "Powers"), ("Abilities", "Abilities"), ("Weaknesses", "Weaknesses"), ("Equipment", "Equipment"), ("Weapons", "Weapons"), ("Transportation", "Transportation"),
    ("UnusualFeatures", "Unusual features"), ("Notes", "Notes"), ("Trivia", "Trivia"),
)
ITEM_LABELS = (
    ("Name", "Formal name"), ("Aliases", "Other aliases"), ("Type", "Type"), ("First", "First appearance"), ("Creators", "Created by"), ("Reality", "Reality"), ("Origin", "Origin"),
    ("LeadDesigner", "Lead designer"), ("AdditionalDesigners", "Additional designers"), ("PlaceOfCreation", "Place of creation"), ("PlaceOfDestruction", "Place of destruction"),
    ("CurrentOwner", "Current owner"), ("PreviousOwners", "Previous owners"), ("AlternateOwners", "Alternate owners"), ("Material", "Material"), ("Dimensions", "Dimensions"), ("Weight", "Weight"),
    ("Model", "Model"), ("Version", "Version"), ("Properties", "Properties"), ("Notes", "Notes"), ("Trivia", "Trivia"),
)
LOCATION_LABELS = (
    ("Name", "Formal name"), ("Aliases", "Other aliases"), ("First", "First appearance"), ("Creators", "Created by"), ("Reality", "Reality"), ("Galaxy", "Galaxy"), ("StarSystem", "Star system"),
    ("Planet", "Planet"), ("Continent", "Continent"), ("Country", "Country"), ("Region", "Region"), ("State", "State"), ("Province", "Province"), ("City", "City"), ("Locale", "Locale"),
    ("Capital", "Capital"), ("Demonym", "Demonym"), ("Language", "Language"), ("Religion", "Religion"), ("Government", "Government"), ("Population", "Population"), ("Dimension", "Dimension"),
    ("PointsOfInterest", "Points of interest"), ("Residents", "Residents"), ("Notes", "Notes"), ("Trivia", "Trivia"),
)
MAIN_REALITY = "Earth-616"

_LABELS = {"item": ITEM_LABELS, "location": LOCATION_LABELS}
_PUBLICATION = re.compile(r"\bVol\s+\d")


def joined(values: list[str]) -> str:
    """C14."""
    return "; ".join(x for x in map(M.strip_markup, values) if x)


def codenames(fields: dict[str, list[str]]) -> str:
    """The different names of the codename fields that aren't publications."""
    found = [x.lstrip("*").strip() for k in ("Codenames", "EditorialNames") for v in fields.get(k, []) for x in re.split(r"[;\n]", M.strip_markup(v))]
    return "; ".join(dict.fromkeys(x for x in found if x and not _PUBLICATION.search(x)))


def reality(fields: dict[str, list[str]], title: str) -> str:
    """The field, bare numbers with their prefix, else what the title says in parentheses."""
    value = joined(fields.get("Reality", [])).strip()
    if value:
        return f"Earth-{value}" if re.fullmatch(r"\d{2,7}", value) else value
    m = re.search(r"\((Earth-[0-9A-Za-z\-]+)\)", title)
    return m[1] if m else ""


def record_of(title: str, wikitext: str | None, kind: str) -> str:
    """The page's record, '' if it has nothing to say."""
    if kind == "article":
        return M.article(title, wikitext)
    fields, sections = M.template_fields(wikitext or ""), M.body_sections(wikitext or "")
    where = reality(fields, title)
    head = joined(fields.get("CurrentAlias", [])) or title
    if where and where not in head and MAIN_REALITY not in [x.strip() for x in where.split(";")]:
        head = f"{head} ({where})"
    lines = []
    for key, label in _LABELS.get(kind, CHARACTER_LABELS):
        value = codenames(fields) if key == "Codenames" else reality({key: fields[key]}, "") if key == "Reality" and key in fields else joined(fields.get(key, []))
        if value:
            lines.append(f"{label}: {value}")
    told = joined([M.clean_headings(x) for x in fields.get("History", [])]) or M.clean_headings(M.strip_markup(sections.get("History", ""))) or joined([M.clean_headings(x) for x in fields.get("Synopsis", [])])
    if told:
        lines += ["History:", told]
    return "\n".join([head, f"Kind: {kind}", f"Page: {title}", *lines]) + "\n" if lines else ""


def curate(pages: DataFrame, kind: str = "character") -> DataFrame:
    """(title, kind, text) of raw pages (title, wikitext and, where it is there, kind); pages with nothing to say are left out."""
    kinds = F.coalesce("kind", F.lit(kind)) if "kind" in pages.columns else F.lit(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"title": b["title"], "kind": b["kind"], "text": [record_of(t or "", w, k) for t, w, k in zip(b["title"], b["wikitext"], b["kind"])]})

    return pages.select("title", "wikitext", kinds.alias("kind")).mapInPandas(run, "title string, kind string, text string").where("text <> ''")


def curation_report(pages: DataFrame, curated: DataFrame) -> DataFrame:
    """Pages, records and empty pages of each kind."""
    n = pages.groupBy("kind").agg(F.count("*").alias("pages"))
    m = curated.groupBy("kind").agg(F.count("*").alias("records"))
    return n.join(m, "kind", "left").select("kind", "pages", F.coalesce("records", F.lit(0)).alias("records"), (F.col("pages") - F.coalesce("records", F.lit(0))).alias("empty"))
