from quarry.functions import markup as M
from quarry.operators import curate as C

CHARACTER = """{{Some Database:Character Template
| Image = x.jpg
| CurrentAlias = [[Night Heron]]
| Codenames = * [[Heron|The Heron]]
* Stilt
| EditorialNames = Heron Vol 1; Grey Heron
| Reality = 6160
| Creators = Person One; [[P2|Person Two]]
| Powers = '''Flight'''<ref>cited</ref>
:Formerly:
* {{Power|x|Gliding}} {{Navigation|a|b}}
| Affiliation = {{Navigation|title=x}}
| History = ===Early===
Born in [[Town]].
}}
[[Category:Birds]]
== Notes ==
none
"""


def test_strip_markup_rules():
    assert M.strip_markup(None) == "" and M.strip_markup("") == ""
    assert M.strip_markup("a<!-- x -->b<ref name=q/>c<ref>d</ref>") == "abc"
    assert M.strip_markup("[[File:a.png|thumb|A [[nested|caption]] here]]after") == "after"
    assert M.strip_markup("[[Category:X]]y [[:Category:Z|label]]") == "y Z"
    assert M.strip_markup("{{Link|Target|Label}} {{Word}} {{cite web|url=x}}.") == "Label Word ."
    assert M.strip_markup("{{a|{{b|inner}}}} [[x|[[y|deep]]]]") == "inner deep"
    assert M.strip_markup("<gallery>\nA.jpg|B\n</gallery>one<br/>two") == "one\ntwo"
    assert M.strip_markup("'''bold''' it's ''x''\n\n\n\nnext  \t line") == "bold it's x\n\nnext line"


def test_unbalanced_marks_are_text():
    for t in ("{{open", "close}}", "[[a", "a]] b {{c", "}}{{", "[[[[", "{{a]]"):
        assert isinstance(M.strip_markup(t), str)
    assert M.strip_markup("{{open") == "{{open"


def test_template_fields_and_sections():
    f = M.template_fields(CHARACTER)
    assert f["CurrentAlias"] == ["Night Heron"] and f["Creators"] == ["Person One", "Person Two"]
    assert f["Codenames"] == ["The Heron", "Stilt"] and f["Affiliation"] == []
    assert any(x.startswith("Formerly: Gliding") for x in f["Powers"])
    assert not any("}" in x for v in f.values() for x in v)
    assert M.body_sections(CHARACTER) == {"Notes": "none"}
    assert M.template_fields("no template") == {}


def test_record_of_a_character():
    text = C.record_of("Heron (Earth-6160)", CHARACTER, "character")
    lines = text.split("\n")
    assert lines[:3] == ["Night Heron (Earth-6160)", "Kind: character", "Page: Heron (Earth-6160)"]
    assert "Codename: The Heron; Stilt; Grey Heron" in lines and "Reality: Earth-6160" in lines
    assert "Created by: Person One; Person Two" in lines
    assert lines[lines.index("History:") + 1].startswith("Early; Born in Town.")
    assert C.record_of("x", "", "character") == ""


def test_articles_lose_dropped_sections():
    page = "Lead text. " * 50 + "\n== References ==\nno\n=== sub ===\nno\n== Story ==\nyes\n"
    out = M.article("T", page)
    assert out.startswith("T\nKind: article\n") and "no" not in out.split("\n") and "Story\nyes" in out
    assert M.article("T", "short") == ""
