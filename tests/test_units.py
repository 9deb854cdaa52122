"""Driver-side units: templates, dialect translation, rule loading, triples."""

import re

import pytest

from cloakline.functions.dialect import Untranslatable, to_java
from cloakline.functions.templates import NeedsPython, compile_template
from cloakline.operators.names import name_column_triples
from cloakline.rules import DEFAULT_CONFIG, EXAMPLE_CONFIG, active_rules, build_rules, load_config, load_rules


# ── templates (R4/R5) ────────────────────────────────────────────────────────

def test_compile_template_native_specs():
    assert compile_template("Person{n:03d}") == ("Person%03d", ["n"])
    assert compile_template("100%{n}") == ("100%%%d", ["n"])
    assert compile_template("{orig:.4}{n:>5}") == ("%.4s%5d", ["orig", "n"])
    assert compile_template("{{x}}{n:x}") == ("{x}%x", ["n"])
    with pytest.raises(NeedsPython):
        compile_template("{n:^7}")


# ── regex dialect (D6, §4.3) ────────────────────────────────────────────────

def test_boundary_forms_for_default_rules():
    rules = load_rules(proper_nouns=True)
    java = {r.name: r.java for r in rules}
    W = r"[\p{L}\p{N}_]"
    # leading \b: one class test after the first character, not a look-behind at every position
    assert java["id"] == rf"(?d)[\p{{Nd}}](?<!{W}[\p{{Nd}}])[\p{{Nd}}]{{6,7}}(?!{W})"
    assert java["name"].startswith(rf"(?d)[A-Z](?<!{W}[A-Z])[a-z]{{1,25}}")
    # leading \b of email sits before a class mixing word and other characters: split in two
    assert java["email"].startswith(r"(?d)(?:[a-zA-Z0-9._%+\-&&[\p{L}\p{N}_]]")
    assert {r.name: r.literal for r in rules}["email"] == "@"
    assert all(r.native for r in rules)


def test_untranslatable_goes_to_fallback():
    with pytest.raises(Untranslatable):
        to_java(r"a*")  # can match empty
    with pytest.raises(Untranslatable):
        to_java(r"(a)?(?(1)b|c)x")


def test_named_groups_and_flags():
    j = to_java(r"(?P<x>[a-z])(?P=x)", re.IGNORECASE).pattern
    assert j.startswith("(?diu)") and "\\k<" in j


# ── rule loading (S1-S3) ─────────────────────────────────────────────────────

def test_default_config_order_and_fields():
    rules = build_rules(load_config(DEFAULT_CONFIG))
    assert [r.name for r in rules] == ["email", "name", "id", "username", "proper_noun"]
    name = rules[1]
    assert name.entity and name.labels == ("PERSON",) and name.min_word_length == 2
    assert len(name.exclusions) == 208 and "January" in name.exclusions
    assert rules[2].template == "preserve_length"
    assert rules[4].pn_only and len(rules[4].exclusions) == 80


def test_missing_config_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "nope.toml")


def test_empty_config_and_pn_filter():
    assert build_rules({}) == []
    with pytest.raises(ValueError):
        active_rules([])
    only_pn = build_rules({"patterns": [{"name": "p", "template": "E{n}", "regex": "x", "pn_only": True}]})
    assert active_rules(only_pn) == []
    assert len(active_rules(only_pn, proper_nouns=True)) == 1


def test_defaults_and_optional_regex():
    (r,) = build_rules({"patterns": [{"name": "n", "template": "T", "spacy_ner": True}]})
    assert r.regex is None and r.labels == ("PERSON",) and r.min_word_length == 1 and not r.pn_only


def test_bad_regex_fails_early():
    with pytest.raises(re.error):
        build_rules({"patterns": [{"name": "x", "template": "T", "regex": "("}]})


def test_regex_flags():
    (r,) = build_rules({"patterns": [{"name": "x", "template": "T", "regex": "abc", "regex_flags": ["IGNORECASE"]}]})
    assert r.flags & re.IGNORECASE and r.java.startswith("(?diu)")


def test_example_rules_load():
    rules = build_rules(load_config(EXAMPLE_CONFIG))
    assert [r.name for r in rules] == ["ni_number", "phone_uk", "postcode"]
    assert all(r.native for r in rules)


# ── header triples (M2) ──────────────────────────────────────────────────────

def test_name_triples():
    assert name_column_triples(["Nr", "Given Name", "Middle Initial", "Family Name", "Mail"]) == [(1, 2, 3)]
    assert name_column_triples(["last", "x", None, "FORENAME "]) == [(3, None, 0)]
    assert name_column_triples(["First", "Last", "Middle", "Christian Name", "Second Name"]) == [(0, None, 1), (3, None, 4)]
    assert name_column_triples([]) == name_column_triples(["a", "b"]) == []


def test_container_paths_leave_only_the_result(spark, tmp_path, monkeypatch):
    """Only containers are followed, and what the rounds wrote is gone; before, every
    round kept a copy of all nodes."""
    from cloakline.sources import containers

    made, dropped = [], []
    keep, drop = containers.stored, containers.discard
    monkeypatch.setattr(containers, "stored", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(containers, "discard", lambda s, p: dropped.append(p) or drop(s, p))
    rows = [("f", "r", None, 0), ("f", "a", "r", 1), ("f", "b", "a", 2), ("f", "x", "gone", 7), (None, "r", None, 3), (None, "y", "r", None)]
    rows += [("f", f"t{i}", "b", i) for i in range(50)]
    out = containers.container_paths(spark.createDataFrame(rows, "file string, id string, up string, row long"), ["file"], "id", "up", ["row"])
    got = {(r.file, r.id): r.path for r in out.collect()}
    assert got == {("f", "r"): [0], ("f", "a"): [0, 1], ("f", "b"): [0, 1, 2], ("f", "x"): [7], (None, "r"): [3], (None, "y"): [3, -1],
                   **{("f", f"t{i}"): [0, 1, 2, i] for i in range(50)}}
    assert dropped == [p for _, p in made[:-1]] and len(made) == 5  # links, containers, two rounds, result


def test_container_paths_of_the_wanted_nodes(spark):
    from cloakline.sources.containers import container_paths

    rows = [("f", "a", None, 1, None), ("f", "b", "a", 2, "x"), ("f", "c", "a", 1, None), ("f", "d", "c", 4, "y"), ("g", "a", None, 7, "z")]
    df = spark.createDataFrame(rows, "file string, id string, up string, row long, text string")
    got = container_paths(df, ["file"], "id", "up", ["row"], wanted="text IS NOT NULL").collect()
    assert {(r.file, r.id, tuple(r.path)) for r in got} == {("f", "b", (1, 2)), ("f", "d", (1, 1, 4)), ("g", "a", (7,))} and len(got) == 3
    with pytest.raises(ValueError):  # what is not wanted is checked too
        container_paths(df.union(df.where("id = 'c'")), ["file"], "id", "up", ["row"], wanted="text IS NOT NULL")
