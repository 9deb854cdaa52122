"""Rule sets: TOML config -> ordered, compiled detection rules.

Rule order is priority.  Regexes are compiled with Python ``re`` on the driver
(bad patterns fail before any job starts) and translated to Java syntax for the
native scan; rules the translator cannot express keep ``java=None`` and are
scanned by the Arrow fallback.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .functions.dialect import Untranslatable, python_flags, to_java

CONF_DIR = Path(__file__).with_name("conf")
DEFAULT_CONFIG = CONF_DIR / "default_rules.toml"
EXAMPLE_CONFIG = CONF_DIR / "example_rules.toml"


@dataclass(frozen=True)
class Rule:
    name: str
    template: str
    regex: str | None = None
    flags: int = 0
    entity: bool = False
    labels: tuple = ("PERSON",)
    exclusions: tuple = ()
    min_word_length: int = 1
    pn_only: bool = False
    java: str | None = field(default=None, compare=False)
    literal: str | None = field(default=None, compare=False)  # a character every match contains

    @property
    def compiled(self) -> re.Pattern | None:
        return re.compile(self.regex, self.flags) if self.regex is not None else None

    @property
    def native(self) -> bool:
        return self.java is not None


def load_config(path) -> dict:
    """Read a TOML rule file; a missing file is an error."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"config file not found: {path}")
    with open(path, "rb") as fh:
        return tomllib.load(fh)


def build_rules(config: dict) -> list[Rule]:
    """Compile every ``[[patterns]]`` block, in order."""
    rules = []
    for block in config.get("patterns", []):
        flags = python_flags(block.get("regex_flags", []))
        regex = block.get("regex")
        java = literal = None
        if regex is not None:
            re.compile(regex, flags)  # fail early on a bad pattern
            try:
                jr = to_java(regex, flags)
                java, literal = jr.pattern, jr.literal
            except Untranslatable:
                java = None
        rules.append(Rule(
            name=block["name"],
            template=block["template"],
            regex=regex,
            flags=flags,
            entity=bool(block.get("spacy_ner", False)),
            labels=tuple(block.get("spacy_labels", ["PERSON"])),
            exclusions=tuple(dict.fromkeys(block.get("exclusions", []))),
            min_word_length=int(block.get("min_word_length", 1)),
            pn_only=bool(block.get("pn_only", False)),
            java=java,
            literal=literal,
        ))
    return rules


def active_rules(rules: list[Rule], proper_nouns: bool = False) -> list[Rule]:
    """Rule-subset switch (S3): an empty rule set is an error *before* the
    ``pn_only`` filter, so a set holding only opt-in rules silently does nothing."""
    if not rules:
        raise ValueError("no [[patterns]] defined in config")
    return [r for r in rules if proper_nouns or not r.pn_only]


def load_rules(path=DEFAULT_CONFIG, proper_nouns: bool = False) -> list[Rule]:
    return active_rules(build_rules(load_config(path)), proper_nouns)


def rule(name: str, template: str, regex: str | None = None, **kw) -> Rule:
    """Build one rule in code (same defaults as a TOML block)."""
    block = {"name": name, "template": template, **kw}
    if regex is not None:
        block["regex"] = regex
    return build_rules({"patterns": [block]})[0]
