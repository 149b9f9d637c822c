"""Schemas and configuration of a localisation project."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
    ]
)
PROGRESS = "text string, tr string, pos long"
#: The stand-in speakers of entries without one.
PSEUDO_SPEAKERS = {
    "_text": {"name": "(on-screen text)", "role": "narrator-style text shown on screen"},
    "_menu": {"name": "(menu choice)", "role": "a choice the player picks"},
    "narrator": {"name": "(narration)", "role": "third-person narration"},
}
#: Words that open a statement and are no speaker.
NON_SPEAKERS = (
    "scene", "show", "hide", "play", "stop", "queue", "pause",
    "call", "jump", "return", "menu", "label", "if", "elif",
    "else", "while", "for", "with", "window", "image", "screen",
    "init", "define", "default", "transform", "python", "translate",
    "voice", "nvl", "centered", "extend", "style", "$",
)


@dataclass(frozen=True)
class Profile:
    """A project's settings; ``base`` is the folder that relative paths start from."""

    data: dict[str, Any]
    base: str = "."

    @property
    def language(self) -> str:
        return self.data["language_id"]

    @property
    def language_name(self) -> str:
        return self.data.get("language_name", self.data.get("language_id", "the target language"))

    @property
    def keep(self) -> list[str]:
        return list(self.data.get("keep_untranslated", []))

    @property
    def api(self) -> dict[str, Any]:
        return dict(self.data.get("api", {}))

    @property
    def batch_size(self) -> int:
        return int(self.api.get("batch_size", 20))

    @property
    def speakers(self) -> dict[str, dict[str, str]]:
        """Declared speakers over the stand-in ones."""
        return {**PSEUDO_SPEAKERS, **self.data.get("speakers", {})}

    def path(self, key: str, default: str | None = None, override: str | None = None) -> str | None:
        """An explicit path, else the profile's (relative to it), else the default, else None."""
        if override:
            return override
        value = self.data.get(key) or default
        return os.path.join(self.base, value) if value else None


def load_profile(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        return Profile(json.load(f), os.path.dirname(path) or ".")


@dataclass(frozen=True)
class Near:
    """At least ``least`` rows of ``group`` in the window, and no fewer than of any ``over`` group."""

    group: str
    least: int = 1
    over: tuple[str, ...] = ()


@dataclass(frozen=True)
class QaRule:
    name: str
    pattern: str
    category: int = 4
    speakers: tuple[str, ...] | None = None  # None: all
    skip_monologue: bool = False
    near: Near | None = None
    dedupe: bool = True


@dataclass(frozen=True)
class QaRules:
    rules: tuple[QaRule, ...] = ()
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    window: int = 12
    roman: bool = True
    short_ratio: float = 0.28
    short_least: int = 20

    @classmethod
    def parse(cls, data: dict[str, Any]) -> QaRules:
        groups = {k: tuple(v) for k, v in data.get("groups", {}).items()}
        rules = []
        for r in data.get("rules", []):
            if "speakers" in r:
                who = tuple(r["speakers"])
            else:
                who = groups.get(r["speakers_group"], ()) if "speakers_group" in r else None
            near = r.get("near")
            rules.append(
                QaRule(
                    r["name"], r["pattern"], r.get("category", 4), who, bool(r.get("skip_monologue")),
                    Near(near["group"], near.get("min", 1), tuple(near.get("dominant_over", ()))) if near else None, r.get("dedupe", True),
                )
            )
        return cls(tuple(rules), groups, data.get("window", 12), data.get("roman_check", True), data.get("truncation_ratio", 0.28), data.get("truncation_min_len", 20))


def load_rules(profile: Profile, technical_only: bool = False) -> tuple[QaRules, str | None]:
    """The profile's rules and a warning if their file is missing."""
    path = profile.path("qa_rules_file")
    if technical_only or not path:
        return QaRules(), None
    if not os.path.isfile(path):
        return QaRules(), f"warning: qa_rules_file not found: {path}"
    with open(path, encoding="utf-8") as f:
        return QaRules.parse(json.load(f)), None
