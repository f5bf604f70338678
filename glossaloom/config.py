"""What a labelling project is made of: sources, tags with their keywords, and rules."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

REGEX_MARK = "REGEX"
REGEX_SEPARATOR = ":::"


@dataclass(frozen=True)
class SourceSpec:
    """One input. ``text`` is its only text field; without it the input holds metadata."""

    name: str
    id: str
    fields: Sequence[str]
    text: str | None = None
    format: str = "csv"
    delimiter: str = ","
    paths: Sequence[str] = ()
    text_is_file: bool = False
    text_dir: str = ""

    def __post_init__(self):
        if self.id not in self.fields:
            raise ValueError(f"the id {self.id!r} is not among the fields")
        if self.text is not None and self.text not in self.fields:
            raise ValueError(f"the text field {self.text!r} is not among the fields")


@dataclass(frozen=True)
class TagSet:
    """Binary tags and the keywords of each."""

    keywords: Mapping[str, Sequence[str]]

    @classmethod
    def load(cls, path: str) -> TagSet:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({k: list(v) for k, v in self.keywords.items()}, ensure_ascii=False), encoding="utf-8")

    def all_keywords(self, tags: Iterable[str] | None = None) -> list[str]:
        """Distinct keywords of the tags, in order."""
        return list(dict.fromkeys(k for t in (self.keywords if tags is None else tags) for k in self.keywords.get(t, ())))


@dataclass(frozen=True)
class Rule:
    """A substring, or a regular expression, that sets the tags of what it matches."""

    text: str
    priority: int
    encoding: Mapping[str, int]
    order: int

    @property
    def pattern(self) -> str | None:
        """The regular expression in Java's form, if the rule is one."""
        if REGEX_MARK not in self.text:
            return None
        return "(?U)" + self.text.split(REGEX_SEPARATOR)[1].replace("(?P<", "(?<")


@dataclass(frozen=True)
class RuleSet:
    """The rules of one file. Of repeated rule texts the last encoding holds, at every place."""

    rules: Sequence[Rule]
    tags: Sequence[str]
    name: str = "rules"
    by_priority: Sequence[Rule] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "by_priority", sorted(self.rules, key=lambda r: (-r.priority, r.order)))

    @classmethod
    def of(cls, rows: Iterable[Sequence], tags: Sequence[str], name: str = "rules") -> RuleSet:
        """From rows (rule, priority, one value for each tag)."""
        rows = list(rows)
        last = {r[0]: (int(r[1]), {t: int(v) for t, v in zip(tags, r[2:], strict=True)}) for r in rows}
        return cls([Rule(r[0], *last[r[0]], order=i) for i, r in enumerate(rows)], list(tags), name)

    @classmethod
    def load(cls, path: str) -> RuleSet:
        with open(path, newline="", encoding="utf-8") as file:
            header, *rows = csv.reader(file)
        return cls.of([r for r in rows if r], header[2:], Path(path).stem)

    @classmethod
    def new(cls, tags: TagSet, chosen: Sequence[str], name: str = "rules") -> RuleSet:
        """A new file: the chosen tags' distinct keywords at priority 0, all tags 0."""
        return cls.of([(k, 0, *[0] * len(chosen)) for k in tags.all_keywords(chosen)], chosen, name)

    def save(self, path: str, tags: TagSet | None = None) -> None:
        """Write the rules, with the tags that still exist."""
        kept = [t for t in self.tags if tags is None or t in tags.keywords]
        with open(path, "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow(["rule", "prio", *kept])
            out.writerows([r.text, r.priority, *(r.encoding[t] for t in kept)] for r in self.rules)

    def added(self, text: str, priority: int, encoding: Mapping[str, int]) -> RuleSet:
        rows = [(r.text, r.priority, *(r.encoding[t] for t in self.tags)) for r in self.rules]
        return RuleSet.of([*rows, (text, priority, *(encoding.get(t, 0) for t in self.tags))], self.tags, self.name)


def tags_of(rulesets: Iterable[RuleSet]) -> list[str]:
    """Tags of the rule files, each once."""
    return list(dict.fromkeys(t for r in rulesets for t in r.tags))


@dataclass(frozen=True)
class Project:
    """The folders of a project."""

    path: str

    FOLDERS = ("csv", "logs", "train", "rules", "sample", "db", "data")

    def create(self) -> Project:
        for name in self.FOLDERS:
            (Path(self.path) / name).mkdir(parents=True, exist_ok=True)
        return self

    def folder(self, name: str) -> str:
        if name not in self.FOLDERS:
            raise ValueError(f"a project has no folder {name!r}")
        return str(Path(self.path) / name)

    @staticmethod
    def all_in(root: str) -> list[str]:
        """Names of the projects below a folder."""
        return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and (p / "logs").is_dir())
