"""Settings, taxonomies and golden questions from files on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
import tomllib
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """All settings; unknown ones in a file are dropped with a warning."""

    vault: str = "."
    formats: tuple[str, ...] = ("md", "txt", "html", "htm", "docx", "pdf", "epub", "rtf", "odt")
    ignored_dirs: tuple[str, ...] = (".git", ".obsidian", ".trash")
    sidecar_dir: str = ".sidecars"
    chunk_size: int = 1500
    chunk_overlap: int = 150
    chunk_engine: str = "markdown"
    hybrid: bool = True
    rrf_k: int = 60
    top_k: int = 5
    connect_threshold: float = 0.7
    dedupe_threshold: float = 0.9
    claim_threshold: float = 0.55
    freshness_windows: dict[str, int] = field(default_factory=lambda: {"journal": 30, "projects": 90, "reference": 365})


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Tables merge, everything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(text: str, profile: str | None = None, **given: Any) -> Settings:
    """Settings from TOML: the file, over it a profile, over it arguments."""
    raw = tomllib.loads(text)
    profiles = raw.pop("profiles", {})
    if profile is not None:
        if profile not in profiles:
            raise ValueError(f"unknown profile: {profile}")
        raw = merged(raw, profiles[profile])
    raw = merged(raw, {k: v for k, v in given.items() if v is not None})
    names = {f.name for f in dataclasses.fields(Settings)}
    for k in sorted(set(raw) - names):
        log.warning("unknown setting %s", k)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names})


def fingerprint(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:12]


def clamp(value: Any, default: int = 5, most: int = 50) -> int:
    """A number of results, blank for the default, within 1 and the most."""
    if value is None or value == "":
        return max(1, min(default, most))
    try:
        return max(1, min(int(value), most))
    except (TypeError, ValueError):
        raise ValueError("top_k must be an integer") from None


def threshold(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError("a threshold lies within 0 and 1")
    return value


def category_rows(tree: Any, parent: str = "", start: int = 0) -> list[tuple[str, str, str, int]]:
    """(path, parent, name, ordinal) of a tree given as mapping, list or name."""
    entries = list(tree.items()) if isinstance(tree, dict) else [(next(iter(x)), x[next(iter(x))]) if isinstance(x, dict) else (x, None) for x in tree or []]
    out = []
    for k, (name, below) in enumerate(entries):
        path = f"{parent}/{name}" if parent else str(name)
        out.append((path, parent, str(name), start + k))
        out += category_rows(below, path) if below else []
    return out


def load_taxonomy(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, categories) of a taxonomy file; a malformed one is empty."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError:
        raw = None
    raw = raw if isinstance(raw, dict) else {}
    words = list(dict.fromkeys(str(w) for w in raw.get("vocabulary") or []))
    return (
        spark.createDataFrame([(w, k) for k, w in enumerate(words)], "name string, ordinal int"),
        spark.createDataFrame(category_rows(raw.get("categories")), "path string, parent string, name string, ordinal int"),
    )


def category_tree(rows: list[tuple[str, str, int]]) -> dict[str, Any]:
    """The nested mapping of (path, parent, ordinal); leaves are None."""
    below: dict[str, list[str]] = {}
    for path, parent, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        below.setdefault(parent or "", []).append(path)

    def build(parent: str) -> dict[str, Any] | None:
        return {p.rsplit("/", 1)[-1]: build(p) for p in below[parent]} if parent in below else None

    return build("") or {}


def dump_taxonomy(vocabulary: DataFrame, categories: DataFrame) -> str:
    """The file that ``load_taxonomy`` reads; taxonomies are small and edited by hand."""
    words = [r.name for r in vocabulary.orderBy("ordinal").collect()]
    tree = category_tree([(r.path, r.parent, r.ordinal) for r in categories.collect()])
    return yaml.safe_dump({"vocabulary": words, "categories": tree}, allow_unicode=True, sort_keys=False)


CASE_KEYS = {"id", "question", "expected_sources", "expected_keywords", "category", "negative", "follow_ups"}


def load_golden(spark: SparkSession, text: str) -> DataFrame:
    """(case_id, turn_index, question, expected_sources, expected_keywords,
    category, negative); follow-ups are numbered within their case."""
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or raw.get("version") != 1:
        raise ValueError("version must be 1")
    rows: list[tuple] = []

    def add(case: dict, case_id: str, index: int, category: str | None) -> int:
        if unknown := set(case) - CASE_KEYS:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        if case.get("negative") and case.get("expected_sources"):
            raise ValueError(f"{case_id}: a negative case has no expected sources")
        category = case.get("category", category)
        rows.append((case_id, index, case["question"], case.get("expected_sources") or [], case.get("expected_keywords") or [], category, bool(case.get("negative"))))
        for below in case.get("follow_ups") or []:
            index = add(below, case_id, index + 1, category)
        return index

    for k, case in enumerate(raw.get("cases") or []):
        add(case, str(case.get("id", f"case-{k + 1}")), 0, None)
    return spark.createDataFrame(rows, "case_id string, turn_index int, question string, expected_sources array<string>, expected_keywords array<string>, category string, negative boolean")
