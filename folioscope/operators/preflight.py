"""Checks before work: settings, provider, vault, formats, index, git."""

from __future__ import annotations

import importlib.util
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.config import Settings, threshold
from folioscope.sources.vault import inside

#: What a format needs beside this library.
NEEDS = {"pdf": ("module", "pypdf"), "doc": ("program", "antiword")}
CHECKS = "name string, status string, detail string"


def _settings(s: Settings) -> str:
    for value in (s.connect_threshold, s.dedupe_threshold, s.claim_threshold):
        threshold(value)
    if not 0 <= s.chunk_overlap < s.chunk_size:
        raise ValueError("the overlap of chunks must be less than their size")
    return f"{s.chunk_engine} chunks of {s.chunk_size}"


def _vault(s: Settings) -> str:
    if not os.path.isdir(s.vault):
        raise ValueError(f"no folder: {s.vault}")
    if not inside(s.vault, os.path.join(s.vault, s.sidecar_dir)):
        raise ValueError("the folder of sidecars lies outside")
    return s.vault


def _provider(provider) -> str:
    v = provider().embed(["a word"])[0]
    if not v:
        raise ValueError("no vector for a word")
    return f"{len(v)} dimensions"


def _formats(s: Settings) -> str:
    lacking = [f for f in s.formats if f in NEEDS and not (importlib.util.find_spec(NEEDS[f][1]) if NEEDS[f][0] == "module" else shutil.which(NEEDS[f][1]))]
    if lacking:
        raise Warning("no engine for " + ", ".join(lacking))
    return ", ".join(s.formats)


def _git(s: Settings) -> str:
    if not os.path.isdir(os.path.join(s.vault, ".git")):
        raise Warning("the vault is no git working tree")
    return "working tree"


def preflight(spark: SparkSession, settings: Settings, provider, dimensions: int | None = None) -> DataFrame:
    """(name, status, detail): status is ok, warning or error. dimensions: those
    of the vectors in the index, if there are any."""

    def same_dimensions() -> str:
        n = len(provider().embed(["a word"])[0] or [])
        if dimensions is not None and n != dimensions:
            raise ValueError(f"the index has {dimensions} dimensions, the provider {n}: migrate")
        return "same dimensions" if dimensions else "no vectors yet"

    checks: list[tuple[str, Callable[[], str]]] = [
        ("settings", lambda: _settings(settings)), ("vault", lambda: _vault(settings)), ("provider", lambda: _provider(provider)),
        ("formats", lambda: _formats(settings)), ("index", same_dimensions), ("git", lambda: _git(settings)),
    ]
    rows = []
    for name, check in checks:
        try:
            rows.append((name, "ok", check()))
        except Warning as e:
            rows.append((name, "warning", str(e)))
        except Exception as e:  # noqa: BLE001  a failed check is a result
            rows.append((name, "error", str(e)))
    return spark.createDataFrame(rows, CHECKS)
