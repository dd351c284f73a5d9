"""Single files on the driver: atomic replacement, input paths, snapshots in git."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Sequence

from folioscope.sources.vault import inside


def replace_file(path: str, text: str) -> None:
    """Write a file whole or not at all; it keeps its mode."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".replace-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, os.stat(path).st_mode & 0o7777 if os.path.exists(path) else 0o644)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def resolve_note(vault: str, given: str) -> str:
    """The path of a note, relative to its vault: given as an absolute one, from
    the current folder, or from the vault. It must exist inside the vault."""
    tried = [given] if os.path.isabs(given) else [os.path.abspath(given), os.path.join(vault, given)]
    for path in tried:
        if os.path.isfile(path) and inside(vault, path):
            return os.path.relpath(os.path.realpath(path), os.path.realpath(vault))
    raise ValueError(f"no note inside the vault: {given}")


def selector(tag: str | None = None, category: str | None = None) -> tuple[str, str]:
    """("tag", name) or ("category", path): exactly one must be given."""
    tag, category = (tag or "").strip(), (category or "").strip().rstrip("/")
    if bool(tag) == bool(category):
        raise ValueError("give a tag or a category")
    return ("tag", tag) if tag else ("category", category)


def _git(folder: str, *arguments: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", folder, *arguments], capture_output=True, text=True, timeout=30, check=False)


def commit_before_change(path: str, message: str = "Before an automatic change") -> bool:
    """Commit one file of a git working tree if it has changes, and nothing else;
    whether there was a commit. Outside of a working tree nothing is done."""
    folder, name = os.path.split(os.path.abspath(path))
    try:
        if _git(folder, "rev-parse", "--is-inside-work-tree").stdout.strip() != "true" or not _git(folder, "status", "--porcelain", "--", name).stdout.strip():
            return False
        _git(folder, "add", "--", name)
        return _git(folder, "commit", "-q", "-m", message, "--", name).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


def edited_key(text: str, section: str, key: str, value: str) -> str:
    """A TOML text with one string set in a section; comments and order stay."""
    line = f'{key} = "{value.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"'
    lines, out, here, done = text.splitlines(), [], False, False
    for x in lines:
        if re.match(r"\s*\[", x):
            if here and not done:
                out.append(line)
                done = True
            here = re.match(rf"\s*\[\s*{re.escape(section)}\s*\]", x) is not None
        elif here and not done and re.match(rf"\s*{re.escape(key)}\s*=", x):
            note = re.search(r"\s+#[^\"]*$", x)
            x, done = line + (note[0] if note else ""), True
        out.append(x)
    if not done:
        out += ([] if here else [f"[{section}]"]) + [line]
    return "\n".join(out) + "\n"


def menu(paths: Sequence[str], most: int = 80) -> str:
    """The first category paths as a list for a prompt."""
    return "\n".join(f"- {p}" for p in list(paths)[:most])
