"""Declared dependencies and editor settings of a repository, read from its manifest files."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

# Keys of .editorconfig and of the formatters' part of pyproject.toml that state a convention.
EDITOR_KEYS, FORMATTER_KEYS = ("indent_style", "indent_size", "max_line_length"), ("line-length", "quote-style")
#: Dependencies shown at most.
MOST = 40


def _text(root: str, name: str) -> str | None:
    try:
        return (Path(root) / name).read_text(errors="replace")
    except OSError:
        return None


def dependencies(root: str) -> list[str]:
    """Declared dependencies in order of declaration; unreadable manifests count as absent."""
    out: list[str] = []
    if text := _text(root, "pyproject.toml"):
        try:
            declared = tomllib.loads(text).get("project", {}).get("dependencies", [])
            out += [d.strip() for d in declared if isinstance(d, str)]
        except (tomllib.TOMLDecodeError, AttributeError):
            pass
    if text := _text(root, "package.json"):
        try:
            declared = json.loads(text).get("dependencies", {})
            out += [f"{k} {v if isinstance(v, str) else ''}".strip() for k, v in declared.items()]
        except (json.JSONDecodeError, AttributeError):
            pass
    return out[:MOST]


def declared(root: str) -> str:
    """The declared dependencies as evidence text, blank without any."""
    deps = dependencies(root)
    return "\n".join(["Declared dependencies:", *(f"- {d}" for d in deps)]) if deps else ""


def formatting(root: str) -> str:
    """What editor and formatter settings state as evidence text, blank without any."""
    lines = [f"editorconfig: {s}" for x in (_text(root, ".editorconfig") or "").splitlines() if (s := x.strip()).startswith(EDITOR_KEYS)]
    project = [x.strip() for x in (_text(root, "pyproject.toml") or "").splitlines()]
    first = (next((x for x in project if x.startswith(k)), None) for k in FORMATTER_KEYS)
    return "\n".join([*lines, *(f"formatter: {x}" for x in first if x)])
