"""Settings of a report: what is asked for, then the environment, then what was stored, then defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from typing import Any

from .. import rules
from ..sinks import render

PREFIX = "LODESTRATA_"
KINDS = (*render.RENDERERS, "json", "sarif")


@dataclass(frozen=True)
class Settings:
    """How a report is made and where it goes."""

    output_dir: str = "."
    output_name: str = ""
    kind: str = "md"
    tests: bool = True
    quality: bool = False
    security: bool = False
    max_file_size: int = rules.MAX_FILE_SIZE
    tree_depth: int = rules.TREE_DEPTH
    tree_entries: int = rules.TREE_ENTRIES
    use_cache: bool = False
    sources: bool = True


#: What asking for everything changes, unless it is asked for otherwise.
FULL = {"quality": True, "security": True, "max_file_size": 10 << 30, "tree_depth": 10_000, "tree_entries": 1_000_000}


def load(path: str) -> dict[str, Any]:
    """Stored settings; none where the file is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def save(path: str, **changes) -> None:
    """Store changes beside what is stored already; the old file stays until the new one is complete."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(load(path) | changes, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def resolve(stored: dict[str, Any] | None = None, full: bool = False, **asked) -> Settings:
    """Settings by order of precedence; unknown names and values of a wrong type in the store are passed over.

    Raises ``ValueError`` with everything that is wrong with what results.
    """
    out = replace(Settings(), **(FULL if full else {}))
    for f in fields(Settings):
        value = next((v for v in (asked.get(f.name), os.environ.get(PREFIX + f.name.upper()), (stored or {}).get(f.name)) if v is not None), None)
        kind = type(getattr(out, f.name))
        if isinstance(value, str) and kind is not str:
            value = value.lower() in ("1", "true", "yes") if kind is bool else int(value) if value.lstrip("-").isdigit() else None
        if isinstance(value, kind):
            out = replace(out, **{f.name: value})
    if wrong := problems(out):
        raise ValueError("; ".join(wrong))
    return replace(out, output_dir=os.path.abspath(os.path.expanduser(out.output_dir)))


def problems(settings: Settings) -> list[str]:
    """What is wrong with settings; nothing if they can be used."""
    found = [f"{name} must be above 0" for name in ("max_file_size", "tree_depth", "tree_entries") if getattr(settings, name) <= 0]
    if settings.kind not in KINDS:
        found.append(f"kind must be one of {', '.join(KINDS)}")
    if os.path.basename(settings.output_name) != settings.output_name:
        found.append("output_name must be a name without folders")
    return found
