"""Stage configurations: plain mappings that extend each other."""

from __future__ import annotations

import json
from pathlib import Path


def merged(base: dict, child: dict) -> dict:
    """Mappings are merged at every depth; elsewhere the child wins."""
    out = dict(base)
    for k, v in child.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | Path) -> dict:
    """A JSON file (or YAML, where that library is there) with an optional ``extends``, a path relative to it."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        own = yaml.safe_load(text) or {}
    else:
        own = json.loads(text)
    parent = own.pop("extends", None)
    return merged(load_config(path.parent / parent), own) if parent else own
