"""A file of questions with the paths that they are expected to find."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str) -> list[dict]:
    """Questions of a YAML file (JSON where no YAML reader is installed): question, expect (one fragment or a list), project."""
    written = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        found = yaml.safe_load(written)
    except ImportError:
        found = json.loads(written or "null")
    if not isinstance(found or [], list):
        raise ValueError(f"{path}: a list of questions is wanted")
    return [checked(q, f"{path}, question {i}") for i, q in enumerate(found or [], 1)]


def checked(entry, where: str) -> dict:
    if not isinstance(entry, dict):
        raise ValueError(f"{where}: a mapping is wanted")
    asked = str(entry.get("question") or "").strip()
    if not asked:
        raise ValueError(f"{where}: there is no question")
    expect = entry.get("expect") or []
    parts = [expect] if isinstance(expect, str) else expect
    return {"question": asked, "expect": [p for p in (str(x).strip() for x in parts) if p], "project": entry.get("project")}
