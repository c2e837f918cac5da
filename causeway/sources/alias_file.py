"""Reading alias rules from a small configuration file."""

from __future__ import annotations

import json
from pathlib import Path

from causeway.functions.aliases import AliasResolver

try:
    import yaml
except ImportError:  # JSON rule files still work
    yaml = None


class InvalidAliasFile(ValueError):
    """The rule file exists but cannot be parsed."""


def parse_alias_rules(text: str, name: str = "alias rules") -> list[tuple[str, str]]:
    """Ordered (pattern, canonical) pairs under ``dataset_patterns``; malformed text is an error."""
    if not text.strip():
        return []
    try:
        content = yaml.safe_load(text) if yaml else json.loads(text)
        entries = (content or {}).get("dataset_patterns") or []
        return [(entry.get("pattern") or "", entry.get("canonical") or "") for entry in entries]
    except Exception as error:
        raise InvalidAliasFile(f"{name}: {error}") from error


def load_alias_rules(path: str) -> list[tuple[str, str]]:
    """The rules of a file; a missing, unreadable or empty file means no rules."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError:
        return []
    return parse_alias_rules(text, path)


def load_resolver(path: str) -> AliasResolver:
    return AliasResolver(load_alias_rules(path))
