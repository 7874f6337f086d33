"""Rule files: YAML (where the reader is installed) or JSON, as compiled rules."""

from __future__ import annotations

import json
from dataclasses import fields

from tidewatch.operators.rules import Rule

_NAMES = {f.name for f in fields(Rule)}


def parse_rules(spec: dict) -> list[Rule]:
    """Rules of a document ``{"rules": [{...}]}``; unknown fields are left out, missing ones take plain defaults."""
    out = []
    for r in spec.get("rules") or []:
        r = {"severity": "medium", "confidence": 50, "mitre_id": None, "mitre_tactic": None, "kill_chain_stage": "Execution", **r}
        codes = r.get("event_id") or []
        r["event_id"] = [codes] if isinstance(codes, int) else codes
        r["conditions"] = [(c["field"], c["operator"], c["value"]) for c in r.get("conditions") or [] if {"field", "operator", "value"} <= set(c)]
        r = {k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k in _NAMES and v is not None or k in ("mitre_id", "mitre_tactic")}
        for k in ("image_any", "parent_any", "cmd_any", "path_prefix_any"):
            r[k] = tuple(str(x).lower() for x in r.get(k, ()))
        for k in ("image_contains", "severity_required"):
            r[k] = r[k].lower() if r.get(k) else None
        out.append(Rule(**{"name": r["rule_id"], **r}))
    return out


def load_rules(*paths: str) -> list[Rule]:
    """Rules of the first file that exists. It is read once, on the driver."""
    for path in paths:
        try:
            text = open(path, encoding="utf-8").read()
        except FileNotFoundError:
            continue
        if path.endswith(".json"):
            return parse_rules(json.loads(text))
        import yaml

        return parse_rules(yaml.safe_load(text))
    raise FileNotFoundError(", ".join(paths))
