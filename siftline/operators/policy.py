"""Policies: presets, files that fail closed, and the classification of findings by them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ACTIONS
from .paths import DEFAULT_DENY

# Modes, what a finding's type is called in a policy, and the groups of actions.
PRESETS = ["strict-local", "sanitize-external", "observe-only"]
SECTIONS = {"secret": "secrets", "pii": "pii", "prompt_injection": "prompt_injection", "command_guard": "commands"}
BLOCK, REDACT, WARN = ["block", "quarantine"], ["redact"], ["warn", "ask"]


class PolicyError(ValueError):
    """A policy that can't be used; never replaced by a default."""


@dataclass(frozen=True)
class Policy:
    policy_version: str = "default-v1"
    mode: str = "strict-local"
    secrets: str = "block"
    pii: str = "redact"
    prompt_injection: str = "block"
    commands: str = "block"
    egress: str = "deny"
    redaction_level: str = "high"
    reversible: bool = False
    preserve_syntax: bool = True
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=lambda: list(DEFAULT_DENY))
    hash_chain: bool = True
    sqlite: bool = True
    jsonl_export: bool = True

    def __post_init__(self):
        choices = {"mode": PRESETS, "egress": ["deny", "allow"], "redaction_level": ["low", "medium", "high"], **dict.fromkeys(SECTIONS.values(), ACTIONS)}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise PolicyError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        for f in fields(self):
            kind, value = type(f.default if f.name not in ("allow", "deny") else []), getattr(self, f.name)
            if not isinstance(value, kind):
                raise PolicyError(f"{f.name} must be {kind.__name__}")

    def tree(self) -> dict:
        """The policy as written to a file."""
        return {
            "policy_version": self.policy_version, "mode": self.mode, "paths": {"allow": self.allow, "deny": self.deny},
            "redaction": {"level": self.redaction_level, "reversible": self.reversible, "preserve_syntax": self.preserve_syntax},
            **{s: {"action": getattr(self, s)} for s in SECTIONS.values()}, "network": {"egress": self.egress},
            "audit": {"hash_chain": self.hash_chain, "sqlite": self.sqlite, "jsonl_export": self.jsonl_export},
        }


def preset(mode: str) -> Policy:
    """The starter policy of a mode; they differ only in what the mode changes."""
    if mode == "strict-local":
        return Policy()
    if mode == "sanitize-external":
        return Policy("sanitize-external-v1", mode, egress="allow")
    if mode == "observe-only":
        return Policy("observe-only-v1", mode, "warn", "warn", "warn", "warn")
    raise PolicyError(f"unknown mode {mode!r}")


def load(path: str) -> Policy:
    """A policy file. Anything unreadable or out of range is an error; unknown keys are ignored."""
    import yaml

    try:
        tree = yaml.safe_load(Path(path).read_text())
        if not isinstance(tree, dict):
            raise PolicyError("a policy is a mapping")
        part = lambda name: tree.get(name) or {}
        given = {k: tree[k] for k in ("policy_version", "mode") if k in tree}
        given |= {s: part(s)["action"] for s in SECTIONS.values() if "action" in part(s)}
        names = {"paths": {"allow": "allow", "deny": "deny"}, "network": {"egress": "egress"}, "redaction": {"level": "redaction_level", "reversible": "reversible", "preserve_syntax": "preserve_syntax"},
                 "audit": {k: k for k in ("hash_chain", "sqlite", "jsonl_export")}}
        given |= {to: part(s)[k] for s, keys in names.items() for k, to in keys.items() if k in part(s)}
        return Policy(**given)
    except (OSError, yaml.YAMLError, AttributeError, TypeError) as e:
        raise PolicyError(f"{path}: {e}") from e


def save(policy: Policy, path: str) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(policy.tree(), sort_keys=False))


def gated(policy: Policy, mode: str) -> Policy:
    """The policy switched to a mode; its own paths and settings stay."""
    new = preset(mode)
    return replace(policy, **{f: getattr(new, f) for f in ("policy_version", "mode", "secrets", "pii", "prompt_injection", "commands", "egress")})


def action(policy: Policy, kind: Column, recommended: Column) -> Column:
    """The policy's action for a finding's type. Denied paths always block; types without a section keep their own."""
    out = F.when(kind == "path", "block")
    for name, section in SECTIONS.items():
        out = out.when(kind == name, getattr(policy, section))
    return out.otherwise(recommended)


def classed(rows: DataFrame) -> DataFrame:
    """Adds class, by the column action: blocked, redactable, warned, or none."""
    a = F.col("action")
    return rows.withColumn("class", F.when(a.isin(BLOCK), "blocked").when(a.isin(REDACT), "redactable").when(a.isin(WARN), "warned").otherwise("none"))


def classify(found: DataFrame, policy: Policy) -> DataFrame:
    """Adds the policy's action, and class."""
    return classed(found.withColumn("action", action(policy, F.col("type"), F.col("recommended_action"))))


def verdict(policy: Policy, blocking: Column, findings: Column) -> Column:
    """blocked, degraded (observed only) or completed, from counts."""
    if policy.mode == "observe-only":
        return F.when(findings > 0, "degraded").otherwise("completed")
    return F.when(blocking > 0, "blocked").otherwise("completed")


def unsanitized(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: does a classified finding that could be redacted lie in a file, where nothing redacts it?"""
    inside = (F.col("class") == "redactable") & ~F.col("origin").isin("prompt", "output")
    return found.groupBy(*keys).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("repo_unsanitized"))
