"""Profiles on the driver: chains of inheritance, grids of settings, and the split of documents by role coverage."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve_profile(name: str, profiles: dict[str, dict]) -> dict:
    """A profile with what it inherits through ``extends``; a missing or circular parent is an error."""
    chain: list[str] = []
    while name:
        if name in chain:
            raise ValueError(f"profile {name} extends itself: {' > '.join([*chain, name])}")
        if name not in profiles:
            raise KeyError(f"no profile {name}")
        chain.append(name)
        name = profiles[name].get("extends")
    merged: dict = {}
    for k in reversed(chain):
        merged = deep_merge(merged, {x: v for x, v in profiles[k].items() if x != "extends"})
    return merged


def settings_grid(**values: Iterable) -> list[dict]:
    """All combinations of settings, the last one varying fastest."""
    return [dict(zip(values, x)) for x in itertools.product(*values.values())]


def hash_fraction(key: str) -> float:
    """A number from 0 to 1 that a key always gets."""
    return int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF


def held_out_documents(roles: dict[str, set[str]], share: float = 0.2) -> set[str]:
    """Documents for validation: each step takes the one that adds most roles not covered yet, ties by hash."""
    want = max(1, round(len(roles) * share)) if len(roles) > 1 else 0
    taken: set[str] = set()
    covered: set[str] = set()
    while len(taken) < want:
        best = min((d for d in roles if d not in taken), key=lambda d: (-len(roles[d] - covered), hash_fraction(d), d))
        taken.add(best)
        covered |= roles[best]
    return taken
