"""Settings of the engine, from arguments or the environment. A value ``{{NAME}}`` counts as unset."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

PLACEHOLDER = re.compile(r"\{\{[A-Z0-9_]+\}\}")


@dataclass(frozen=True)
class Config:
    """All settings that change results. Caps are taken as given unless ``autoscale`` is asked for."""

    epsilon_dau: float = 0.3
    epsilon_mau: float = 0.5
    delta: float = 1e-6
    advanced_delta: float = 1e-7
    w_bound: int = 2
    dau_budget_total: float = 3.0
    mau_budget_total: float = 3.5
    default_seed: int = 20251009
    rdp_orders: tuple[float, ...] = (2.0, 4.0, 8.0, 16.0, 32.0)
    sketch_impl: str = "kmv"
    mau_window_days: int = 30
    sketch_k: int = 4096
    bloom_fp_rate: float = 0.01
    hash_salt_secret: str = ""
    hash_salt_rotation_days: int = 30
    hash_index_secret: str = ""
    autoscale: bool = False

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.epsilon_dau > 0 and self.epsilon_mau > 0, "epsilon must be above 0")
        need(0 <= self.delta < 1, "delta must lie in [0, 1)")
        need(0 < self.advanced_delta < 1, "advanced_delta must lie in (0, 1)")
        need(self.w_bound >= 1, "w_bound under 1 would release exact counts")
        need(self.sketch_impl in ("set", "kmv", "theta", "hll"), f"unknown sketch {self.sketch_impl!r}")
        need(self.sketch_k > 0, "sketch_k must be above 0")
        need(self.mau_window_days >= 1, "mau_window_days must be at least 1")
        need(0 < self.bloom_fp_rate < 1, "bloom_fp_rate must lie in (0, 1)")
        need(bool(self.rdp_orders) and all(a > 1 for a in self.rdp_orders), "rdp_orders must be above 1")

    @property
    def sensitivity(self) -> int:
        """How far one user's change can move a daily count: a user counts once a day, whatever the bound."""
        return min(self.w_bound, 1)

    @property
    def root_secret(self) -> str:
        """The secret of the keys under which erasures find rows; it outlives rotations of the salt secret."""
        return self.hash_index_secret or self.hash_salt_secret

    def rotated(self, secret: str) -> Config:
        """The same settings under a new salt secret: daily keys change from now on, erasures still reach what is stored."""
        return replace(self, hash_salt_secret=secret, hash_index_secret=self.root_secret)

    def delta_of(self, metric: str) -> float:
        return self.delta if metric == "mau" else 0.0

    def epsilon(self, metric: str) -> float:
        return {"dau": self.epsilon_dau, "mau": self.epsilon_mau}[metric]

    def cap(self, metric: str) -> float:
        """The month's budget. With ``autoscale`` a cap left at its default covers one release a day."""
        name = f"{metric}_budget_total"
        cap = getattr(self, name)
        if self.autoscale and cap == next(f.default for f in fields(self) if f.name == name):
            return max(cap, 31 * self.epsilon(metric))
        return cap

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **given) -> Config:
        """Settings from variables named like the fields in upper case; the salt secret must be set somewhere."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None and not PLACEHOLDER.fullmatch(raw.strip()):
                found[f.name] = _read(f.type, raw.strip())
        out = replace(cls(), **(found | given))
        if not out.hash_salt_secret:
            raise ValueError("HASH_SALT_SECRET is not set")
        return out


def _read(kind: str, raw: str):
    if kind == "float":
        return float(raw)
    if kind == "int":
        return int(raw)
    if kind == "bool":
        if raw.lower() in ("true", "1", "yes", "on"):
            return True
        if raw.lower() in ("false", "0", "no", "off"):
            return False
        raise ValueError(f"not a truth value: {raw!r}")
    if kind.startswith("tuple"):
        values = json.loads(raw) if raw.startswith("[") else raw.split(",")
        return tuple(float(v) for v in values if float(v) > 1)
    return raw
