"""Settings from the environment, checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .errors import InvalidBackendModeError, InvalidConfigError

PREFIX = "TALLYWEAVE_"


def _flag(text: str) -> bool:
    if text.strip().lower() in {"1", "true", "yes", "on"}:
        return True
    if text.strip().lower() in {"0", "false", "no", "off", ""}:
        return False
    raise ValueError(text)


@dataclass(frozen=True)
class Config:
    seed: int = 1337
    seeds: tuple[int, ...] = (1337, 1338, 1339)
    backend: str = "auto"
    n: int = 100_000
    datasets: tuple[str, ...] = ("zipf", "drift_abrupt", "low_card", "elephant_mice")
    budgets_bytes: tuple[int, ...] = (4096, 65536)
    deterministic_only: bool = False
    out_dir: str = "artifacts"
    safety: float = 3.0

    def __post_init__(self):
        if self.backend not in {"auto", "tier0", "tier1"}:
            raise InvalidBackendModeError("backend is auto, tier0 or tier1", backend=self.backend)
        if self.n <= 0 or not self.budgets_bytes or min(self.budgets_bytes) <= 0 or not self.seeds or self.safety <= 0:
            raise InvalidConfigError("sizes, budgets, seeds and limits must be positive", config=str(self))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        readers = {
            "SEED": lambda x: {"seed": int(x), "seeds": (int(x), int(x) + 1, int(x) + 2)},
            "BACKEND": lambda x: {"backend": x.strip().lower()},
            "N": lambda x: {"n": int(x)},
            "BUDGETS": lambda x: {"budgets_bytes": tuple(int(b) for b in x.split(",") if b.strip())},
            "OUT_DIR": lambda x: {"out_dir": x},
            "DETERMINISTIC_ONLY": lambda x: {"deterministic_only": _flag(x)},
            "SAFETY": lambda x: {"safety": float(x)},
            "NO_TIER0": lambda x: {"backend": "tier1"} if _flag(x) else {},
        }
        found: dict = {}
        for name, read in readers.items():
            if (text := env.get(PREFIX + name)) is not None:
                try:
                    found |= read(text)
                except ValueError as e:
                    raise InvalidConfigError("cannot read a setting", name=PREFIX + name, value=text) from e
        return cls(**found)
