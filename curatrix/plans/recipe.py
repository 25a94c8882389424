"""Recipes: what a stage is mixed from. Plan parameters, read and checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

N, SPLIT = 15_000, {"train": 0.90, "val": 0.05, "test": 0.05}


@dataclass(frozen=True)
class Boost:
    stems: list[str]
    share: float


@dataclass(frozen=True)
class Recipe:
    name: str
    mix: dict[str, float]
    n: int = N
    seed: int = 42
    prompt_key: str | None = None
    split: dict[str, float] = field(default_factory=lambda: dict(SPLIT))
    chrome: dict[str, float] | None = None
    boost: dict[str, Boost] = field(default_factory=dict)


def parse(raw: dict) -> Recipe:
    if not raw.get("mix"):
        raise ValueError("a recipe needs a mix")
    chrome = raw.get("chrome") or None
    if chrome and abs(sum(chrome.values()) - 1) > 1e-6:
        raise ValueError("the shares of chrome must add up to 1")
    boost = {}
    for pool, b in (raw.get("stem_boost") or {}).items():
        share = float(b.get("frac", 0))
        if not b.get("stems") or not 0 < share <= 1:
            raise ValueError(f"the boost of {pool} needs stems and a share in (0, 1]")
        boost[pool] = Boost([str(s).removesuffix(".html") for s in b["stems"]], share)
    return Recipe(str(raw.get("name", "stage")), {str(k): float(v) for k, v in raw["mix"].items()}, int(raw.get("n", N)), int(raw.get("seed", 42)), raw.get("prompt_key"), {**SPLIT, **(raw.get("split") or {})}, chrome, boost)


def load(path: str) -> Recipe:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
