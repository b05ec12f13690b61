"""Analysis options."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Keys of the published tool that have another name here. Fixed values.
ALIASES = {"shoreline_least_factor": "least_factor"}
MODES, ORIENTATIONS = ("closest", "farthest"), ("left", "right", "mix")


@dataclass(frozen=True)
class Options:
    """Defaults are those of the published tool."""

    smooth_factor: int = 1
    transect_length: float = 500.0
    transect_spacing: float = 30.0
    edge_distance: int = 100
    least_factor: float = 0.5
    intersection_mode: str = "closest"
    transect_orientation: str = "mix"

    def __post_init__(self) -> None:
        if self.intersection_mode not in MODES:
            raise ValueError(f"unknown intersection mode {self.intersection_mode!r}")
        if self.transect_orientation not in ORIENTATIONS:
            raise ValueError(f"unknown orientation {self.transect_orientation!r}")

    @classmethod
    def from_json(cls, value: str | Mapping[str, object]) -> Options:
        """From JSON text or a mapping, perhaps below the key ``options``; strings become numbers, unknown keys are ignored."""
        held = json.loads(value) if isinstance(value, str) else dict(value)
        held = held.get("options", held)
        held = {ALIASES.get(k, k): v for k, v in held.items()}
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: (int(float(held[f.name])) if f.type == "int" else kinds[f.type](held[f.name])) for f in fields(cls) if f.name in held})
