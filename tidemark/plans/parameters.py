"""Run parameters: defaults, named presets, and what overrides what.  Nothing is global; a run carries its own."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RunParameters:
    """Defaults of a run (fixed values)."""

    grid: int = 128
    channels: int = 4
    agents: int = 300
    memory: int = 300
    window: int = 50
    threshold: float = 0.32
    lags: tuple[int, ...] = (5, 15, 30, 60)
    decay: float = 0.995
    frames: int = 500
    samples_per_frame: int = 8
    seed: int = 42
    step: int = 3


#: What each preset changes (fixed values).
PRESETS: dict[str, dict] = {
    "balanced": {},
    "quick": {"grid": 64, "agents": 50, "frames": 60, "samples_per_frame": 4},
    "arv": {"lags": (15, 30, 60, 120), "memory": 500, "window": 80, "threshold": 0.28, "frames": 400},
    "coherence": {"threshold": 0.26, "decay": 0.997, "agents": 400, "frames": 300},
    "dense-agents": {"agents": 800, "grid": 96, "frames": 200},
}


def resolved(preset: str | None = None, seed: int | None = None, quick: bool = False, frames: int | None = None, agents: int | None = None, grid: int | None = None) -> RunParameters:
    """Parameters of a run; later arguments win over earlier ones, and quick never raises the samples of a frame."""
    if preset and preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; one of {sorted(PRESETS)}")
    run = replace(RunParameters(), **PRESETS[preset or "balanced"])
    if seed is not None:
        run = replace(run, seed=int(seed))
    if quick:
        run = replace(run, **(PRESETS["quick"] | {"samples_per_frame": min(run.samples_per_frame, PRESETS["quick"]["samples_per_frame"])}))
    given = {k: v for k, v in (("frames", frames), ("agents", agents), ("grid", grid)) if v is not None}
    return replace(run, **given)
