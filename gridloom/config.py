"""Where a project's files are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Paths:
    """Files by city or folder; small-area (DA) inputs are optional."""

    load: str
    weather: Mapping[str, str]
    geometry: Mapping[str, str]
    census: Sequence[str] = field(default_factory=list)
    da_load: str | None = None
    da_geometry: Mapping[str, str] = field(default_factory=dict)
    da_census: Sequence[str] = field(default_factory=list)
