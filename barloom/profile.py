"""The parsing profile: every rule that changes results is explicit, unknown values are refused."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Profile:
    equal_high_low_policy: str = "explicit"  # explicit: containment is strict on both sides
    allow_equal_high: bool = False
    allow_equal_low: bool = False
    window_size: int = 3
    minimum_distance: int = 1
    use_merged_bars: bool = True
    minimum_merged_bar_count: int = 5
    endpoint_extreme_required: bool = True
    alternating_fractals_required: bool = True
    allow_unconfirmed_tail: bool = True
    max_rebuild_distance: int = 200
    checkpoint_interval: int = 50
    snapshot_retention: int = 20
    checkpoint_retention: int = 10

    def __post_init__(self) -> None:
        if self.equal_high_low_policy not in ("explicit", "inclusive"):
            raise ValueError(f"equal_high_low_policy: {self.equal_high_low_policy!r}")
        if self.window_size != 3 or self.minimum_distance != 1 or not self.use_merged_bars:
            raise ValueError("only three-bar turning points over merged bars at distance 1 are defined")
        if not self.alternating_fractals_required:
            raise ValueError("strokes join turning points of alternating type only")
        for f in fields(self):
            value = getattr(self, f.name)
            if type(value) is not type(f.default) or (type(value) is int and value < 1):
                raise ValueError(f"{f.name}: {value!r}")

    @classmethod
    def from_mapping(cls, mapping: dict) -> Profile:
        unknown = set(mapping) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**mapping)
