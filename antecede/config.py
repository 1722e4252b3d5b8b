"""Settings, all fixed in advance and never tuned on data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names and constants that results depend on.
PARTITIONS = ("train", "embargo_1", "validation", "embargo_2", "holdout")
SUFFICIENCY_THRESHOLDS = (1, 3, 5, 10, 20)
TOP_KS = (1, 3, 5, 10)
WINDOWS = (5, 10, 20, 50)
SIZE_BUCKETS = ((1, 1, "1"), (2, 2, "2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, 25, "11-25"), (26, 100, "26-100"), (101, None, "100+"))


@dataclass(frozen=True)
class DetectionConfig:
    window: int = 20
    min_history: int = 5
    scale: float = 0.6745
    threshold: float = 3.5
    zero_mad_eps: float = 1e-9

    def __post_init__(self):
        if self.window <= 0 or self.min_history < 1:
            raise ValueError("window and min_history must be positive")


@dataclass(frozen=True)
class SplitConfig:
    """Inclusive day ranges by partition, in order."""

    ranges: tuple[tuple[str, int, int], ...] = (("train", 1, 130), ("embargo_1", 131, 137), ("validation", 138, 160), ("embargo_2", 161, 167), ("holdout", 168, 182))

    def problems(self) -> list[str]:
        out = []
        if tuple(r[0] for r in self.ranges) != PARTITIONS:
            out.append("partitions")
        out += [f"{name}: empty range" for name, lo, hi in self.ranges if hi < lo]
        out += [f"{a[0]}/{b[0]}: overlap" for a, b in zip(self.ranges, self.ranges[1:], strict=False) if b[1] <= a[2]]
        return out

    @staticmethod
    def scaled(first: int, last: int) -> SplitConfig:
        """The default proportions over another span of days."""
        base, days = SplitConfig().ranges, last - first + 1
        ends = [first + round(days * hi / base[-1][2]) - 1 for _, _, hi in base]
        return SplitConfig(tuple((name, lo, hi) for (name, _, _), lo, hi in zip(base, [first, *(e + 1 for e in ends[:-1])], ends, strict=True)))


@dataclass(frozen=True)
class SmoothingConfig:
    k: float = 20.0
    sufficient: int = 5


@dataclass(frozen=True)
class Columns:
    """Names of the canonical columns; operators take them as arguments."""

    id: str = "id"
    dt: str = "dt"
    group: str = "grp"
    amount: str = "amt"
    label: str = "y"
    extra: tuple[str, ...] = field(default=())


def load_config(path: str, kind: type):
    """A configuration from a JSON or YAML file; unknown or ill-typed entries raise ValueError."""
    import json

    text = open(path).read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    if kind is SplitConfig:
        parts = data.get("partitions", data)
        try:
            config = SplitConfig(tuple((p, int(parts[p]["start_day"]), int(parts[p]["end_day"])) for p in PARTITIONS))
        except (KeyError, TypeError) as e:
            raise ValueError(f"split configuration: {e}") from e
        if config.problems():
            raise ValueError(f"split configuration: {config.problems()}")
        return config
    try:
        return kind(**data)
    except TypeError as e:
        raise ValueError(str(e)) from e
