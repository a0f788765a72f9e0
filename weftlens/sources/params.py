"""Parameters of a run: sections of named values, read from and written to two-level YAML."""

from __future__ import annotations

from pathlib import Path

# fixed values: sections, names and defaults of the parameter file
DEFAULTS: dict[str, dict[str, object]] = {
    "Configs": {"Segmentation": True, "Quantification": True, "Gap Analysis": True},
    "Segmentation": {"Number of Labels": 32, "Max Iterations": 30, "Normalized Hue Value": 0.96, "Color Threshold": 0.2, "Min Size": 64, "Max Size": 2048},
    "Detection": {"Dark Line": True, "Min Line Width": 5, "Max Line Width": 13, "Line Width Step": 2, "Low Contrast": 100, "High Contrast": 200, "Extend Line": False, "Minimum Line Length": 5, "Maximum Line Length": 0},
    "Quantification": {"Maximum Display HDM": 230, "Contrast Enhancement": 0.1, "Minimum Branch Length": 5, "Minimum Curvature Window": 10, "Maximum Curvature Window": 30, "Curvature Window Step": 10},
    "Gap Analysis": {"Minimum Gap Diameter": 20},
}


def _value(text: str) -> object:
    low = text.strip().strip("'\"")
    if low.lower() in ("true", "yes", "on"):
        return True
    if low.lower() in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            pass
    return low


def parse(text: str) -> dict[str, dict[str, object]]:
    """Sections over the defaults; comments and blank lines don't count."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    section = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.partition(":")
        if not line.startswith((" ", "\t")):
            section = out.setdefault(key.strip(), {})
        elif section is not None:
            section[key.strip()] = _value(value)
    return out


def load(path: str | Path) -> dict[str, dict[str, object]]:
    return parse(Path(path).read_text())


def dump(params: dict[str, dict[str, object]]) -> str:
    def said(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    return "".join(f"{s}:\n" + "".join(f"  {k}: {said(v)}\n" for k, v in some.items()) for s, some in params.items())


def windows(least: int, most: int, step: int) -> list[int]:
    """least, least + step, … up to the first value of at least most, which may exceed it."""
    out = list(range(least, most + step, step))
    return out


def in_pixels(value: float, resolution: float) -> int:
    return int(value / resolution)
