"""Parameters of a rendering, their defaults and limits, and TOML presets."""

from __future__ import annotations

import math
import tomllib
from dataclasses import asdict, dataclass, field, fields

ALGORITHMS = ("grid", "kmeans", "voronoi", "quadtree", "halftone")
SCREENINGS = ("am", "fm", "fm-replay")  # the last draws one after the other, the other by counters
SHAPES = ("circle", "square", "ellipse", "polygon")
MAX_SIDE, MAX_PIXELS = 65_535, 256 * 1024 * 1024  # fixed values


@dataclass(frozen=True)
class Shape:
    kind: str = "circle"
    aspect: float = 1.0  # ellipse: long over short axis
    angle_deg: float = 0.0
    sides: int = 6  # polygon


@dataclass(frozen=True)
class Halftone:
    mode: str = "off"  # off, cmyk, dominant
    angles: tuple[float, ...] = (15.0, 75.0, 0.0, 45.0)
    n: int = 4
    base_angle_deg: float = 15.0


@dataclass(frozen=True)
class Params:
    algorithm: str = "voronoi"
    num_points: int = 800
    cols: int = 80
    min_radius_ratio: float = 0.003
    max_radius_ratio: float = 0.06
    bg_color: tuple[int, int, int] = (255, 255, 255)
    iterations: int = 10
    variance_sensitivity: float = 0.7
    max_boost: float = 2.5
    rng_seed: int = 0
    palette_size: int | None = None
    dot_shape: Shape = field(default_factory=Shape)
    transparent: bool = False
    gamma_correct: bool = False
    dithering: bool = False
    grid_angle_deg: float = 0.0
    halftone: Halftone = field(default_factory=Halftone)
    screening: str = "am"
    halftone_frequency: float = 60.0
    halftone_min_radius_ratio: float = 0.002
    halftone_max_dot_ratio: float = 0.85

    def is_bg_light(self) -> bool:
        r, g, b = self.bg_color
        return not self.transparent and 0.2126 * r + 0.7152 * g + 0.0722 * b > 127.5

    def validate(self, width: int | None = None, height: int | None = None) -> Params:
        """Raise ValueError for what a rendering cannot be made with; not-a-number counts as out of range."""

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.algorithm in ALGORITHMS, f"unknown algorithm {self.algorithm!r}")
        need(self.dot_shape.kind in SHAPES, f"unknown shape {self.dot_shape.kind!r}")
        need(self.screening in SCREENINGS, f"unknown screening {self.screening!r}")
        need(self.halftone.mode in ("off", "cmyk", "dominant"), f"unknown halftone mode {self.halftone.mode!r}")
        need(self.num_points > 0, "num_points must be positive")
        need(self.cols > 0, "cols must be positive")
        need(self.iterations >= 0, "iterations must not be negative")
        need(self.min_radius_ratio > 0, "min_radius_ratio must be positive")
        need(self.min_radius_ratio <= self.max_radius_ratio <= 1, "max_radius_ratio must be from min_radius_ratio to 1")
        need(self.palette_size is None or self.palette_size >= 2, "palette_size must be at least 2")
        need(0 <= self.variance_sensitivity <= 1, "variance_sensitivity must be from 0 to 1")
        need(self.max_boost >= 1, "max_boost must be at least 1")
        need(self.dot_shape.kind != "polygon" or 3 <= self.dot_shape.sides <= 12, "a polygon has 3 to 12 sides")
        need(self.dot_shape.kind != "ellipse" or 0 < self.dot_shape.aspect <= 10, "an ellipse's aspect is over 0 and at most 10")
        need(self.halftone.mode != "dominant" or self.halftone.n >= 2, "dominant halftone needs 2 colours or more")
        need(self.halftone_frequency > 0 and math.isfinite(self.halftone_frequency), "halftone_frequency must be positive")
        for side in (width, height):
            need(side is None or 0 < side <= MAX_SIDE, f"image sides are from 1 to {MAX_SIDE}")
        need(width is None or height is None or width * height <= MAX_PIXELS, "the image has too many pixels")
        return self

    def to_toml(self) -> str:
        """All fields; a palette that is not set is left out, since TOML has no null."""

        def value(v) -> str:
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, str):
                return f'"{v}"'
            return f"[{', '.join(map(value, v))}]" if isinstance(v, tuple | list) else repr(v)

        flat, tables = [], []
        for k, v in asdict(self).items():
            if isinstance(v, dict):
                tables += [f"\n[{k}]", *(f"{a} = {value(b)}" for a, b in v.items())]
            elif v is not None:
                flat.append(f"{k} = {value(v)}")
        return "\n".join([*flat, *tables]) + "\n"

    @classmethod
    def from_toml(cls, text: str) -> Params:
        """Every field must be there, but for ``palette_size``."""
        got = tomllib.loads(text)
        names = {f.name for f in fields(cls)}
        if missing := names - got.keys() - {"palette_size"}:
            raise ValueError(f"the preset lacks {', '.join(sorted(missing))}")
        if unknown := got.keys() - names:
            raise ValueError(f"the preset has unknown fields {', '.join(sorted(unknown))}")
        got["bg_color"] = tuple(got["bg_color"])
        got["dot_shape"] = Shape(**got["dot_shape"])
        got["halftone"] = Halftone(**got["halftone"] | {"angles": tuple(got["halftone"]["angles"])})
        return cls(**got)


def parse_bg_color(s: str) -> tuple[tuple[int, int, int], bool]:
    """white, black, transparent, none, #rrggbb or rrggbb; the flag says transparent."""
    named = {"white": ((255, 255, 255), False), "black": ((0, 0, 0), False), "transparent": ((0, 0, 0), True), "none": ((0, 0, 0), True)}
    if s.lower() in named:
        return named[s.lower()]
    digits = s.lower().removeprefix("#")
    if len(digits) != 6 or not all(c in "0123456789abcdef" for c in digits):
        raise ValueError(f"not a colour: {s!r}")
    return (int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:], 16)), False


def parse_halftone(s: str) -> Halftone:
    """off, cmyk or dominant-N."""
    s = s.lower()
    if s in ("", "off", "cmyk"):
        return Halftone(mode=s or "off")
    kind, _, n = s.partition("-")
    if kind != "dominant" or not n.isdigit() or int(n) < 2:
        raise ValueError(f"not a halftone mode: {s!r}; use off, cmyk or dominant-N with N of 2 or more")
    return Halftone(mode="dominant", n=int(n))


def parse_screening(s: str) -> str:
    if s.lower() not in SCREENINGS:
        raise ValueError(f"not a screening: {s!r}; use {', '.join(SCREENINGS)}")
    return s.lower()


def parse_size(s: str) -> tuple[int, int]:
    """WxH, also with X or a multiplication sign."""
    for sign in "xX×":
        w, found, h = s.partition(sign)
        if found and w.strip().isdigit() and h.strip().isdigit() and int(w) > 0 and int(h) > 0:
            return int(w), int(h)
    raise ValueError(f"not a size: {s!r}; use WxH")
