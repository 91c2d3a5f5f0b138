"""Tracks drawn on a supplied map image.

Projection and the pixels of thin lines are DataFrame work: each step becomes the small boxes of pixels along it,
coverage is the distance to the line, and a pixel keeps its greatest coverage. Wide reveals: each partition walks its
steps once and keeps, on arrays, the exact way to the nearest line for the pixels beside them; what leaves it has
at most the size of the image, by tile. Each tile takes the nearest of all partitions and spreads it over the other
pixels. So work grows with the length of the steps that are in view and with the image, not with the reach, and what is
exchanged does not grow with the steps. The image itself, of bounded size, is composed on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MERCATOR_LIMIT, MERCATOR_RADIUS, mercator_x, mercator_y
from ..sources import png
from .points import ORDER, SEGMENT, along

# Colours, widths and factors of the drawing.
TRACK_COLOR, START_COLOR, END_COLOR = (230, 57, 70, 255), (46, 160, 67, 255), (207, 34, 46, 255)
TRACK_WIDTH, MARK_FACTOR, FOG_OPACITY = 3.0, 1.6, 0.65
REVEAL_M, REVEAL_FT = 6.0, 20.0
FEATHER_SHARE, LEAST_FEATHER = 0.25, 1.0
SKEW = 0.02

TILE = 512
#: Pixels beside a line that get their exact distance, and pixels that are looked at together.
BAND = 1.0
AT_ONCE = 1 << 16
#: Pixels along a step that one box covers.
CHUNK = 16


class RenderError(ValueError):
    """A drawing that can't be made."""


@dataclass(frozen=True)
class Basemap:
    """An image of width x height pixels that shows a box in Web Mercator."""

    width: int
    height: int
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise RenderError("the image is empty")
        if not (self.min_lon < self.max_lon and self.min_lat < self.max_lat):
            raise RenderError("the box has no extent")

    @staticmethod
    def _unit(lat: float, lon: float) -> tuple[float, float]:
        phi = np.radians(np.clip(lat, -MERCATOR_LIMIT, MERCATOR_LIMIT))
        return (lon + 180) / 360, 0.5 - np.log(np.tan(phi) + 1 / np.cos(phi)) / (2 * np.pi)

    @property
    def frame(self) -> tuple[float, float, float, float]:
        left, top = self._unit(self.max_lat, self.min_lon)
        right, bottom = self._unit(self.min_lat, self.max_lon)
        return left, top, right - left, bottom - top

    def to_pixel(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Pixel coordinates; beyond the image too."""
        left, top, w, h = map(float, self.frame)
        return (mercator_x(lon) - left) / w * self.width, (mercator_y(lat) - top) / h * self.height

    @property
    def metres_per_pixel(self) -> float:
        """At the middle latitude of the box."""
        middle = np.radians((self.min_lat + self.max_lat) / 2)
        return float(self.frame[2] * 2 * np.pi * MERCATOR_RADIUS * np.cos(middle) / self.width)

    @property
    def aspect_skew(self) -> float:
        """Height of a pixel over its width; more than SKEW off 1 is worth a warning."""
        _, _, w, h = self.frame
        return float(h / self.height / (w / self.width))


def projected(points: DataFrame, base: Basemap) -> DataFrame:
    """points with px, py."""
    x, y = base.to_pixel(F.col("lat"), F.col("lon"))
    return points.withColumns({"px": x, "py": y})


def strokes(pixels: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1): the steps within each segment; a segment of one point is a step of no length."""
    w = along()
    out = pixels.select(*SEGMENT, "pt_idx", F.col("px").alias("x1"), F.col("py").alias("y1"), F.lag("px").over(w).alias("x0"), F.lag("py").over(w).alias("y0"), F.lead("px").over(w).alias("_x"))
    alone = F.col("x0").isNull() & F.col("_x").isNull()
    return out.filter(F.col("x0").isNotNull() | alone).select(F.coalesce("x0", "x1").alias("x0"), F.coalesce("y0", "y1").alias("y0"), "x1", "y1")


def stroke_shape(width: float) -> tuple[float, float]:
    """(inner, feather): full coverage up to inner, none beyond inner + feather."""
    return max(width / 2 - 0.5, 0.0), 1.0


def _cells(lines: DataFrame, width: int, height: int, reach: float) -> DataFrame:
    """(x, y, ox, oy): pixels within about reach of a step, and the way from their centre to its nearest point.

    A step is walked in pieces of CHUNK pixels, so its boxes grow with its length and not with its square.
    """
    far = reach
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    near = lines.filter((F.greatest("x0", "x1") >= -far) & (F.least("x0", "x1") <= width + far) & (F.greatest("y0", "y1") >= -far) & (F.least("y0", "y1") <= height + far))
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / CHUNK)).cast("int")
    cut = near.withColumns({"_l": dx * dx + dy * dy, "_n": n}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    end = lambda a, k: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * (F.col("_i") + k) / F.col("_n")
    sides = {}
    for axis, size in (("x", width), ("y", height)):
        a, b = end(axis, 0), end(axis, 1)
        sides[f"_{axis}a"] = F.greatest(F.lit(0), F.floor(F.least(a, b) - reach - 0.5).cast("int"))
        sides[f"_{axis}b"] = F.least(F.lit(size - 1), F.ceil(F.greatest(a, b) + reach - 0.5).cast("int"))
    boxed = cut.withColumns(sides).filter("_xa <= _xb and _ya <= _yb")
    cells = boxed.withColumn("y", F.explode(F.sequence("_ya", "_yb"))).withColumn("x", F.explode(F.sequence("_xa", "_xb")))
    t = F.when(F.col("_l") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") + 0.5 - F.col("x0")) * dx + (F.col("y") + 0.5 - F.col("y0")) * dy) / F.col("_l"))))
    at = cells.withColumn("_t", t)
    return at.select("x", "y", (F.col("x0") + F.col("_t") * dx - F.col("x") - 0.5).alias("ox"), (F.col("y0") + F.col("_t") * dy - F.col("y") - 0.5).alias("oy"))


def coverage(lines: DataFrame, width: int, height: int, inner: float, feather: float) -> DataFrame:
    """(x, y, coverage) of pixels that the strokes reach: the greatest of all, never a sum."""
    reach = inner + feather
    away = F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(float(reach)) - away) / float(feather)))
    return _cells(lines, width, height, reach).select("x", "y", share.alias("coverage")).filter("coverage > 0").groupBy("x", "y").agg(F.max("coverage").alias("coverage"))


def _spread(ox: np.ndarray, oy: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Ways to the nearest point for all pixels, from those of a few: jumps of halving length, the last twice."""
    best = ox * ox + oy * oy
    step = 1 << max(0, int(np.ceil(np.log2(max(1, reach)))))
    steps = []
    while step >= 1:
        steps.append(step)
        step //= 2
    h, w = ox.shape
    for k in [*steps, 1]:
        for dy in (-k, 0, k):
            for dx in (-k, 0, k):
                if (dx or dy) and abs(dx) < w and abs(dy) < h:
                    to = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
                    of = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
                    cx, cy = ox[of] + np.float32(dx), oy[of] + np.float32(dy)
                    d = cx * cx + cy * cy
                    better = d < best[to]
                    ox[to][better], oy[to][better], best[to][better] = cx[better], cy[better], d[better]
    return ox, oy


def _beside(x0, y0, x1, y1, width: int, height: int, rim: int):
    """(x, y, ox, oy) of the pixels within BAND of steps: along the longer axis, four pixels across for each."""
    steep = np.abs(y1 - y0) > np.abs(x1 - x0)
    u0, v0, u1, v1 = (np.where(steep, a, b) for a, b in ((y0, x0), (x0, y0), (y1, x1), (x1, y1)))
    last = np.where(steep, height, width) - 1 + rim
    low = np.maximum(-rim, np.floor(np.minimum(u0, u1) - BAND - 0.5)).astype(np.int64)
    many = np.maximum(0, np.minimum(last, np.ceil(np.maximum(u0, u1) + BAND - 0.5)).astype(np.int64) - low + 1)
    ends = np.cumsum(many)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        at = np.arange(begin, min(begin + AT_ONCE, int(ends[-1])))
        k = np.searchsorted(ends, at, "right")
        u = (low[k] + at - (ends[k] - many[k]))[:, None]
        a, b, du, dv = u0[k][:, None], v0[k][:, None], (u1 - u0)[k][:, None], (v1 - v0)[k][:, None]
        along_ = np.clip(np.divide(u + 0.5 - a, du, out=np.zeros(u.shape), where=du != 0), 0, 1)
        v = np.floor(b + along_ * dv - 0.5).astype(np.int64) + np.arange(-1, 3)
        square = du * du + dv * dv
        t = np.clip(np.divide((u + 0.5 - a) * du + (v + 0.5 - b) * dv, square, out=np.zeros(v.shape), where=square != 0), 0, 1)
        ou, ov = a + t * du - u - 0.5, b + t * dv - v - 0.5
        flip, u = steep[k][:, None], np.broadcast_to(u, v.shape)
        x, y = np.where(flip, v, u), np.where(flip, u, v)
        use = (ou * ou + ov * ov <= BAND * BAND) & (x >= -rim) & (x < width + rim) & (y >= -rim) & (y < height + rim)
        yield x[use], y[use], np.where(flip, ov, ou)[use], np.where(flip, ou, ov)[use]


class _Nearest:
    """The way to the nearest line of each pixel of an image of side x side tiles; tiles are made when they are needed."""

    def __init__(self):
        self.tiles: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> None:
        tx, ty = x // TILE, y // TILE
        wide = int(tx.max() - tx.min()) + 1
        tile = (ty - ty.min()) * wide + tx - tx.min()
        order = np.argsort(tile.astype(np.uint16) if tile.max() < 1 << 16 else tile, kind="stable")
        edges = np.flatnonzero(np.diff(tile[order])) + 1
        for rows in np.split(order, edges):
            key = int(tx[rows[0]]), int(ty[rows[0]])
            if key not in self.tiles:
                self.tiles[key] = np.full(TILE * TILE, np.inf, np.float32), np.zeros(TILE * TILE, np.float32), np.zeros(TILE * TILE, np.float32)
            best, best_x, best_y = self.tiles[key]
            at = (y[rows] % TILE) * TILE + x[rows] % TILE
            far = (ox[rows] ** 2 + oy[rows] ** 2).astype(np.float32)
            np.minimum.at(best, at, far)
            won = far == best[at]
            best_x[at[won]], best_y[at[won]] = ox[rows][won], oy[rows][won]

    def rows(self):
        """(x, y, ox, oy) of all pixels that have a way, tile by tile."""
        for (tx, ty), (best, ox, oy) in sorted(self.tiles.items()):
            at = np.flatnonzero(np.isfinite(best))
            yield at % TILE + tx * TILE, at // TILE + ty * TILE, ox[at], oy[at]


_SEEDS = "tx int, ty int, x binary, y binary, ox binary, oy binary"


def _seeds(width: int, height: int, rim: int):
    """Of a partition of steps: the pixels beside them, for each tile that they can reach."""

    def walk(batches):
        near = _Nearest()
        for batch in batches:
            for found in _beside(*(batch.column(i).to_numpy() for i in range(4)), width, height, rim):
                if len(found[0]):
                    near.add(*found)
        for x, y, ox, oy in near.rows():
            out = []
            for ty in range(max(0, (int(y.min()) - rim) // TILE), min((height - 1) // TILE, (int(y.max()) + rim) // TILE) + 1):
                for tx in range(max(0, (int(x.min()) - rim) // TILE), min((width - 1) // TILE, (int(x.max()) + rim) // TILE) + 1):
                    use = (x >= tx * TILE - rim) & (x < (tx + 1) * TILE + rim) & (y >= ty * TILE - rim) & (y < (ty + 1) * TILE + rim)
                    if use.any():
                        out.append((tx, ty, *(a[use].astype(kind).tobytes() for a, kind in ((x, np.int32), (y, np.int32), (ox, np.float32), (oy, np.float32)))))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["tx", "ty", "x", "y", "ox", "oy"])

    return walk


def revealed(lines: DataFrame, width: int, height: int, radius: float, feather: float) -> DataFrame:
    """The same for a wide reach. Each tile, with a rim as wide as the reach, spreads the ways of the pixels beside lines."""
    reach, rim = float(radius), int(np.ceil(radius)) + 1
    seeds = lines.select("x0", "y0", "x1", "y1").dropna().mapInArrow(_seeds(width, height, rim), _SEEDS)

    def measure(key: tuple, own: pa.Table) -> pa.Table:
        left, top = key[0].as_py() * TILE - rim, key[1].as_py() * TILE - rim
        side = TILE + 2 * rim
        ox, oy = np.full((side, side), 1e9, np.float32), np.full((side, side), 1e9, np.float32)
        best = np.full((side, side), np.inf, np.float32)
        for row in zip(*(own.column(c).to_pylist() for c in ("x", "y", "ox", "oy")), strict=True):
            x, y, a, b = (np.frombuffer(v, kind) for v, kind in zip(row, (np.int32, np.int32, np.float32, np.float32), strict=True))
            r, c, far = y - top, x - left, a * a + b * b
            won = far < best[r, c]
            r, c = r[won], c[won]
            ox[r, c], oy[r, c], best[r, c] = a[won], b[won], far[won]
        ox, oy = _spread(ox, oy, rim)
        inner = (slice(rim, rim + min(TILE, height - top - rim)), slice(rim, rim + min(TILE, width - left - rim)))
        share = np.clip((reach - np.hypot(ox[inner], oy[inner])) / feather, 0, 1)
        r, c = np.nonzero(share > 0)
        return pa.table({"x": (c + left + rim).astype(np.int32), "y": (r + top + rim).astype(np.int32), "coverage": share[r, c].astype(float)})

    return seeds.groupBy("tx", "ty").applyInArrow(measure, "x int, y int, coverage double")


def mask(cells: DataFrame, width: int, height: int) -> np.ndarray:
    """Coverage as an image: as many numbers as the image has pixels."""
    out = np.zeros((height, width), np.float32)
    rows = cells.select("x", "y", "coverage").toPandas()
    out[rows["y"], rows["x"]] = rows["coverage"]
    return out


def is_blank(cover: np.ndarray) -> bool:
    """Whether nothing of the image is reached."""
    return not (cover > 0).any()


def blend(image: np.ndarray, cover: np.ndarray, color: tuple[int, int, int, int]) -> np.ndarray:
    """color over image, as far as cover and its own alpha go."""
    a = cover.astype(float) * color[3] / 255
    under = image[..., 3] / 255.0
    total = a + under * (1 - a)
    out = image.astype(float)
    safe = np.where(total > 0, total, 1)
    for k in range(3):
        out[..., k] = (color[k] * a + image[..., k] * under * (1 - a)) / safe
    out[..., 3] = total * 255
    changed = cover > 0
    return np.where(changed[..., None], np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8), image)


def darken(image: np.ndarray, clear: np.ndarray, opacity: float) -> np.ndarray:
    """Darker by opacity where nothing is revealed; transparency stays."""
    out = image.copy()
    out[..., :3] = np.clip(np.floor(image[..., :3] * (1 - opacity * (1 - clear.astype(float)))[..., None] + 0.5), 0, 255).astype(np.uint8)
    return out


#: Reveals of this radius in pixels and more go by tiles.
WIDE = 12.0


def fog_cover(pixels: DataFrame, base: Basemap, reveal_m: float = REVEAL_M) -> DataFrame:
    radius = reveal_m / base.metres_per_pixel
    feather = max(FEATHER_SHARE * radius, LEAST_FEATHER)
    lines = strokes(pixels)
    if radius >= WIDE:
        return revealed(lines, base.width, base.height, radius, feather)
    return coverage(lines, base.width, base.height, max(radius - feather, 0.0), feather)


def rendered(points: DataFrame, image: bytes, bbox: tuple[float, float, float, float] | None = None, fog: bool = False, reveal_m: float = REVEAL_M, fog_opacity: float = FOG_OPACITY, color: tuple[int, int, int, int] = TRACK_COLOR, width: float = TRACK_WIDTH) -> bytes:
    """A PNG image of points on a map image. bbox (min_lon, min_lat, max_lon, max_lat) is the points' own by default."""
    if not 0 <= fog_opacity <= 1:
        raise RenderError("fog opacity is between 0 and 1")
    try:
        canvas, alpha = png.decode(image)
    except ValueError as error:
        raise RenderError(str(error)) from error
    at = F.struct(*ORDER)
    spot = F.struct("lat", "lon")
    box = points.agg(F.count("*").alias("n"), F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"), F.min_by(spot, at).alias("first"), F.max_by(spot, at).alias("last")).first()
    if not box["n"]:
        raise RenderError("there are no points to draw")
    base = Basemap(canvas.shape[1], canvas.shape[0], *(bbox or tuple(box[1:5])))
    pixels = projected(points, base)
    if fog and not reveal_m > 0:
        raise RenderError("a reveal is wider than nothing")
    cells = fog_cover(pixels, base, reveal_m) if fog else coverage(strokes(pixels), base.width, base.height, *stroke_shape(width))
    cover = mask(cells, base.width, base.height)
    if is_blank(cover):
        raise RenderError("the trace is outside of the map image")
    if fog:
        return png.encode(darken(canvas, cover, fog_opacity), alpha)
    canvas = blend(canvas, cover, color)
    for place, mark in ((box["first"], START_COLOR), (box["last"], END_COLOR)):
        x, y = base._unit(place["lat"], place["lon"])
        left, top, w, h = base.frame
        px, py = (x - left) / w * base.width, (y - top) / h * base.height
        ys, xs = np.mgrid[0 : base.height, 0 : base.width] + 0.5
        d = np.hypot(xs - px, ys - py)
        inner, feather = stroke_shape(2 * width * MARK_FACTOR)
        canvas = blend(canvas, np.clip((inner + feather - d) / feather, 0, 1), mark)
    return png.encode(canvas, alpha)


# The dots of a braille cell, by row and column, and where its characters start.
DOTS = ((0x01, 0x08), (0x02, 0x10), (0x04, 0x20), (0x40, 0x80))
BRAILLE = 0x2800


def braille(lines: DataFrame, columns: int, rows: int) -> list[str]:
    """Strokes, in dots (2 x 4 a cell), as lines of text; a step of no length is one dot."""
    length = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    n = F.greatest(F.lit(1), F.ceil(length)).cast("int")
    dots = lines.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), n)))
    at = lambda a: F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("_i") / F.col("_n")).cast("int")
    spots = dots.select(at("x").alias("x"), at("y").alias("y")).filter(F.col("x").between(0, 2 * columns - 1) & F.col("y").between(0, 4 * rows - 1))
    bit = F.element_at(F.array(*[F.lit(b) for r in DOTS for b in r]), F.col("y") % 4 * 2 + F.col("x") % 2 + 1)
    cells = spots.select(F.floor(F.col("x") / 2).alias("c"), F.floor(F.col("y") / 4).alias("r"), bit.alias("bit")).groupBy("r", "c").agg(F.bit_or("bit").alias("bits")).collect()
    grid = [[" "] * columns for _ in range(rows)]
    for x in cells:  # as many as the screen has cells
        grid[x["r"]][x["c"]] = chr(BRAILLE + x["bits"])
    return ["".join(r).rstrip() for r in grid]


# The room around a trace, the extent of one that has none, and how near and far a view can go.
FIT_PADDING, NO_EXTENT, NEAREST, FARTHEST = 1.08, 0.001, 0.00001, 180.0


def cell_aspect(columns: int, rows: int) -> float:
    """Width over height of a view of so many braille cells, whose dots are square."""
    return max(1, columns) / (2 * max(1, rows))


@dataclass(frozen=True)
class Viewport:
    """What a view shows, in projected units: its centre and its height."""

    x: float
    y: float
    height: float

    @classmethod
    def fit(cls, x0: float, y0: float, x1: float, y1: float, aspect: float) -> Viewport:
        need = max(y1 - y0, (x1 - x0) / max(aspect, 1e-300))
        height = min(FARTHEST, max(NEAREST, need * FIT_PADDING)) if np.isfinite(need) and need > 0 else NO_EXTENT
        return cls((x0 + x1) / 2, (y0 + y1) / 2, height)

    def bounds(self, aspect: float) -> tuple[float, float, float, float]:
        """Least x, least y, greatest x, greatest y."""
        w, h = self.height * aspect / 2, self.height / 2
        return self.x - w, self.y - h, self.x + w, self.y + h

    def zoomed(self, factor: float) -> Viewport:
        """Nearer with a factor below one."""
        return replace(self, height=min(FARTHEST, max(NEAREST, self.height * factor)))

    def panned(self, across: float, up: float, aspect: float) -> Viewport:
        """Moved by shares of what is shown."""
        return replace(self, x=self.x + across * self.height * aspect, y=self.y + up * self.height)

    def to_dots(self, x: Column, y: Column, columns: int, rows: int) -> tuple[Column, Column]:
        left, _, right, top = self.bounds(cell_aspect(columns, rows))
        return (x - left) / (right - left) * (2 * columns), (F.lit(top) - y) / self.height * (4 * rows)
