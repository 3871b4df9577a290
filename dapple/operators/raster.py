"""Raster kernels in numpy, and the operators that run them over image rows.

Images are (height, width, 3) RGB arrays of bytes, masks boolean arrays, points
(x, y).  Rotations have determinant +1: nothing is ever mirrored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.schema import SPOT, CropConfig, SpotConfig
from dapple.session import ship


# --- sampling and frames -------------------------------------------------


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, border: float = 0.0) -> np.ndarray:
    """Bilinear samples at (x, y); outside the image the border value."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, *image.shape[2:]))
    fx, fy = x - x0, y - y0
    for dx, dy, weight in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
        xi, yi = x0 + dx, y0 + dy
        inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
        value = np.full(out.shape, float(border))
        value[inside] = image[yi[inside], xi[inside]]
        out += value * (weight[..., None] if image.ndim == 3 else weight)
    return out


def rotate_image(image: np.ndarray, centre: tuple[float, float], degrees: float, border: float = 0.0) -> np.ndarray:
    """The image turned about a centre by degrees, same frame."""
    h, w = image.shape[:2]
    a = np.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    dx, dy = xx - centre[0], yy - centre[1]
    x = np.cos(a) * dx - np.sin(a) * dy + centre[0]
    y = np.sin(a) * dx + np.cos(a) * dy + centre[1]
    turned = sample(image.astype(float), x, y, border)
    return turned > 0.5 if image.dtype == bool else np.clip(np.rint(turned), 0, 255).astype(image.dtype)


def rotate_xy(p: tuple[float, float], centre: tuple[float, float], degrees: float) -> tuple[float, float]:
    a = np.radians(degrees)
    dx, dy = p[0] - centre[0], p[1] - centre[1]
    return float(np.cos(a) * dx + np.sin(a) * dy + centre[0]), float(-np.sin(a) * dx + np.cos(a) * dy + centre[1])


def tight_box(mask: np.ndarray, margin: float = 0.0) -> tuple[int, int, int, int]:
    """Half-open x0, y0, x1, y1 around a mask with a margin (rounded half to even), within the frame; empty: all of it."""
    h, w = mask.shape
    if not mask.any():
        return 0, 0, w, h
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    x0, x1, y0, y1 = xs[0], xs[-1] + 1, ys[0], ys[-1] + 1
    mx, my = int(np.rint((x1 - x0) * margin)), int(np.rint((y1 - y0) * margin))
    return max(0, int(x0) - mx), max(0, int(y0) - my), min(w, int(x1) + mx), min(h, int(y1) + my)


def clip_axis(mask: np.ndarray, head: tuple, cloaca: tuple, steps: int = 200) -> tuple | None:
    """The first and last of ``steps`` points from head to cloaca that lie in the frame and the mask."""
    t = np.linspace(0, 1, steps)
    x, y = head[0] + t * (cloaca[0] - head[0]), head[1] + t * (cloaca[1] - head[1])
    xi, yi = np.rint(x).astype(int), np.rint(y).astype(int)
    ok = (xi >= 0) & (yi >= 0) & (xi < mask.shape[1]) & (yi < mask.shape[0])
    ok[ok] = mask[yi[ok], xi[ok]]
    hits = np.flatnonzero(ok)
    return ((float(x[hits[0]]), float(y[hits[0]])), (float(x[hits[-1]]), float(y[hits[-1]]))) if len(hits) else None


def letterbox(image: np.ndarray, size: int, fill: float = 0) -> np.ndarray:
    """Scaled to fit a square, centred on the fill colour."""
    h, w = image.shape[:2]
    s = size / max(h, w)
    nh, nw = max(1, round(h * s)), max(1, round(w * s))
    y, x = np.meshgrid((np.arange(nh) + 0.5) / s - 0.5, (np.arange(nw) + 0.5) / s - 0.5, indexing="ij")
    small = sample(image.astype(float), np.clip(x, 0, w - 1), np.clip(y, 0, h - 1))
    out = np.full((size, size, *image.shape[2:]), fill, dtype=float)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = small
    return out > 0.5 if image.dtype == bool else np.clip(np.rint(out), 0, 255).astype(image.dtype)


def fill_background(image: np.ndarray, mask: np.ndarray, mode: str = "black") -> np.ndarray:
    if mode == "none":
        return image
    out = image.copy()
    out[~mask] = image[mask].mean(axis=0).astype(image.dtype) if mode == "mean" and mask.any() else 0
    return out


# --- masks ---------------------------------------------------------------


def rle_encode(mask: np.ndarray) -> dict:
    """Uncompressed run lengths in column order, starting with zeros, and the size [H, W]."""
    flat = mask.ravel(order="F").astype(np.int8)
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist()
    return {"size": list(mask.shape), "counts": ([0, *runs] if len(flat) and flat[0] else runs)}


def rle_decode(rle: dict) -> np.ndarray:
    h, w = rle["size"]
    counts = np.asarray(rle["counts"], dtype=np.int64)
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape((h, w), order="F")


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1..n of connected parts, in order of their first pixel."""
    h, w = mask.shape
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    labels, n = np.zeros((h, w), dtype=np.int32), 0
    for sy, sx in zip(*np.nonzero(mask), strict=True):
        if labels[sy, sx]:
            continue
        n += 1
        labels[sy, sx] = n
        todo = deque([(sy, sx)])
        while todo:
            y, x = todo.popleft()
            for dy, dx in near:
                v, u = y + dy, x + dx
                if 0 <= v < h and 0 <= u < w and mask[v, u] and not labels[v, u]:
                    labels[v, u] = n
                    todo.append((v, u))
    return labels, n


def largest(mask: np.ndarray) -> np.ndarray:
    labels, n = components(mask)
    return labels == 1 + int(np.argmax(np.bincount(labels.ravel(), minlength=n + 1)[1:])) if n else mask


def foreground(image: np.ndarray, dark: int = 30) -> np.ndarray:
    """All but the near-black area that reaches a corner; dark spots inside stay foreground."""
    black = image.astype(int).sum(axis=2) <= dark
    labels, _ = components(black, diagonal=False)
    h, w = black.shape
    corners = {int(labels[y, x]) for y in (0, h - 1) for x in (0, w - 1)} - {0}
    return ~np.isin(labels, list(corners))


def fill_polygon(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centre lies in the polygon (even-odd rule), row by row."""
    h, w = shape
    out = np.zeros((h, w), dtype=bool)
    if len(points) < 3:
        return out
    p, q = np.asarray(points, dtype=float), np.roll(np.asarray(points, dtype=float), -1, axis=0)
    for y in range(h):
        crosses = (p[:, 1] <= y) != (q[:, 1] <= y)
        if crosses.any():
            a, b = p[crosses], q[crosses]
            xs = np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
            for x0, x1 in zip(xs[0::2], xs[1::2], strict=False):
                out[y, max(0, int(np.ceil(x0))) : min(w, int(np.floor(x1)) + 1)] = True
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The fewest of the points that stay within a tolerance of the line (Douglas and Peucker), without recursion."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b <= a + 1:
            continue
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        gap = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def mask_polygon(mask: np.ndarray, epsilon: float = 0.002, least_frac: float = 0.001) -> np.ndarray | None:
    """Outline of the largest part, simplified to a share of its length; None if the part is too small."""
    part = largest(mask)
    if part.sum() < least_frac * mask.size or not part.any():
        return None
    pad = np.pad(part, 1)
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    start = tuple(int(v) for v in np.argwhere(pad)[0])
    at, back, line = start, 6, [start]
    for _ in range(4 * pad.size):  # clockwise around the part
        for turn in range(1, 9):
            d = (back + turn) % 8
            nxt = (at[0] + around[d][0], at[1] + around[d][1])
            if pad[nxt]:
                at, back = nxt, (d + 4) % 8
                break
        else:
            break
        if at == start:
            break
        line.append(at)
    pts = np.array([(x - 1, y - 1) for y, x in line], dtype=float)
    length = np.hypot(*np.diff(np.vstack([pts, pts[:1]]), axis=0).T).sum()
    return simplify(pts, epsilon * length)


def area_frac(mask: np.ndarray) -> float:
    return float(mask.mean()) if mask.size else 0.0


def erode(mask: np.ndarray, px: int) -> np.ndarray:
    """Shrunk by a square of side 2 px + 1; the frame's edge takes nothing away."""
    if px <= 0:
        return mask
    c = np.pad(np.cumsum(np.cumsum(np.pad(mask, px, constant_values=True).astype(int), axis=0), axis=1), ((1, 0), (1, 0)))
    k = 2 * px + 1
    return (c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) == k * k


# --- the centre line and straightening ------------------------------------


def centerline(mask: np.ndarray, axis: tuple | None, cfg: CropConfig = CropConfig()) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of the body between the axis ends, a polynomial through the widest runs' centres, and the runs' widths.

    Rows without body are interpolated.  None without two rows, with too few
    filled rows for the polynomial, or if more than 15% of them have a second
    run of at least half the widest.
    """
    body = np.flatnonzero(mask.any(axis=1))
    if not len(body):
        return None
    first, last = int(body[0]), int(body[-1])
    if axis is not None:
        ends = sorted(int(p[1]) for p in axis)
        first, last = max(first, ends[0]), min(last, ends[1])
    if last - first < 1:
        return None
    rows = np.arange(first, last + 1)
    band = np.pad(mask[first : last + 1].astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(band, axis=1)
    centre, width, lobed = np.full(len(rows), np.nan), np.full(len(rows), np.nan), 0
    for k in range(len(rows)):
        left, right = np.flatnonzero(step[k] == 1), np.flatnonzero(step[k] == -1)
        if not len(left):
            continue
        size = right - left
        main = int(np.argmax(size))
        centre[k], width[k] = (left[main] + right[main] - 1) / 2, size[main]
        lobed += int(len(size) > 1 and np.partition(size, -2)[-2] >= 0.5 * size[main])
    filled = ~np.isnan(centre)
    n = int(filled.sum())
    if n < cfg.unroll_poly + 2 or lobed > 0.15 * n:
        return None
    centre, width = (np.interp(rows, rows[filled], v[filled]) for v in (centre, width))
    y = rows - rows.mean()
    return rows, np.polyval(np.polyfit(y, centre, min(cfg.unroll_poly, n - 1)), y), width


def curvature(rows: np.ndarray, x: np.ndarray) -> float:
    return float(np.abs(np.gradient(np.gradient(x, rows), rows)).mean()) if len(rows) > 2 else 0.0


def straighten(image: np.ndarray, mask: np.ndarray | None, axis: tuple | None, method: str, cfg: CropConfig = CropConfig()) -> tuple[np.ndarray, str]:
    """The body along the vertical through the frame's middle, in the same frame, black outside the moved mask.

    debend shifts each row by the centre line; wnorm also scales it to the median
    width; ribbon samples along the line's normals at equal steps of its length.
    With any status but ok the image itself comes back.
    """
    if method not in ("debend", "ribbon", "wnorm", "off"):
        return image, "bad_method"
    if method == "off":
        return image.copy(), "ok"
    if mask is None or not mask.any():
        return image, "no_mask"
    if axis is None or any(p is None for p in axis):
        return image, "no_axis"
    line = centerline(mask, axis, cfg)
    if line is None:
        return image, "degenerate_centerline"
    rows, cx, width = line
    if len(rows) < cfg.unroll_min_rows:
        return image, "axis_too_short"
    h, w = image.shape[:2]
    y, x = (v.astype(float) for v in np.mgrid[0:h, 0:w])
    off = np.arange(w) - w / 2
    if method == "ribbon":
        slope = np.gradient(cx, rows)
        speed = np.hypot(1.0, slope)
        arc = np.concatenate([[0.0], np.cumsum((speed[:-1] + speed[1:]) / 2)])
        out_rows = rows[:-1]  # the last row ends the line and is no row of the ribbon
        at = np.interp(np.arange(len(out_rows)) / max(1, len(out_rows) - 1) * (arc[-1] or 1.0), arc, rows)
        tilt = np.interp(at, rows, slope)
        length = np.hypot(1.0, tilt)
        x[out_rows] = np.interp(at, rows, cx)[:, None] + off[None, :] / length[:, None]
        y[out_rows] = at[:, None] - off[None, :] * (tilt / length)[:, None]
    else:
        limit = cfg.unroll_max_shift * w
        scale = np.where(width > 1, width / max(float(np.median(width)), 1e-9), 1.0) if method == "wnorm" else np.ones(len(rows))
        x[rows] = np.clip(cx, w / 2 - limit, w / 2 + limit)[:, None] + off[None, :] * scale[:, None]
    out = np.clip(np.rint(sample(image.astype(float), x, y)), 0, 255).astype(image.dtype)
    xi, yi = np.rint(x).astype(int), np.rint(y).astype(int)
    moved = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
    moved[moved] = mask[yi[moved], xi[moved]]
    out[~moved] = 0
    return out, "ok"


def synthetic_body(h: int = 200, w: int = 120) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    """A bent body of changing width with four spots: image, mask, axis and spot centres."""
    y = np.arange(h)
    cx = w / 2 + 14 * np.sin((y - 20) / (h - 40) * np.pi)
    half = 12 + 16 * np.sin((y - 20) / (h - 40) * np.pi)
    xx = np.arange(w)[None, :]
    mask = (np.abs(xx - cx[:, None]) <= half[:, None]) & ((y >= 20) & (y < h - 20))[:, None]
    image = np.where(mask[..., None], np.array([225, 150, 60]), 0).astype(np.uint8)
    spots = np.array([(cx[r] + dx, r) for r, dx in ((50, -8), (85, 9), (115, -6), (150, 5))])
    yy, xg = np.mgrid[0:h, 0:w]
    for sx, sy in spots:
        image[(xg - sx) ** 2 + (yy - sy) ** 2 <= 16] = (30, 20, 20)
    return image, mask, ((float(cx[20]), 20.0), (float(cx[h - 21]), float(h - 21))), spots


#: Fixed values of the body that ``pattern_preserved`` measures on: frame, axis, rows, half width and its bulge, colours, and spots (row, distance from the axis).
BODY = {"frame": (200, 180), "x": 80, "rows": (30, 176), "half": 10.0, "bulge": (18.0, 105.0, 14.0), "skin": (170, 130, 80), "spot": (20, 20, 230), "radius": 3, "spots": ((60, 6), (90, 10), (105, 18), (150, -5))}


def pattern_preserved(method: str, cfg: CropConfig = CropConfig()) -> bool:
    """Whether spots keep their row and their distance from the axis on a body with a sharp bulge, within the tolerance."""
    (h, w), (top, end), (high, middle, spread) = BODY["frame"], BODY["rows"], BODY["bulge"]
    y, x = np.mgrid[0:h, 0:w]
    half = np.rint(BODY["half"] + high * np.exp(-(((y - middle) / spread) ** 2)))
    mask = (np.abs(x - BODY["x"]) <= half) & (y >= top) & (y < end)
    image = np.where(mask[..., None], np.array(BODY["skin"]), 0).astype(np.uint8)
    for row, off in BODY["spots"]:
        image[(x - BODY["x"] - off) ** 2 + (y - row) ** 2 <= BODY["radius"] ** 2] = BODY["spot"]
    out, status = straighten(image, mask, ((BODY["x"], top + 4), (BODY["x"], end - 6)), method, cfg)
    if status != "ok":
        return False
    red, green, blue = (out[..., k].astype(int) for k in range(3))
    labels, n = components((blue > 150) & (red < 110) & (green < 110))
    found = [(float(ys.mean()), float(xs.mean()) - w / 2) for ys, xs in (np.nonzero(labels == k) for k in range(1, n + 1)) if len(ys) >= 3]
    if len(found) != len(BODY["spots"]):
        return False
    tolerance = cfg.pattern_tol * w
    return all(abs(got[1] - off) <= tolerance and abs(got[0] - row) <= tolerance + 2 for got, (row, off) in zip(sorted(found), BODY["spots"], strict=True))


def pattern_safe(methods: tuple[str, ...] = ("debend", "ribbon", "wnorm")) -> list[str]:
    return [m for m in methods if pattern_preserved(m)]


# --- crops ----------------------------------------------------------------


@dataclass
class Crop:
    image: np.ndarray
    variant: str
    status: str
    mask: np.ndarray | None = None
    axis: tuple | None = None
    degrees: float | None = None
    unrolled: dict[str, np.ndarray] = field(default_factory=dict)
    unroll_status: dict[str, str] = field(default_factory=dict)


def head_up_degrees(head: tuple, cloaca: tuple) -> float:
    """How far to turn so that the head is above the cloaca, in [-180, 180)."""
    a = np.degrees(np.arctan2(head[1] - cloaca[1], head[0] - cloaca[0])) + 90
    return float((a + 180) % 360 - 180)


def ladder(mask_present: Column, seg_conf: Column, area: Column, pose_present: Column, pose_conf: Column, area_loss: Column, cfg: CropConfig = CropConfig()) -> Column:
    """struct(variant, status) of the crop ladder, as an expression."""
    pair = lambda v, s: F.struct(F.lit(v).alias("variant"), F.lit(s).alias("status"))
    return (
        F.when(~mask_present, pair("full", "empty_mask"))
        .when(seg_conf < cfg.seg_conf_min, pair("full", "low_seg_conf"))
        .when(area < cfg.min_area_frac, pair("full", "tiny_mask"))
        .when(~pose_present, pair("belly_mask", "no_pose"))
        .when(pose_conf < cfg.pose_conf_min, pair("belly_mask", "low_pose_conf"))
        .when(area_loss > cfg.clip_tol, pair("belly_oriented", "clipped_after_rotation"))
        .otherwise(pair("belly_oriented", "ok"))
    )


def belly_crop(image: np.ndarray, mask: np.ndarray | None, seg_conf: float, pose: tuple | None, pose_conf: float, cfg: CropConfig = CropConfig()) -> Crop:
    """The canonical crop by the same ladder, with straightened variants."""
    full = lambda status: Crop(letterbox(image, cfg.canon_size), "full", status)
    if mask is None or not mask.any():
        return full("empty_mask")
    if seg_conf < cfg.seg_conf_min:
        return full("low_seg_conf")
    if area_frac(mask) < cfg.min_area_frac:
        return full("tiny_mask")

    def cut(img, m):
        x0, y0, x1, y1 = tight_box(m, cfg.margin)
        return fill_background(img, m, cfg.background)[y0:y1, x0:x1], m[y0:y1, x0:x1], (x0, y0)

    if pose is None or pose_conf < cfg.pose_conf_min:
        piece, m, _ = cut(image, mask)
        return Crop(letterbox(piece, cfg.canon_size), "belly_mask", "no_pose" if pose is None else "low_pose_conf", letterbox(m, cfg.canon_size))
    head, cloaca = pose
    degrees = head_up_degrees(head, cloaca)
    ys, xs = np.nonzero(mask)
    centre = (float(xs.mean()), float(ys.mean()))
    turned, turned_mask = rotate_image(image, centre, degrees), rotate_image(mask, centre, degrees)
    loss = 1 - turned_mask.sum() / mask.sum()
    status = "clipped_after_rotation" if loss > cfg.clip_tol else "ok"
    piece, m, (x0, y0) = cut(turned, turned_mask)
    ends = [tuple(np.subtract(rotate_xy(p, centre, degrees), (x0, y0))) for p in (head, cloaca)]
    axis = clip_axis(m, *ends)
    crop = Crop(letterbox(piece, cfg.canon_size), "belly_oriented", status, letterbox(m, cfg.canon_size), axis, degrees)
    for method in cfg.unroll_methods:
        out, state = straighten(piece, m, axis, method, cfg)
        crop.unroll_status[method] = state
        if state == "ok":
            crop.unrolled[method] = letterbox(out, cfg.canon_size)
    return crop


# --- spots -----------------------------------------------------------------


def spotness(image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Distance of each pixel's colour from the body's median colour, and the median and MAD of that distance over the body."""
    if not mask.any():
        return np.zeros(image.shape[:2]), 0.0, 0.0
    rgb = image.astype(float)
    far = np.sqrt(((rgb - np.median(rgb[mask], axis=0)) ** 2).sum(axis=2))
    middle = float(np.median(far[mask]))
    return far, middle, float(np.median(np.abs(far[mask] - middle)))


def even_light(image: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Contrast-limited equalisation of lightness in ``grid`` x ``grid`` tiles, blended between tile centres; hue stays."""
    lab = _to_lab(image)
    light = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.int64)
    h, w = light.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(light, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if h > th and w > tw else "edge")
    curves = np.zeros((grid, grid, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            count = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(count - limit, 0).sum())
            count = np.minimum(count, limit) + over // 256
            rest = over % 256
            if rest:
                count[:: max(1, 256 // rest)][:rest] += 1
            curves[i, j] = np.clip(np.rint(np.cumsum(count) * 255.0 / (th * tw)), 0, 255)
    gy, gx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(gy).astype(int), np.floor(gx).astype(int)
    fy, fx = (gy - y0)[:, None], (gx - x0)[None, :]
    row = [np.clip(y0 + k, 0, grid - 1)[:, None] for k in (0, 1)]
    col = [np.clip(x0 + k, 0, grid - 1)[None, :] for k in (0, 1)]
    new = (1 - fy) * ((1 - fx) * curves[row[0], col[0], light] + fx * curves[row[0], col[1], light]) + fy * ((1 - fx) * curves[row[1], col[0], light] + fx * curves[row[1], col[1], light])
    lab[..., 0] = np.rint(new) / 2.55
    return _from_lab(lab)


#: Fixed values of the CIE colour space: linear RGB (sRGB primaries) to XYZ, and the white point D65.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def _to_lab(image: np.ndarray) -> np.ndarray:
    c = image.astype(float) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    f = c @ _XYZ.T / _WHITE
    f = np.where(f > (6 / 29) ** 3, np.cbrt(f), f * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    c = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * _WHITE @ np.linalg.inv(_XYZ).T
    c = np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.maximum(c, 0.0) ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)


def blobs(field_: np.ndarray, kind: str, cfg: SpotConfig) -> list[tuple[float, float, float]]:
    """x, y and scale of the maxima of a Gaussian scale space (log: scaled Laplacian; dog: differences) above the threshold.

    Of two blobs whose circles share more than half of the smaller one, the smaller goes.
    """
    if kind == "log":
        sigmas = np.linspace(cfg.log_min_sigma, cfg.log_max_sigma, cfg.log_num_sigma)
        cube = np.stack([-_laplace(_blur(field_, s)) * s**2 for s in sigmas], axis=-1)
    else:
        ratio = 1.6
        sigmas = cfg.log_min_sigma * ratio ** np.arange(int(np.log(cfg.log_max_sigma / cfg.log_min_sigma) / np.log(ratio) + 1) + 1)
        levels = [_blur(field_, s) for s in sigmas]
        cube = np.stack([(a - b) / (ratio - 1) for a, b in zip(levels, levels[1:], strict=False)], axis=-1)
    padded = np.pad(cube, 1, constant_values=-np.inf)
    h, w, k = cube.shape
    most = np.max([padded[1 + a : 1 + a + h, 1 + b : 1 + b + w, 1 + c : 1 + c + k] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
    ys, xs, ks = np.nonzero((cube == most) & (cube > cfg.log_threshold))
    order = np.lexsort((xs, ys, -sigmas[ks]))
    kept: list[tuple[float, float, float]] = []
    for n in order:
        x, y, r = float(xs[n]), float(ys[n]), float(sigmas[ks[n]]) * np.sqrt(2)
        if all(_shared(np.hypot(x - u, y - v), r, s * np.sqrt(2)) <= 0.5 for u, v, s in kept):
            kept.append((x, y, float(sigmas[ks[n]])))
    return kept


def _shared(d: float, a: float, b: float) -> float:
    """Share of the smaller of two circles at distance ``d`` that lies in the other."""
    small, big = sorted((a, b))
    if d >= a + b:
        return 0.0
    if d <= big - small:
        return 1.0
    p = np.arccos(np.clip((d * d + a * a - b * b) / (2 * d * a), -1, 1))
    q = np.arccos(np.clip((d * d + b * b - a * a) / (2 * d * b), -1, 1))
    lens = a * a * (p - np.sin(2 * p) / 2) + b * b * (q - np.sin(2 * q) / 2)
    return float(lens / (np.pi * small * small))


def select_spots(spots: list[dict], cfg: SpotConfig) -> list[dict]:
    """The best ``top_n`` above the least score: by the square root of area times score, or by area."""
    if cfg.select_by == "salience":
        order = lambda s: (-np.sqrt(max(s["area"], 0.0)) * s["score"], -s["score"], -s["area"], s["x"], s["y"])
    else:
        order = lambda s: (-s["area"], s["x"], s["y"])
    return sorted((s for s in spots if s["score"] >= cfg.min_score), key=order)[: cfg.top_n]


def detect_spots(image: np.ndarray, mask: np.ndarray, cfg: SpotConfig = SpotConfig()) -> list[dict]:
    """Spots of a crop inside its mask: far from the median colour in MADs, dark against the mean, or blobs of either Gaussian kind."""
    if cfg.detect_method not in ("deviation", "darkness", "log", "dog"):
        raise ValueError(f"unknown detector {cfg.detect_method!r}")
    inside = erode(mask, cfg.erode_px)
    if not inside.any():
        return []
    if cfg.illum_norm:
        image = even_light(image, cfg.clahe_clip, cfg.clahe_grid)
    far, middle, mad = spotness(image, inside)
    if cfg.detect_method in ("log", "dog"):
        level = np.where(inside, far / (far[inside].max() + 1e-6), 0.0)
        found = [{"x": x, "y": y, "area": float(2 * np.pi * s * s), "score": float(level[int(y), int(x)])} for x, y, s in blobs(level, cfg.detect_method, cfg) if inside[int(y), int(x)]]
        return select_spots([s for s in found if s["area"] >= cfg.min_area], cfg)
    if cfg.detect_method == "deviation":
        hit = far > middle + cfg.k_mad * mad
    else:
        gray = image.astype(float).mean(axis=2)
        hit = gray < cfg.darkness * gray[inside].mean()
    labels, n = components(hit & inside)
    found = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        if len(ys) >= cfg.min_area:
            found.append({"x": float(xs.mean()), "y": float(ys.mean()), "area": float(len(ys)), "score": float(far[ys, xs].mean() / (middle + mad + 1e-6))})
    return select_spots(found, cfg)


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="edge"), k, mode="valid"), axis, a)
    return a


def _laplace(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a


# --- labels without a model ------------------------------------------------


def pseudo_label(mask: np.ndarray, head_frac: float = 0.18, cloaca_frac: float = 0.66, slices: int = 24, bins: int = 40) -> dict | None:
    """Belly band, head and cloaca of an animal's mask in shares of the frame; None for an empty mask.

    The main axis runs from the broader end (mean width of a fifth of ``bins``
    slices) as the head's tip; the cloaca lies at ``cloaca_frac`` of it, and the
    band between ``head_frac`` and there keeps the middle half across.  head_conf
    is the ends' relative difference in width, band_conf how near the band's
    share of the body is to 0.35; beyond 0.15 to 0.55 notes say band_suspect.
    """
    body = largest(mask)
    if not body.any():
        return None
    body = ~_outside(~body)
    ys, xs = np.nonzero(body)
    points = np.column_stack([xs, ys]).astype(float)
    centre = points.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((points - centre).T)) if len(points) > 1 else (None, np.eye(2))
    axis = vectors[:, -1]
    across = np.array([-axis[1], axis[0]])
    t, d = (points - centre) @ axis, (points - centre) @ across
    low, high = float(t.min()), float(t.max())
    edges = np.linspace(low, high, bins + 1)
    width = np.zeros(bins)
    for k in range(bins):
        part = d[(t >= edges[k]) & (t <= edges[k + 1])]
        width[k] = np.ptp(part) if len(part) else 0.0
    end = max(1, bins // 5)
    at_low, at_high = float(width[:end].mean()), float(width[-end:].mean())
    head, tail = (high, low) if at_high >= at_low else (low, high)
    place = lambda share: head + (tail - head) * share
    left, right = [], []
    for share in np.linspace(head_frac, cloaca_frac, slices):
        part = d[np.abs(t - place(share)) <= max((high - low) / bins, 1.0)]
        if len(part):
            a, b = np.percentile(part, [25, 75])
            left.append(centre + place(share) * axis + a * across)
            right.append(centre + place(share) * axis + b * across)
    band = np.array(left + right[::-1]).reshape(-1, 2)
    x, y = band[:, 0], band[:, 1]
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 if len(band) >= 3 else 0.0
    share = float(area / (body.sum() + 1e-6))
    h, w = mask.shape
    norm = lambda p: (float(p[0] / w), float(p[1] / h))
    return {
        "belly_polygon": [norm(p) for p in band], "head_xy": norm(centre + head * axis), "cloaca_xy": norm(centre + place(cloaca_frac) * axis),
        "head_conf": abs(at_high - at_low) / (max(at_high, at_low) + 1e-6), "band_conf": float(np.clip(1 - abs(share - 0.35) / 0.35, 0, 1)), "notes": "" if 0.15 <= share <= 0.55 else "band_suspect",
    }


def _outside(empty: np.ndarray) -> np.ndarray:
    """The part of an empty area that reaches the frame's edge; the rest are holes."""
    labels, _ = components(np.pad(empty, 1, constant_values=True), diagonal=False)
    return (labels == labels[0, 0])[1:-1, 1:-1]


def animal_score(mask: np.ndarray, gray: np.ndarray) -> float | None:
    """Centrality x elongation (1 to 6) x texture of a candidate; None if its area or border contact rules it out."""
    frac = area_frac(mask)
    edge = np.concatenate([mask[0], mask[-1], mask[:, 0], mask[:, -1]])
    if not 0.015 <= frac <= 0.55 or edge.mean() > 0.25:
        return None
    ys, xs = np.nonzero(mask)
    h, w = mask.shape
    off = np.hypot((xs.mean() - w / 2) / (w / 2), (ys.mean() - h / 2) / (h / 2))
    values = np.linalg.eigvalsh(np.cov(np.column_stack([xs, ys]).T))
    long = np.clip(np.sqrt(values[-1] / max(values[0], 1e-9)), 1, 6)
    return float(max(0.0, 1 - off / np.sqrt(2)) * long * gray[mask].std())


def pick_animal(masks: list[np.ndarray], gray: np.ndarray) -> int | None:
    scores = [animal_score(m, gray) for m in masks]
    best = [(-s, i) for i, s in enumerate(scores) if s is not None]
    return min(best)[1] if best else None


def polygon_contains(points: list, p: tuple[float, float], slack: float = 0.03) -> bool:
    """Whether a point lies in a polygon or within ``slack`` of its edge."""
    a = np.asarray(points, dtype=float)
    b = np.roll(a, -1, axis=0)
    crosses = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    if (crosses & (x > p[0])).sum() % 2:
        return True
    d = b - a
    t = np.clip(((np.array(p) - a) * d).sum(axis=1) / np.maximum((d**2).sum(axis=1), 1e-18), 0, 1)
    return bool(np.hypot(*(a + t[:, None] * d - np.array(p)).T).min() <= slack)


# --- operators over rows -----------------------------------------------------


def image_array(row) -> np.ndarray:
    """RGB of a row of Spark's image source, whose bytes are BGR."""
    data = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(data, 3, axis=2) if row["nChannels"] == 1 else data[:, :, [2, 1, 0]]


def spots_of_crops(crops: DataFrame, cfg: SpotConfig = SpotConfig()) -> DataFrame:
    """md5, image (of the image source; null: left out) -> md5, n_spots, spots."""
    ship(crops.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for img in rows["image"]:
                rgb = image_array(img)
                found.append(detect_spots(rgb, foreground(rgb), cfg))
            yield pd.DataFrame({"md5": rows["md5"], "n_spots": [len(s) for s in found], "spots": found})

    return crops.where("image IS NOT NULL").select("md5", "image").mapInPandas(run, f"md5 string, n_spots int, spots array<{SPOT}>")


def best_detection(boxes: str, conf: str = "conf") -> Column:
    """The detection of highest confidence; null of an empty array."""
    ranked = F.array_sort(F.transform(F.col(boxes), lambda b: F.struct((-b[conf]).alias("k"), b.alias("b"))))
    return F.get(ranked, F.lit(0))["b"]


def parse_pose(detection: Column) -> Column:
    """head, cloaca and the smaller of their confidences."""
    k = detection["keypoints"]
    return F.struct(F.get(k, F.lit(0)).alias("head"), F.get(k, F.lit(1)).alias("cloaca"), F.least(F.get(k, F.lit(0))["conf"], F.get(k, F.lit(1))["conf"]).alias("pose_conf"))


def parse_seg(detection: Column) -> Column:
    """polygon (null under three points) and confidence."""
    return F.struct(F.when(F.size(detection["polygon"]) >= 3, detection["polygon"]).alias("polygon"), detection["conf"].alias("seg_conf"))


def belly_consistent(labels: DataFrame, slack: float = 0.03) -> DataFrame:
    """Adds consistent: the middle of head and cloaca lies in the polygon or within ``slack`` of its edge; false without geometry."""
    ship(labels.sparkSession)

    def run(rows: pd.DataFrame) -> pd.Series:
        def one(r) -> bool:
            if r["belly_polygon"] is None or len(r["belly_polygon"]) < 3 or r["head_xy"] is None or r["cloaca_xy"] is None:
                return False
            middle = tuple((r["head_xy"][c] + r["cloaca_xy"][c]) / 2 for c in ("x", "y"))
            return polygon_contains([(q["x"], q["y"]) for q in r["belly_polygon"]], middle, slack)

        return pd.Series([one(r) for r in rows.to_dict("records")], index=rows.index, dtype=bool)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return labels.withColumn("consistent", F.pandas_udf(run, "boolean")(F.struct("belly_polygon", "head_xy", "cloaca_xy")))
