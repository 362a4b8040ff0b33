"""Kernels on pixels and probability maps, in NumPy: what column expressions can't say.

Images are uint8 arrays (height, width, 3) in the order blue, green, red.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from ..config import Detector

#: Fixed value: the sharpness of bicubic interpolation that image libraries use.
CUBIC_A = -0.75


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear scaling with pixel centres at halves."""
    def axis(size: int, to: int):
        at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(size - 2, 0))
        return low, np.minimum(low + 1, size - 1), at - low

    if image.shape[:2] == (height, width):
        return image
    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    rows = image.astype(np.float32)
    rows = rows[y0] * (1 - fy)[:, None, None] + rows[y1] * fy[:, None, None]
    # the channels of a pixel lie side by side: weights of the same length let rows be gone through at once
    left, right = (np.repeat(w, image.shape[2]) for w in (1 - fx, fx))
    out = rows.take(x0, axis=1).reshape(height, -1) * left + rows.take(x1, axis=1).reshape(height, -1) * right
    return np.minimum(np.maximum(np.rint(out), 0), 255).astype(np.uint8).reshape(height, width, -1)


def pad_rows(image: np.ndarray, rows: int) -> np.ndarray:
    """Black rows above and below."""
    return np.pad(image, ((rows, rows), (0, 0), (0, 0))) if rows else image


def planar(image: np.ndarray, mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0)) -> np.ndarray:
    """(3, height, width) floats, red first: (x / 255 - mean) / std."""
    x = np.ascontiguousarray(image[:, :, ::-1].transpose(2, 0, 1)).astype(np.float32) / np.float32(255)
    if any(mean):
        x -= np.asarray(mean, np.float32)[:, None, None]
    return x if set(std) == {1.0} else x / np.asarray(std, np.float32)[:, None, None]


def line_tensor(image: np.ndarray, height: int, resized: int, width: int) -> np.ndarray:
    """A line's tensor from -1 to 1, with zeros to the right of it."""
    out = np.zeros((3, height, width), np.float32)
    out[:, :, :resized] = planar(resize(image, resized, height)) * 2 - 1
    return out


def colour(data: bytes, height: int, width: int) -> np.ndarray:
    """The bytes of an image of one, three or four channels as three channels: grey is repeated, alpha left out."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, -1)
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, :3]


def best_class(scores: np.ndarray, axis: int) -> np.ndarray:
    """The first largest of the scores; those that are no numbers don't count, and the first stands for none."""
    return np.where(np.isnan(scores), -np.inf, scores).argmax(axis=axis)


def turn_half(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image[::-1, ::-1])


def threshold(prob: np.ndarray, least: float) -> np.ndarray:
    return prob > least


def dilate(mask: np.ndarray) -> np.ndarray:
    """By a square of two: a pixel is set if it, the one to the left, or one above them is."""
    out = mask.copy()
    out[:, 1:] |= mask[:, :-1]
    out[1:] |= out[:-1].copy()
    return out


def label(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Components numbered from 1 by their first pixel in row order; 0 elsewhere. ``corners`` joins diagonals.

    Row runs are joined with those of the row above that they touch, by union and find."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    edges = wide[:, 1:] - wide[:, :-1]
    r0, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    parent = list(range(len(start)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # ends of runs as places in rows with a gap of two between them; for each run, the first and last it touches above
    reach, row = 1 if corners else 0, r0 * (w + 2)
    above = row - (w + 2)
    low, high = np.searchsorted(row + stop, above + start - reach, side="right").tolist(), np.searchsorted(row + start, above + stop + reach).tolist()
    for j, (i, end) in enumerate(zip(low, high)):
        for k in range(i, end):
            a, b = find(k), find(j)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    roots = np.array([find(i) for i in range(len(parent))], int)
    number = np.cumsum(roots == np.arange(len(roots)))
    out = np.zeros((h, w), np.int32)
    out[mask] = np.repeat(number[roots], stop - start)
    return out


def contours(mask: np.ndarray, most: int | None = None) -> list[tuple[np.ndarray, tuple[int, int, np.ndarray]]]:
    """(points, (top, left, region)) of each outer border and each hole's border, by first pixel, ``most`` at most.

    Points are (x, y) of border pixels; a region is what the border encloses, itself included, as a mask
    of its own rectangle and no larger."""
    found, h, w = [], *mask.shape
    whole = np.zeros((h + 2, w + 2), bool)
    whole[1:-1, 1:-1] = mask

    def placed(y: int, x: int, region: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Without the margin of the padded mask, where the rectangle holds a part of it."""
        top, left = max(y - 1, 0), max(x - 1, 0)
        return top, left, region[top - (y - 1) : h - (y - 1), left - (x - 1) : w - (x - 1)]

    outside, numbers = label(~whole, corners=False), label(whole)
    # each part is looked at within its own rectangle and a margin
    for y, x, own in _parts(numbers, 0):
        region = own
        if (outside[y : y + own.shape[0], x : x + own.shape[1]] > outside[0, 0]).any():  # there may be holes
            around = label(~own, corners=False)
            region = around != around[0, 0]
        ys, xs = np.nonzero(own)
        found.append(((ys[0] + y, xs[0] + x, 0), np.stack([xs + x - 1, ys + y - 1], 1), placed(y, x, region)))
    for y, x, hole in _parts(outside, outside[0, 0]):
        beside = hole.copy()
        beside[1:] |= hole[:-1]
        beside[:-1] |= hole[1:]
        beside[:, 1:] |= hole[:, :-1]
        beside[:, :-1] |= hole[:, 1:]
        ys, xs = np.nonzero(beside & ~hole)
        found.append(((ys[0] + y, xs[0] + x, 1), np.stack([xs + x - 1, ys + y - 1], 1), placed(y, x, beside)))
    return [(p, r) for _, p, r in sorted(found, key=lambda f: f[0])[:most]]


def _parts(numbers: np.ndarray, but: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(top, left, mask) of each number except 0 and ``but``, in its rectangle with a margin of one."""
    ys, xs = np.nonzero((numbers > 0) & (numbers != but))
    n = numbers[ys, xs]
    order = np.argsort(n, kind="stable")
    ys, xs, n = ys[order], xs[order], n[order]
    cut = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else []
    for a, b in zip(cut, [*cut[1:], len(n)]):
        y0, y1, x0, x1 = ys[a] - 1, ys[b - 1] + 2, xs[a:b].min() - 1, xs[a:b].max() + 2
        yield y0, x0, numbers[y0:y1, x0:x1] == n[a]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in order, by the monotone chain.

    Of whole numbers, for which it is exact, only the outermost of each row and then of each column are looked at."""
    if points.dtype.kind in "iu":
        lower, upper = _outermost(points)
    else:
        lower = np.unique(points.astype(float), axis=0).tolist()
        upper = lower
    if len(lower) < 3 and lower == upper:
        return np.array(lower, float).reshape(-1, 2)

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    # each chain begins where the other ends, unless the points of the first or last column differ
    down, up = chain(lower), chain(upper[::-1])
    return np.array([*down[: len(down) - (down[-1] == up[0])], *up[: len(up) - (up[-1] == down[0])]], float)


def _outermost(points: np.ndarray) -> tuple[list, list]:
    """The lowest and the highest point of each column, of those first or last in their rows, by column."""
    key = points[:, 1] * (np.int64(1) << 32) + points[:, 0]
    if (key[1:] <= key[:-1]).any():
        points = points[np.argsort(key, kind="stable")]
    new = points[1:, 1] != points[:-1, 1]
    low, high = {}, {}
    ends = np.ones(len(points), bool)
    ends[1:-1] = new[1:] | new[:-1]
    for x, y in points[ends].tolist():  # y doesn't fall
        low.setdefault(x, y)
        high[x] = y
    return [[x, low[x]] for x in sorted(low)], [[x, high[x]] for x in sorted(high)]


def sort_corners(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: the two leftmost and the two rightmost, each by y."""
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = (pair[np.argsort(pair[:, 1], kind="stable")] for pair in (by_x[:2], by_x[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(corners in quad order, short side) of the least rectangle around points; a side lies on the hull."""
    around = hull(points)
    if len(around) == 1:
        return np.repeat(around, 4, axis=0), 0.0
    edge = np.concatenate([around[1:], around[:1]]) - around
    length = np.hypot(*edge.T)
    u = (edge / length[:, None] if length.all() else edge[length > 0] / length[length > 0][:, None])
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = u @ around.T, v @ around.T
    best = int(np.argmin((a.max(axis=1) - a.min(axis=1)) * (b.max(axis=1) - b.min(axis=1))))
    a, b, u, v = a[best], b[best], u[best], v[best]
    corners = np.array([x * u + y * v for x, y in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return sort_corners(corners), float(min(np.ptp(a), np.ptp(b)))


def fill(box: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centre is in or on a convex quad, which may be a line or a point."""
    ys, xs = np.arange(shape[0])[:, None], np.arange(shape[1])[None]
    edge = box[[1, 2, 3, 0]] - box
    side = np.stack([dx * (ys - y) - dy * (xs - x) for (x, y), (dx, dy) in zip(box, edge)])
    (x0, y0), (x1, y1) = box.min(axis=0) - 1e-9, box.max(axis=0) + 1e-9
    near = (xs >= x0) & (xs <= x1) & (ys >= y0) & (ys <= y1)
    return near & ((side.min(axis=0) >= -1e-9) | (side.max(axis=0) <= 1e-9))


def score_fast(prob: np.ndarray, box: np.ndarray) -> float:
    """Mean probability inside a box; only its bounding rectangle is looked at."""
    h, w = prob.shape
    (x0, y0), (x1, y1) = ([int(min(max(v, 0), n - 1)) for v, n in zip(ends, (w, h))] for ends in (np.floor(box.min(axis=0)).tolist(), np.ceil(box.max(axis=0)).tolist()))
    part = prob[y0 : y1 + 1, x0 : x1 + 1]
    corners = np.rint(box - (x0, y0))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners.tolist()
    if ax == dx <= bx == cx and ay == by <= cy == dy:  # upright: a part of the rows and columns
        inside = part[max(int(ay), 0) : max(int(cy) + 1, 0), max(int(ax), 0) : max(int(bx) + 1, 0)].ravel()
    else:
        inside = part[fill(corners, part.shape)]
    return float(inside.mean()) if inside.size else 0.0


def score_slow(prob: np.ndarray, region: np.ndarray) -> float:
    """Mean probability in what a contour encloses."""
    return float(prob[region].mean())


def unclip(box: np.ndarray, ratio: float) -> np.ndarray | None:
    """A rectangle grown on each side by area * ratio / perimeter, its corners sorted again."""
    u, v = box[1] - box[0], box[3] - box[0]
    w, h = np.hypot(*u), np.hypot(*v)
    if not w or not h:
        return None
    d = w * h * ratio / (2 * (w + h))
    u, v = u / w * d, v / h * d
    return sort_corners(box + np.array([-u - v, u - v, u + v, v - u]))


def boxes_of(prob: np.ndarray, width: int, height: int, config: Detector) -> list[tuple[np.ndarray, float]]:
    """(box in image coordinates, score) of the text in a probability map; cheap tests come first."""
    mask = threshold(prob, config.thresh)
    if config.use_dilation:
        mask = dilate(mask)
    out = []
    for points, (top, left, region) in contours(mask, config.max_candidates):
        box, side = min_area_rect(points)
        if side < config.min_side:
            continue
        score = score_fast(prob, box) if config.score_mode == "fast" else score_slow(prob[top : top + region.shape[0], left : left + region.shape[1]], region)
        if score < config.box_thresh:
            continue
        grown = unclip(box, config.unclip_ratio)
        if grown is None or min(np.hypot(*(grown[1] - grown[0])), np.hypot(*(grown[3] - grown[0]))) < config.min_side + 2:
            continue
        size = np.array([width, height], float)
        placed = np.minimum(np.maximum(np.rint(grown / np.array(prob.shape[::-1]) * size), 0), size - 1)
        if min(np.hypot(*(placed[1] - placed[0])), np.hypot(*(placed[3] - placed[0]))) > config.min_side:
            out.append((placed, score))
    return out


def in_reading_order(found: list[tuple[np.ndarray, float]], gap: float) -> list[tuple[np.ndarray, float, int]]:
    """Boxes of one image with their lines, as layout.reading_order has them."""
    by_y = sorted(found, key=lambda f: (f[0][0, 1], f[0][0, 0]))
    lines, line = [], 0
    for i, (box, score) in enumerate(by_y):
        line += i > 0 and box[0, 1] - by_y[i - 1][0][0, 1] >= gap
        lines.append((box, score, int(line)))
    return sorted(lines, key=lambda f: (f[2], f[0][0, 0], f[0][0, 1]))


def at_page_scale(crop: np.ndarray, ratio_h: float, ratio_w: float) -> np.ndarray:
    """A crop of the detector's image in the size it has on the page, halves to even, one pixel at least."""
    height, width = (max(int(np.rint(n * r)), 1) for n, r in zip(crop.shape, (ratio_h, ratio_w)))
    return resize(crop, width, height)


def perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four pixels around a place, at fraction t after the second, a row for each."""
    near, far = np.stack([t, 1 - t]), np.stack([t + 1, 2 - t])
    near = ((CUBIC_A + 2) * near - (CUBIC_A + 3)) * near * near + 1
    far = ((CUBIC_A * far - 5 * CUBIC_A) * far + 8 * CUBIC_A) * far - 4 * CUBIC_A
    return np.stack([far[0], near[0], near[1], far[1]])


def _bicubic(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, channels) of an image at n places."""
    near = np.array([-1, 0, 1, 2])[:, None]
    left, top = np.floor(x), np.floor(y)
    cols, rows = (np.minimum(np.maximum(c.astype(int) + near, 0), n - 1) for c, n in ((left, image.shape[1]), (top, image.shape[0])))
    # a plane for each channel, of the rows that count: NumPy goes along the places, not along three channels
    y0, y1 = int(rows.min()), int(rows.max()) + 1
    planes = np.ascontiguousarray(image[y0:y1].transpose(2, 0, 1)).reshape(image.shape[2], -1)
    rows = (rows - y0) * image.shape[1]
    out = np.empty((x.size, image.shape[2]), np.uint8)
    for at in range(0, x.size, 4096):
        part = slice(at, at + 4096)
        at_16 = (rows[:, None, part] + cols[None, :, part]).reshape(16, -1)
        weights = (_cubic(y[part] - top[part])[:, None] * _cubic(x[part] - left[part])[None]).reshape(16, -1)
        for c, plane in enumerate(planes):  # summed in the order of the pixels
            out[part, c] = np.minimum(np.maximum(np.rint((weights * plane.take(at_16)).sum(axis=0)), 0), 255)
    return out


def crop_quad(image: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A quad as an upright image, bicubic, edges replicated; one that is half as high again as wide is turned clockwise."""
    side = lambda i, j: np.hypot(*(box[i] - box[j]))
    w, h = max(side(0, 1), side(2, 3)), max(side(0, 3), side(1, 2))
    width, height = max(int(w), 1), max(int(h), 1)
    back = np.linalg.inv(perspective(box, np.array([[0, 0], [w, 0], [w, h], [0, h]])))
    places = np.ones((3, height, width))
    places[0], places[1] = np.arange(width), np.arange(height)[:, None]
    x, y, z = back @ places.reshape(3, -1)
    x, y = x / z, y / z
    crop = _bicubic(image, x, y).reshape(height, width, -1)
    return np.ascontiguousarray(np.rot90(crop, -1)) if height / width >= 1.5 else crop


def to_page(box: np.ndarray, cells: np.ndarray, vertical: bool) -> np.ndarray:
    """Cells (n, 4, 2) of a crop in the page's coordinates, truncated to whole pixels."""
    low = box.min(axis=0)
    src = box - low
    w, h = np.hypot(*(src[0] - src[1])), np.hypot(*(src[0] - src[3]))
    back = np.linalg.inv(perspective(src, np.array([[0, 0], [w, 0], [w, h], [0, h]])))
    flat = cells.reshape(-1, 2)
    if vertical:  # a turn by -90 degrees about the origin, then to the right by the width
        flat = np.stack([w - flat[:, 1], flat[:, 0]], axis=1)
    x, y, z = back @ np.column_stack([flat, np.ones(len(flat))]).T
    return np.trunc(np.stack([x / z, y / z], axis=1) + low).reshape(cells.shape)


def with_alpha(image: np.ndarray) -> np.ndarray:
    """A fourth, opaque channel."""
    return np.dstack([image, np.full(image.shape[:2], 255, np.uint8)])


def draw(image: np.ndarray, boxes: list[tuple[np.ndarray, float]], least: float) -> np.ndarray:
    """The image with boxes of a sufficient score blended in, and beside it a panel with their outlines.

    Colours depend on a box's place in the list. Letters are not drawn: no font is bundled."""
    left, panel = image.astype(float), np.full(image.shape, 255.0)
    for i, (box, score) in enumerate(boxes):
        if score < least:
            continue
        colour = np.frombuffer(zlib.crc32(str(i).encode()).to_bytes(4, "big")[:3], np.uint8).astype(float)
        inside = fill(box, image.shape[:2])
        left[inside] = (left[inside] + colour) / 2
        core = inside.copy()
        core[1:-1, 1:-1] &= inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:]
        panel[inside & ~core] = colour
    return np.concatenate([left, panel], axis=1).round().astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """An image as a PNG file."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image[:, :, 2::-1].reshape(h, -1)], axis=1)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
