"""Arithmetic of sizes and boxes, as native column expressions.

Sizes are integers; ratios are FLOAT where a result depends on it. A quad is an array of four
struct(x, y) in the order top left, top right, bottom right, bottom left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is then evaluated once a row.

    The optimiser merges projections: a column that is named once in a lambda would be computed
    again for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _snapped(side: str, ratio: str) -> str:
    """A scaled side to the nearest multiple of 32, halves away from zero both times."""
    return f"cast(round(round(cast(cast({side} as float) * {ratio} as double)) / 32) * 32 as int)"


def resize_bounds(w: str, h: str, longest: int = 2000, shortest: int = 30) -> Column:
    """struct(w, h, ratio_w, ratio_h, error): sides at most ``longest`` and at least ``shortest``.

    An image that is still too small after shrinking is grown from its first size."""
    shrink = f"if(greatest({w}, {h}) > {longest}, cast({longest} / cast(greatest({w}, {h}) as float) as float), cast(1 as float))"
    grow = f"if(least({w}, {h}) < {shortest}, cast({shortest} / cast(least({w}, {h}) as float) as float), cast(1 as float))"
    first = f"if(greatest({w}, {h}) > {longest}, named_struct('w', {_snapped(w, shrink)}, 'h', {_snapped(h, shrink)}), named_struct('w', cast({w} as int), 'h', cast({h} as int)))"
    second = f"if(least(a.w, a.h) < {shortest}, named_struct('w', {_snapped(w, grow)}, 'h', {_snapped(h, grow)}), a)"
    bad = "least(a.w, a.h, b.w, b.h) <= 0"
    out = f"""named_struct('w', if({bad}, null, b.w), 'h', if({bad}, null, b.h),
        'ratio_w', if({bad}, null, cast(cast({w} as float) / b.w as float)), 'ratio_h', if({bad}, null, cast(cast({h} as float) / b.h as float)), 'error', if({bad}, 'a side becomes 0', null))"""
    return F.expr(bound(first, "a", bound(second, "b", out)))


def vertical_padding(w: str, h: str, ratio: float = 8.0, least_height: int = 30) -> Column:
    """Rows of padding at the top and as many at the bottom; a ratio of -1 doesn't ask for any."""
    wide = f"cast({w} / cast({h} as float) as float) > {ratio}F" if ratio != -1 else "false"
    height = f"cast(greatest(cast({w} / {ratio}F as float), {least_height}F) * 2 as int)"
    return F.expr(f"if({h} <= {least_height} or {wide}, cast(abs({height} - {h}) / 2D as int), 0)")


def limit_resize(w: str, h: str, limit_type: str = "min", limit: int = 736) -> Column:
    """struct(w, h) of the detector's input: multiples of 32, halves to even."""
    if limit_type == "min":
        ratio = f"if(least({w}, {h}) < {limit}, cast({limit} as double) / least({w}, {h}), 1D)"
    else:
        bound = f"case when greatest({w}, {h}) < 960 then 960 when greatest({w}, {h}) < 1500 then 1500 else 2000 end"
        ratio = f"if(greatest({w}, {h}) > {bound}, cast({bound} as double) / greatest({w}, {h}), 1D)"
    side = lambda x: f"cast(bround(cast({x} * {ratio} as int) / 32D, 0) * 32 as int)"
    return F.expr(f"named_struct('w', {side(w)}, 'h', {side(h)})")


def wh_ratio(w: str, h: str) -> str:
    """Width over height as FLOAT, in SQL."""
    return f"cast(cast({w} as float) / cast({h} as float) as float)"


def class_width(w: str, h: str, height: int, most: int) -> Column:
    """Width of a line scaled to the orientation model's height, at most its width."""
    return F.expr(f"least(cast(ceil({height}F * {wh_ratio(w, h)}) as int), {most})")


def line_width(ratio: str, batch_ratio: str, height: int = 48, width: int = 320) -> Column:
    """struct(img_width, resized_width): the batch's tensor width and the line's own."""
    own = f"greatest(cast({width} / {height}F as float), {ratio})"
    return F.expr(f"named_struct('img_width', cast(bround(cast({height}F * {batch_ratio} as double), 0) as int), 'resized_width', least(cast(ceil({height}F * {ratio}) as int), cast(bround(cast({height}F * {own} as double), 0) as int)))")


def quad(x0: str, y0: str, x1: str, y1: str) -> Column:
    """An upright quad."""
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    return F.expr(f"array({p(x0, y0)}, {p(x1, y0)}, {p(x1, y1)}, {p(x0, y1)})")


def distance(box: str, i: int, j: int) -> str:
    """SQL for the distance of two corners."""
    return f"sqrt(({box}[{i}].x - {box}[{j}].x) * ({box}[{i}].x - {box}[{j}].x) + ({box}[{i}].y - {box}[{j}].y) * ({box}[{i}].y - {box}[{j}].y))"


def box_size(box: str) -> Column:
    """struct(width, height); null unless there are four corners."""
    return F.expr(bound(box, "q_", f"if(size(q_) = 4, named_struct('width', {distance('q_', 0, 1)}, 'height', {distance('q_', 0, 3)}), null)"))


def normalize_box(box: str, w: str, h: str, to_w: str, to_h: str) -> Column:
    """Scaled corners, halves to even, held within the target."""
    place = lambda v, size, to: f"cast(greatest(0D, least(cast({to} as double), bround(cast({v} as double) / {size} * {to}, 0))) as float)"
    return F.expr(f"transform({box}, p -> named_struct('x', {place('p.x', w, to_w)}, 'y', {place('p.y', h, to_h)}))")


def clip_box(box: str, w: str, h: str) -> Column:
    """Corners held within an image."""
    return F.expr(f"transform({box}, p -> named_struct('x', greatest(0, least({w} - 1, p.x)), 'y', greatest(0, least({h} - 1, p.y))))")


def large_enough(box: str, side: float = 3) -> Column:
    """Whether both sides exceed ``side``."""
    return F.expr(bound(box, "q_", f"{distance('q_', 0, 1)} > {side} and {distance('q_', 0, 3)} > {side}"))


def map_to_original(box: str, pad_left: str, pad_top: str, ratio_w: str, ratio_h: str, w: str, h: str) -> Column:
    """Corners in the page's own coordinates."""
    return F.expr(f"transform({box}, p -> named_struct('x', greatest(0, least({w}, (p.x - {pad_left}) * {ratio_w})), 'y', greatest(0, least({h}, (p.y - {pad_top}) * {ratio_h}))))")


def unclip(box: str, ratio: float = 1.6) -> Column:
    """A rectangle grown on all sides by area * ratio / perimeter: what growing with round corners
    and taking the least rectangle around comes to, with its corners sorted again. Null for a rectangle
    without area."""
    sides = f"named_struct('w', {distance('q_', 0, 1)}, 'h', {distance('q_', 0, 3)})"
    corner = lambda i, u, v: ", ".join(
        f"'{c}', q_[{i}].{c} + {u} * d_ * (q_[1].{c} - q_[0].{c}) / s_.w + {v} * d_ * (q_[3].{c} - q_[0].{c}) / s_.h" for c in "xy")
    corners = ", ".join(f"named_struct({corner(i, u, v)})" for i, (u, v) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))
    grown = bound(f"s_.w * s_.h * {ratio} / (2 * (s_.w + s_.h))", "d_", f"array({corners})")
    return F.expr(bound(box, "q_", bound(sides, "s_", f"if(s_.w > 0 and s_.h > 0, {sort_corners_sql(grown)}, null)")))


def sort_corners_sql(corners: str) -> str:
    """Top left, top right, bottom right, bottom left: the two leftmost and the two rightmost, each by y."""
    by = lambda c, of: f"transform(array_sort(transform({of}, (g_, i_) -> named_struct('by', g_.{c}, 'i', i_, 'p', g_))), g_ -> g_.p)"
    left, right = by("y", "slice(h_, 1, 2)"), by("y", "slice(h_, 3, 2)")
    pairs = bound(f"named_struct('l', {left}, 'r', {right})", "lr_", "array(lr_.l[0], lr_.r[0], lr_.r[1], lr_.l[1])")
    return bound(by("x", corners), "h_", pairs)


def bounding_rect(points: str) -> Column:
    """struct(x_min, y_min, x_max, y_max) of an array of points."""
    return F.expr(bound(points, "q_", "named_struct(" + ", ".join(f"'{c}_{m}', array_{m}(transform(q_, p -> p.{c}))" for m in ("min", "max") for c in "xy") + ")"))


def direction(box: str) -> Column:
    """VERTICAL if a box without width, or at least half as high again as wide (to two places), else HORIZONTAL."""
    wide, high = (f"greatest({distance('q_', *a)}, {distance('q_', *b)})" for a, b in (((0, 1), (2, 3)), ((1, 2), (3, 0))))
    turn = "case when s_.w < 1e-6D then 'VERTICAL' when bround(s_.h / s_.w, 2) >= 1.5D then 'VERTICAL' else 'HORIZONTAL' end"
    return F.expr(bound(box, "q_", bound(f"named_struct('w', {wide}, 'h', {high})", "s_", turn)))


def order_points(points: str) -> Column:
    """The four corners in quad order, as ``order_points_sql`` says."""
    return F.expr(order_points_sql(points))


def order_points_sql(points: str) -> str:
    """The four corners in quad order; an element is null where a degenerate quad leaves it open.

    A diamond (corners level with and above the centre) goes left, top, right, bottom; points on one
    vertical line go by y; else the points are halved by y if some are above the centre and none is
    level with it, and by x if not."""
    mid = ", ".join(f"'{c}', aggregate(p_, 0D, (sum_, at_) -> sum_ + at_.{c}) / 4D" for c in "xy")
    halves = ", ".join(f"'{name}', filter(p_, at_ -> at_.{c} {op} m_.{c})" for name, c, op in (("upper", "y", "<"), ("lower", "y", ">"), ("left", "x", "<"), ("right", "x", ">")))

    def pick(of: str, c: str, m: str) -> str:
        return f"get(filter({of}, at_ -> at_.{c} = array_{m}(transform({of}, of_ -> of_.{c}))), 0)"

    diamond = [pick("p_", "x", "min"), pick("p_", "y", "min"), pick("p_", "x", "max"), pick("p_", "y", "max")]
    by_y = [pick("h_.upper", "x", "min"), pick("h_.upper", "x", "max"), pick("h_.lower", "x", "max"), pick("h_.lower", "x", "min")]
    by_x = [pick("h_.left", "y", "min"), pick("h_.right", "y", "min"), pick("h_.right", "y", "max"), pick("h_.left", "y", "max")]
    line = "transform(array_sort(transform(p_, (at_, i_) -> named_struct('y', at_.y, 'i', i_, 'at', at_))), of_ -> of_.at)"
    on_x, on_y = (f"exists(p_, at_ -> at_.{c} = m_.{c})" for c in "xy")
    choice = f"""case when {on_x} and {on_y} then array({', '.join(diamond)}) when forall(p_, at_ -> at_.x = m_.x) then {line}
        when {on_x} and not {on_y} then array({', '.join(by_y)}) else array({', '.join(by_x)}) end"""
    return bound(points, "p_", bound(f"named_struct({mid})", "m_", bound(f"named_struct({halves})", "h_", choice)))
