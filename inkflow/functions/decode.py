"""Decoding of class and sequence scores, as native column expressions.

Every function takes SQL for its input and gives a Column (or SQL, for ``*_sql``), so a plan stays
inside whole-stage code generation. Ties go to the first class; NaN scores are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import bound


def best_sql(scores: str) -> str:
    """struct(i, v): place and value of the first greatest score; (0, null) if there is none."""
    top = f"array_max(filter({scores}, x -> not isnan(x)))"
    return f"named_struct('i', cast(coalesce(array_position({scores}, {top}), 1) - 1 as int), 'v', {top})"


def steps_of(flat: str, classes: int) -> str:
    """A flat array of scores as an array of steps of ``classes`` scores."""
    return f"transform(sequence(1, greatest(size({flat}) div {classes}, 1)), t -> slice({flat}, (t - 1) * {classes} + 1, {classes}))"


def argmax_steps(probs: str) -> Column:
    """Array of struct(i, v), one for each step of ``probs``."""
    return F.expr(f"transform({probs}, r -> {best_sql('r')})")


def kept_steps(best: str) -> Column:
    """Steps that start a run of one class other than the blank, class 0."""
    first = "t = 0 or b[t].i <> b[greatest(t - 1, 0)].i"
    return F.expr(bound(best, "b", f"if(size(b) > 0, filter(sequence(0, greatest(size(b), 1) - 1), t -> ({first}) and b[t].i <> 0), cast(array() as array<int>))"))


def chars(best: str, kept: str, alphabet: str) -> Column:
    """The kept steps' entries of the alphabet, one for each step."""
    return F.expr(bound(f"named_struct('a', {alphabet}, 'b', {best})", "v", f"transform({kept}, t -> v.a[v.b[t].i])"))


def confidences(best: str, kept: str) -> Column:
    """Scores of the kept steps to five places, halves to even; a single 0 if none is kept."""
    return F.expr(bound(f"named_struct('k', {kept}, 'b', {best})", "v", "if(size(v.k) > 0, transform(v.k, t -> bround(cast(v.b[t].v as double), 5)), array(0D))"))


def mean_score(confs: str) -> Column:
    """The mean of the confidences to five places."""
    return F.expr(bound(confs, "v", "bround(aggregate(v, 0D, (a, x) -> a + x, a -> a / size(v)), 5)"))


def line_length(steps: str, wh_ratio: str, max_wh_ratio: str) -> Column:
    """Steps that the line takes of those padded to the batch's width."""
    return F.expr(f"cast({steps} * {wh_ratio} / {max_wh_ratio} as float)")


def class_label(scores: str, labels: tuple[str, ...]) -> Column:
    """struct(label, score) of the best class."""
    names = f"array({', '.join(repr(x) for x in labels)})"
    return F.expr(f"named_struct('label', {names}[{best_sql(scores)}.i], 'score', {best_sql(scores)}.v)")


def turned(label: str, score: str, threshold: float) -> Column:
    """Whether a line is upside down: the score must exceed the threshold."""
    return F.expr(f"coalesce({label} = '180' and {score} > {threshold}, false)")
