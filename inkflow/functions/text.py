"""Character classes and word boxes, as native column expressions over arrays: no explode, no shuffle.

A line has ``chars`` (one entry for each kept step), ``cols`` (the steps) and ``confs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import bound

#: Ranges of CJK ideographs, CJK punctuation and full-width forms.
CJK = r"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"
#: White space as Unicode's Zs, Zl and Zp with the controls 9-13 and 85.
SPACE = r"[\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Extensions of image files that are read.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp")
GAP = 5


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def has_cjk(text: str, pattern: str = CJK) -> Column:
    """Whether any character is of the class; false for null."""
    return F.expr(f"coalesce({text} rlike {_lit(pattern)}, false)")


def extension(path: str) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.expr(f"lower(regexp_extract({path}, {_lit(r'(\.[^./\\]*)$')}, 1))")


def is_image(path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    """Whether a path has the extension of an image."""
    return extension(path).isin(*extensions)


def segment_words(chars: str, cols: str, confs: str, pattern: str = CJK, fields: tuple[str, ...] = ("words", "cols", "type", "confs")) -> Column:
    """Array of struct(words, cols, type, confs), or of some of its fields: runs of one class (CN, EN_NUM) without
    white space. A word also ends where the step before is more than ``GAP`` steps away. Null without columns."""
    # 0 for white space, 1 and 2 for the classes: white space is cut into runs like words, and left out then.
    # No slice() of the line: it goes through the whole of it for every word.
    kinds = f"transform({chars}, c -> if(c rlike {_lit('^' + SPACE)}, 0, if(c rlike {_lit(pattern)}, 1, 2)))"
    line = f"named_struct('chars', {chars}, 'cols', {cols}, 'confs', {confs}, 'kind', {kinds})"
    begins = bound("v.kind", "kind", bound("v.cols", "cols", f"filter(sequence(0, greatest(size(kind), 1) - 1), i -> i = 0 or kind[i] <> kind[i - 1] or cols[i] - cols[i - 1] > {GAP})"))
    runs = bound(begins, "begins", "transform(begins, (b, n) -> named_struct('first', b, 'last', if(n < size(begins) - 1, begins[least(n + 1, size(begins) - 1)], size(v.kind)) - 1, 'kind', get(v.kind, b)))")
    each = lambda of: bound(f"v.{of}", "all", "transform(sequence(r.first, r.last), i -> all[i])")
    values = {"words": each("chars"), "cols": each("cols"), "type": "if(r.kind = 1, 'CN', 'EN_NUM')", "confs": each("confs")}
    word = ", ".join(f"'{f}', {values[f]}" for f in fields)
    return F.expr(bound(line, "v", f"if(coalesce(size(v.cols), 0) <= 0, null, transform(filter({runs}, r -> r.kind > 0), r -> named_struct({word})))"))


def has_words(text: str) -> Column:
    """Whether a text has anything but white space, and so a word; false for null."""
    return F.expr(f"coalesce({text} rlike {_lit('[^' + SPACE[1:])}, false)")


def average_width(words: str, column_width: str, box_width: str, length: str) -> Column:
    """Mean character width over the words of two characters or more, else the box over its characters."""
    given = f"named_struct('long', filter({words}, w -> size(w.cols) > 1), 'cell', {column_width})"
    mean = "aggregate(v.long, 0D, (a, w) -> a + (element_at(w.cols, -1) - w.cols[0]) * v.cell / (size(w.cols) - 1), a -> a / size(v.long))"
    return F.expr(bound(given, "v", f"case when {length} = 0 then 0D when size(v.long) > 0 then {mean} else {box_width} / cast({length} as double) end"))


def cell_sql(col: str, average: str, column_width: str, x0: str, x1: str) -> str:
    """struct(left, right) of a character's cell, held within the box."""
    edge = lambda sign: f"cast(({col} + 0.5D) * {column_width} {sign} {average} / 2 as int)"
    return f"named_struct('left', cast(greatest({edge('-')}, 0) + {x0} as double), 'right', cast(least(cast({edge('+')} as double), {x1} - {x0}) + {x0} as double))"


def boxes(words: str, average: str, column_width: str, x0: str, x1: str, single: bool = False) -> Column:
    """Array of struct(left, right, word, conf): one for each word of a line of EN_NUM words only,
    one for each character (left to right) of others and with ``single``."""
    given = f"named_struct('words', {words}, 'mean', {average}, 'cell', {column_width}, 'x0', {x0}, 'x1', {x1})"
    cell = lambda c: cell_sql(c, "v.mean", "v.cell", "v.x0", "v.x1")
    side = lambda f, s: f"array_{f}(transform(w.cols, c -> {cell('c')}.{s}))"
    by_word = f"transform(v.words, w -> named_struct('left', {side('min', 'left')}, 'right', {side('max', 'right')}, 'word', array_join(w.words, ''), 'conf', aggregate(w.confs, 0D, (a, x) -> a + x, a -> a / size(w.confs))))"
    each = f"flatten(transform(v.words, w -> transform(w.cols, (c, i) -> named_struct('cell', {cell('c')}, 'word', w.words[i], 'conf', cast(w.confs[i] as double)))))"
    sort = f"sort_array(transform({each}, (e, i) -> named_struct('left', e.cell.left, 'i', i, 'e', e)))"
    by_char = f"transform({sort}, s -> named_struct('left', s.e.cell.left, 'right', s.e.cell.right, 'word', s.e.word, 'conf', s.e.conf))"
    return F.expr(bound(given, "v", by_char if single else f"if(forall(v.words, w -> w.type = 'EN_NUM'), {by_word}, {by_char})"))
