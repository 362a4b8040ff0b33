"""Words of lines: against a loop over the steps, found once for a line and dealt over all cores."""

import re

import numpy as np
import pytest

from inkflow.functions import text
from inkflow.plans import queries

SF = "/root/testdata/sf0.001"


def by_steps(chars, cols):
    """Words by going through the steps."""
    out, before = [], None
    for i, c in enumerate(chars):
        if re.match(text.SPACE, c):
            continue
        kind = "CN" if re.search(text.CJK, c) else "EN_NUM"
        if before is None or i - before > 1 or kind != out[-1][1] or cols[i] - cols[i - 1] > text.GAP:
            out.append(([], kind, []))
        out[-1][0].append(c)
        out[-1][2].append(cols[i])
        before = i
    return [("".join(w), kind, k) for w, kind, k in out]


def test_words_are_those_of_a_loop(spark):
    rng = np.random.default_rng(6)
    lines = []
    for n in range(200):
        chars = [str(x) for x in rng.choice(["a", "1", "我", "！", " ", "　", "\x85", "ab", " x", "x我", "𝄞", ""], rng.integers(1, 30))]
        lines.append((n, chars, [int(x) for x in np.cumsum(rng.choice([1, 2, 5, 6, 9], len(chars), p=[0.6, 0.1, 0.1, 0.1, 0.1]))], [float(i) for i in range(len(chars))]))
    lines.append((200, ["a"], [], []))
    rows = spark.createDataFrame(lines, "n int, chars array<string>, cols array<int>, confs array<double>")
    rows = rows.withColumns({"words": text.segment_words("chars", "cols", "confs"), "spans": text.segment_words("chars", "cols", "null", fields=("cols",))})
    for r in rows.collect():
        if not r.cols:
            assert r.words is None and r.spans is None
            continue
        want = by_steps(r.chars, r.cols)
        assert [("".join(w.words), w.type, w.cols) for w in r.words] == want and [w.cols for w in r.spans] == [k for _, _, k in want]
        assert [c for w in r.words for c in w.confs] == [float(i) for i, c in enumerate(r.chars) if not re.match(text.SPACE, c)]


def test_lines_with_words(spark):
    for value, has in (("'a'", True), ("' 　 '", False), ("''", False), ("' 我'", True), ("null", False)):
        assert spark.range(1).select(text.has_words(f"cast({value} as string)").alias("x")).first().x is has


@pytest.mark.parametrize("name", ["avg_char_width", "word_segment", "char_cell", "en_num_box"])
def test_words_are_found_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(queries._LETTER) == 1 and "RepartitionByExpression [conv_id" in plan
