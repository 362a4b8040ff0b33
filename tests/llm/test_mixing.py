"""The mix against a sequential version with the same draws."""

import math
import re
from collections import defaultdict

import pytest
import xxhash
from fixtures import ODD, make

from inkflow.llm import mixing
from inkflow.llm.common import documents

DATA = "/root/testdata"


def chained(*values):
    """Spark's 64-bit hash of several columns: each value's hash is the next one's seed, nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def rounded(pool, n, most, block):
    """{(k, rep): 0 or 1} of one source, from pool = [(k, rep, size, x)] and its number of rows."""
    taken, blocks, level = {}, math.ceil(n / block), 0
    while True:
        tag = level.to_bytes(4, "little")
        by = defaultdict(list)
        for row in pool:
            by[signed(chained(row[0], row[1], tag, "block")) % blocks].append(row)
        most, pool = -(-most // block), []
        for rows in by.values():
            rows.sort()
            held = None
            for k, rep, size, x in rows:
                u = (chained(k, rep, tag, "draw") >> 11) / 2**53
                if held is None:
                    held = [k, rep, size, x, u]
                    continue
                up = min((1 - held[3]) * held[2], x * size)  # words that the held document can gain
                down = min(held[3] * held[2], (1 - x) * size)
                gains = u * (up + down) < down
                first = (1 - held[3]) * held[2] <= x * size if gains else held[3] * held[2] <= (1 - x) * size
                if first:  # the held document is settled
                    taken[held[0], held[1]] = int(gains)
                    moved = (1 - held[3]) * held[2] if gains else -held[3] * held[2]
                    held = [k, rep, size, min(1.0, max(0.0, x - moved / size)), u]
                else:
                    taken[k, rep] = int(not gains)
                    moved = x * size if gains else -(1 - x) * size
                    held[3] = min(1.0, max(0.0, held[3] + moved / held[2]))
            if most <= 1:
                taken[held[0], held[1]] = int(held[4] < held[3])
            else:
                pool.append(tuple(held[:4]))
        if most <= 1:
            return taken
        blocks, level = math.ceil(blocks / block), level + 1


def brute(rows, targets, block):
    """{(k, rep): copies} of (doc_id, text, source) rows."""
    seen, sources = defaultdict(int), defaultdict(list)
    for doc, text, source in rows:
        k = signed(chained(doc, text))
        seen[k, source] += 1
        sources[source].append((k, seen[k, source], len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    most, out = max(map(len, sources.values()), default=0), {}
    for source, own in sources.items():
        total = sum(s for *_, s in own)
        r = targets[source] / total if total else 0.0
        x = r - math.floor(r)
        out |= {(source, k, rep): math.floor(r) if size else 0 for k, rep, size in own}
        if x > 0:
            for (k, rep), one in rounded([(k, rep, size, x) for k, rep, size in own if size], len(own), most, block).items():
                out[source, k, rep] += one
    return out


@pytest.mark.parametrize("block", [64, 5])
@pytest.mark.parametrize("rows", ["table", "odd"])
def test_copies_against_a_sequential_version(spark, monkeypatch, block, rows):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = documents(spark, f"{DATA}/sf0.001") if rows == "table" else make(spark, ODD + ODD[:6])
    got = mixing.mix(docs).collect()
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], {r.source: r.target for r in got}, block)
    assert {(r.source, r.k, r.rep): r.copies for r in got} == want
    assert len(got) == docs.count()
