"""Near-duplicate documents: SimHash and MinHash buckets find candidates, word shingles verify them.

A document is the set of its five-word shingles' hashes; documents with equal words are one node. The
first candidates are the links of SimHash fingerprints within three bits (``simhash.print_links``), and
nodes with one fingerprint. But of two sets with a Jaccard similarity of ``LEAST`` = 0.8 the fingerprints
differ in ten bits on average, so MinHash finds what is beyond three bits: nodes meet in a bucket where
the ``ROWS`` minima of one of ``BANDS`` bands agree. Two sets of similarity 0.8 meet nowhere with a chance
of (1 - 0.8^5)^40 = 1.3e-7, more similar ones with a smaller one, whatever was edited.

No bucket is paired in full. Its first centre is the node whose buckets are largest, which is what most
edited copies are copies of; all others are candidates with it. Nodes of buckets that the links verified
so far don't join into one component meet again by an exact prefix-filtered join: their sets are sorted
in one order, rare shingles first, and two sets of similarity s share a shingle among the first
n - ceil(s * n) + 1 of each. At the first shingle they share, no more can follow than the shorter rest,
which drops most pairs of unlike nodes before they are made. Again all are candidates
with the first centre of their bucket, a shingle; whoever is not joined with it then becomes a centre too, in rounds of more and more of them, until
every such node had its turn. Pairs that are joined already go untested. A bucket's rows are dealt over tasks by salts, so
it may hold any share of all nodes. Bounds on the numbers of shingles by hash bucket drop candidates that
can't reach ``LEAST``; the others are verified by the Jaccard similarity of the texts, in full. Groups are
the components of the verified links.

Nulls: null, empty and blank texts have no words and are one group. A document of fewer than five
words has one shingle, all its words. Null ids are the last of their group. Repeated rows are copies.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Stored, dealt_join, in_arrow, row_key, store, with_minimum
from .graph import components
from .simhash import SEED, fingerprint, print_links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
#: Nodes of a bucket that become centres in the first round after the first centre, the growth, and the most in a round.
CENTRES, GROWTH, MOST_CENTRES = 32, 16, 512
#: Rows of a key that one task may get together; a key with more is hot.
HOT = 4096


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(grams: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of a power of two of buckets, about four in each."""
    bits = max(3, len(grams).bit_length() - 2)
    return np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets with these sketches share more elements."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum())


def mixers() -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd factor of 32 bits for each minimum, drawn from a fixed seed."""
    draw = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return draw[0], draw[1] | np.uint32(1)


def bands(grams: np.ndarray, mask: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band: a hash of the band's minima and its number."""
    x, low = (grams >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 1 << 10):
        h = (x[at : at + (1 << 10)] ^ mask) * factor
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)).min(axis=1)
        low = h if low is None else np.minimum(low, h)
    both = np.concatenate([low.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint32)[:, None]], axis=1)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in both], np.uint64)


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k, node, fp, sketch, keys): node stands for the words in their order, fp is their fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = mixers()
        for batch in batches:
            nodes, prints, counts, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                text = text.as_py() or b""
                words = words_of(text)
                grams = shingles(words)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                prints.append(fingerprint(text, SHINGLE))
                counts.append(sketch(grams).tobytes())
                keys.append(bands(grams, *draws))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(counts, pa.binary()), lists], names=["doc_id", "k", "node", "fp", "sketch", "keys"])

    return docs.select("doc_id", row_key().alias("k"), "text").transform(in_arrow, run, f"doc_id {kind}, k long, node long, fp long, sketch binary, keys array<long>")


def possible(least: float):
    """(u, v) of rows (u, v, a, b) whose sketches a and b allow a similarity of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint32) for x in (a, b))
                ok.append(most_shared(a, b) * (1 + least) >= least * (int(a.sum()) + int(b.sum())) - 1e-6)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(least: float):
    """(u, v) of rows (u, v, a, b) whose texts a and b have similar enough shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = lru_cache(256)(lambda text: shingles(words_of(text)))
        for batch in batches:
            texts = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            ok = [jaccard(grams(a.as_py() or b""), grams(b.as_py() or b"")) >= least for a, b in zip(*texts)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def close_prints(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): candidates by fingerprint, from (node, fp). Of the nodes with one fingerprint the least stands
    for it; the others are candidates with it, and those of linked fingerprints with each other."""
    least = scratch.store(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = with_minimum(nodes.select("node", "fp"), "fp", "node", "u").where("u <> node").select("u", F.col("node").alias("v"))
    far = print_links(least).join(least.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.union(far.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def spread(rows: DataFrame, side: Stored) -> DataFrame:
    """``rows`` (key, node, ...) joined with ``side``, one row a key, however many rows a key has."""
    return rows.join(side.small(), "key") if side.is_small else dealt_join(rows, "key", "node", side.df)


def shared_keys(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``rows`` (key, node, ...) whose key several have, with n, how many.

    Counts too large to broadcast meet the rows by one shuffle of them. Rows of hot keys stay where they are:
    there are few such keys, as each has more than ``HOT`` rows, so their counts are broadcast."""
    counts = scratch.stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    if counts.is_small:
        return rows.join(counts.small(), "key")
    hot = scratch.stored(counts.df.where(f"n > {HOT}"))
    if not hot.is_small:
        return dealt_join(rows, "key", "node", counts.df)
    cold = rows.join(F.broadcast(hot.df.select("key")), "key", "left_anti")
    return cold.join(counts.df.where(f"n <= {HOT}"), "key").union(rows.join(hot.small(), "key"))


class Linker:
    """Verified links between nodes, and the components they join so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, least: float):
        self.texts = docs.select(F.col("doc_id").alias("own_id"), row_key().alias("own_k"), "text")
        self.nodes, self.least, self.labels = nodes, least, None

    def text_of(self, some: DataFrame, scratch: Scratch) -> DataFrame:
        """(node, text) of the nodes of ``some``."""
        wanted = scratch.stored(some.select("node").distinct().join(self.nodes, "node").select("node", "least.doc_id", "least.k"))
        # a row that is there several times gives the same
        return scratch.store(self.texts.join(wanted.small(), F.expr("own_k = k and own_id <=> doc_id")).select("node", "text").dropDuplicates(["node"]))

    def link(self, pairs: DataFrame) -> None:
        """Verifies candidates (u, v) and adds those that are similar; u may have very many."""
        with Scratch() as scratch:
            met = scratch.store(pairs.distinct())
            sketches = self.nodes.select("node", "sketch")
            with_a = dealt_join(met, "u", "v", sketches.toDF("u", "a"))
            possibly = with_a.join(sketches.toDF("v", "b"), "v").select("u", "v", "a", "b").transform(in_arrow, possible(self.least), "u long, v long")
            candidates = scratch.store(possibly)
            if candidates.isEmpty():
                return
            own = self.text_of(candidates.select(F.explode(F.array("u", "v")).alias("node")), scratch)  # texts take less disk than shingles
            both = dealt_join(candidates, "u", "v", own.toDF("u", "a")).join(own.toDF("v", "b"), "v")
            found = scratch.store(both.select("u", "v", "a", "b").transform(in_arrow, verified(self.least), "u long, v long"))
            if not found.isEmpty():
                # earlier links are as good as those to their components' roots
                links = found if self.labels is None else found.union(self.labels.select(F.col("node").alias("u"), F.col("root").alias("v")))
                self.labels = store(components(links))

    def label(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the root of ``node``, itself where it has no link."""
        if self.labels is None:
            return rows.withColumn(name, F.col(node))
        return rows.join(self.labels.select(F.col("node").alias(node), F.col("root").alias("__root")), node, "left").withColumn(name, F.coalesce("__root", node)).drop("__root")


def prefixes(texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, key, at, size) from (node, text): the shared ones of the rarest shingles of each node, of which
    similar nodes share one; at is the shingle's place in the node's order, from 0, and size the node's number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                keys = shingles(words_of(text.as_py() or b"")).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), node.as_py())), pa.array(keys), pa.array(np.full(len(keys), len(keys)))], names=["node", "key", "size"])

    grams = scratch.store(texts.transform(in_arrow, run, "node long, key long, size long"))
    shared = shared_keys(grams, scratch)
    # shingles of one node only come first in the order
    ranked = shared.select("node", "key", "size", F.expr("row_number() over (partition by node order by n, key) - 1 + size - count(*) over (partition by node)").alias("at"))
    return ranked.where(f"at <= size - ceil({least}D * size - 1e-9D)")


class Buckets:
    """Rows (key, node, weight, at, size) of the buckets of several nodes; weight is the size of a node's buckets."""

    def __init__(self, linker: Linker, keyed: DataFrame, scratch: Scratch):
        self.linker = linker
        with Scratch() as own:
            shared = own.store(shared_keys(keyed, own))
            self.rows = scratch.store(shared.join(shared.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("key", "node", "weight", "at", "size"))
        self.first = scratch.stored(self.rows.groupBy("key").agg(F.expr("max(struct(weight, node, at, size))").alias("c")).select("key", F.col("c.node").alias("centre"), F.struct("c.node", "c.at", "c.size").alias("c")))

    def labelled(self, scratch: Scratch) -> DataFrame:
        """The rows with the component of each node, and with the first centre and its component."""
        return scratch.store(spread(self.linker.label(self.rows, "node", "comp"), scratch.stored(self.linker.label(self.first.df, "centre", "comp0"))))

    def within(self) -> str:
        """Whether a row and a centre c, if their bucket's shingle is the first they share, can be similar."""
        return f"least(size - at, c.size - c.at) * (1 + {self.linker.least}D) >= {self.linker.least}D * (size + c.size) - 1e-6D"

    def link_first(self) -> None:
        """Candidates of every first centre with the nodes that aren't joined with it."""
        with Scratch() as scratch:
            self.linker.link(self.labelled(scratch).where(f"comp <> comp0 and {self.within()}").select(F.col("centre").alias("u"), F.col("node").alias("v")))

    def link_others(self, scratch: Scratch) -> None:
        """Candidates of every node that isn't joined with the first centre, until none is left."""
        used, most = None, CENTRES
        while True:
            with Scratch() as own:
                now = self.labelled(own)
                others = now.where("comp <> comp0")
                others = own.store(others if used is None else others.join(used, ["key", "node"], "left_anti"))
                if others.isEmpty():
                    return
                # at most so many centres of a bucket have their turn, one from each of as many slots
                chosen = others.groupBy("key", F.expr(f"pmod(xxhash64(node, {most}), {most})").alias("slot")).agg(F.expr("max(struct(weight, node, comp, at, size))").alias("c"))
                chosen = own.store(chosen.select("key", "c.node", "c"))
                centres = own.stored(chosen.groupBy("key").agg(F.collect_list("c").alias("cs")))
                live = spread(now.select("key", "node", "weight", "comp", "at", "size"), centres)
                pairs = live.select("node", F.expr(f"explode(filter(cs, c -> comp <> c.comp and {self.within()}))").alias("c"))
                self.linker.link(pairs.select(F.col("c.node").alias("u"), F.col("node").alias("v")))
                self.rows = scratch.store(live.select("key", "node", "weight", "at", "size"))
                self.first = scratch.stored(self.first.df.join(centres.df.select("key"), "key", "left_semi"))
                chosen = chosen.select("key", "node")
                used = scratch.store(chosen if used is None else used.union(chosen))
                most = min(most * GROWTH, MOST_CENTRES)


def linked_nodes(docs: DataFrame, nodes: DataFrame, keys: Stored, least: float) -> DataFrame | None:
    """(node, root) of the components of all links of ``least`` or more; none if there are no links.

    ``keys`` (node, keys) is deleted once it was read."""
    linker = Linker(docs, nodes, least)
    with Scratch() as scratch:
        linker.link(close_prints(nodes, scratch))
    with Scratch() as scratch:
        # MinHash buckets have no order of shingles, so no bound: zeros always pass
        wide = Buckets(linker, keys.df.select("node", F.explode("keys").alias("key"), F.expr("0L as at"), F.expr("0L as size")), scratch)
        keys.drop()
        wide.link_first()
        now = wide.labelled(scratch)
        several = scratch.stored(now.where("comp <> comp0").select("key").distinct())
        apart = store(spread(now.select("key", "node"), several).select("node").distinct())
    with Scratch() as scratch:
        with Scratch() as own:
            ranked = scratch.store(prefixes(linker.text_of(apart, own), least, own))
        fine = Buckets(linker, ranked, scratch)
        fine.link_first()
        fine.link_others(scratch)
    return linker.labels


def groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, k, first_id, first_k): each row's group, by its first row; k is common.row_key."""
    with Scratch() as scratch:
        found = scratch.store(nodes_of(docs))
        rows = store(found.select("doc_id", "k", "node"))
        # a null id comes last
        nodes = store(found.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("sketch").alias("sketch"), F.expr("min(struct(isnull(doc_id) as none, doc_id, k)) as least")))
        keys = Stored(found.groupBy("node").agg(F.any_value("keys").alias("keys")))
    labels = linked_nodes(docs, nodes, keys, least)
    if labels is None:
        of_node = nodes.select("node", F.col("least").alias("first"))
    else:
        linked = with_minimum(labels.join(nodes.select("node", "least"), "node"), "root", "least", "first")
        of_node = nodes.select("node", "least").join(linked.select("node", "first"), "node", "left").select("node", F.coalesce("first", "least").alias("first"))
    return dealt_join(rows, "node", "k", store(of_node)).select("doc_id", "k", F.col("first.doc_id").alias("first_id"), F.col("first.k").alias("first_k"))
