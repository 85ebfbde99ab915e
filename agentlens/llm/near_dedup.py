"""MinHash near-deduplication with odd sketches.

1. Map: each text becomes its set of distinct word shingles (64-bit hashes), a fingerprint of that set, ``bands`` band
   keys of ``rows`` MinHash values each, and an odd sketch: every MinHash value toggles one bit of a bitmap, so that the
   XOR of two bitmaps counts the values in which two documents differ.
2. Texts with equal sets form a class; only its smallest id goes on.
3. Candidates: in every band bucket each member is compared with the bucket's smallest id (linear in the bucket). A pair
   goes on if its sketches differ in so few bits as a pair at the threshold does, but for one in about 100,000.
4. Exact check of what remains, on the full sets.
5. Clusters of documents that close stars tie together, but whose confirmed links leave in several components, are
   compared in full: their members are dealt over blocks, each pair of blocks is one group of bounded size, and the full
   sets meet there as matrices. Only links that join two components become rows.
6. Buckets whose members are still in several components are compared in the same blocks, by sketch; pairs of one cluster
   or component are left out, and what is close enough is checked on full sets. So no bucket has a cap and no link is
   lost to the stars.
7. Components of all links; the smallest id of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, dealt_join, maybe_among, met, table, written
from agentlens.llm.components import connected_components
from agentlens.llm.shingles import Words, constants, mixed, shingled

BANDS, ROWS, SKETCH_WORDS = 26, 5, 8
#: Rows, and shingles where sets travel, of a block at most (a single longer set is a block of its own).
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set of hashes; long sets are taken in slices, so memory stays bounded."""
    a = constants(n, 11)[:, None]
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        best = np.minimum(best, (a * shingles[None, i : i + 1024]).min(axis=1))
    return best


def odd_sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The parity bitmap of the MinHash values, in 64-bit words."""
    bit = mixed(values + constants(len(values), 23)) % np.uint64(64 * words)
    flips = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def most_differing(threshold: float, samples: int) -> int:
    """Sketch bits in which two sets at the threshold differ at most, but for about 4.5 standard deviations: a value
    that differs flips two bits at most."""
    d = 1 - threshold
    return 2 * int(np.ceil(samples * d + 4.5 * np.sqrt(samples * d * (1 - d))))


def shingle_set(cache: Words, text: str | None, size: int) -> np.ndarray:
    return np.unique(shingled(cache.of(text), size))


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit fingerprint of the set), bands, sketch; nulls for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, k = Words(), constants(rows, 31)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(cache, text, size)
                if not len(s):
                    out.append((doc_id, 0, None, None, None, None))
                    continue
                values = signature(s, bands * rows)
                keys = mixed((mixed(values.reshape(bands, rows)) * k).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                a, b = mixed(s).sum(dtype=np.uint64), mixed(s ^ k[0]).sum(dtype=np.uint64)
                out.append((doc_id, len(s), *_signed(np.array([a, b])), _signed(keys), _signed(odd_sketch(values))))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"]).astype({"doc_id": "Int64", "n_shingles": "int64", "set_a": "Int64", "set_b": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles (the set as an array); for the documents that stand in a pair only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Words()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": [shingle_set(cache, t, size).view(np.int64) for t in batch["text"]]})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def differing_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _alike(a: str, b: str, per_100: int) -> Column:
    """The sizes alone allow the threshold."""
    return F.lit(100) * F.least(a, b) >= F.lit(per_100) * F.greatest(a, b)


def sets_of(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The sets of the documents in (a, b). Rows that repeat an id have a set each; a link of any is a link of the id.

    Sets are made where the texts are read; the few that the bitmap of ids lets through by chance meet no pair."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    return written(_sets(maybe_among(docs.select(F.col("doc_id").cast("long"), "text"), ids), size), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, per_100: int) -> DataFrame:
    """Of (a, b), those whose full sets satisfy 100 * intersection >= per_100 * union."""
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    both = dealt_join(pairs.join(two, "b"), one, "a", "b").select("a", "b", F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("k"))
    return both.filter(F.lit(100) * F.col("k") >= F.lit(per_100) * (F.col("n") + F.col("m") - F.col("k"))).select("a", "b").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a group of n (with ``total`` shingles, if sets travel) dealt over blocks, each row once for every block that
    its own meets: columns i <= j, mine."""
    blocks = F.ceil(F.col("n") / BLOCK)
    if "total" in rows.columns:
        blocks = F.greatest(blocks, F.ceil(F.col("total") / BLOCK_SHINGLES))
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "n", "total")


def intersections(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 24) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices of at most ``cells`` cells."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, rank, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[rank] > 1  # a value of one set adds to no intersection
    rank, owner = rank[shared], owner[shared]
    rank = np.unique(rank, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    rank, owner = rank[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(256, cells // (len(left) + len(right)))
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        at = slice(*np.searchsorted(rank, (lo, lo + width)))
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[at], rank[at] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _within(open_rows: DataFrame, per_100: int) -> DataFrame:
    """Links (a, b) on full sets between components of one cluster, enough to join what can be joined in a pair of
    blocks. open_rows: cluster, n, doc_id, component, shingles."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        mine = pdf["mine"].to_numpy()
        lower, upper = (np.flatnonzero(mine == pdf[c].to_numpy()) for c in ("i", "j"))
        ids, comp, sets = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy(), pdf["shingles"].tolist()
        k = intersections([sets[x] for x in lower], [sets[y] for y in upper]).astype(np.int64)
        n = np.array([len(s) for s in sets])
        linked = 100 * k >= per_100 * (n[lower][:, None] + n[upper][None, :] - k)
        over = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while over[c] != c:
                over[c] = c = over[over[c]]
            return c

        a, b = [], []
        for x, y in zip(*np.nonzero(linked & (comp[lower][:, None] != comp[upper][None, :])), strict=True):
            p, q = top(int(comp[lower[x]])), top(int(comp[upper[y]]))
            if p != q:
                over[max(p, q)] = min(p, q)
                a.append(int(ids[lower[x]]))
                b.append(int(ids[upper[y]]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return _dealt(open_rows).groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def _crossing(open_rows: DataFrame, most: int, per_100: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different components and clusters whose sketches are close enough. open_rows: key,
    n (rows of the bucket), doc_id, component, cluster, n_shingles, sketch."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        mine = pdf["mine"].to_numpy()
        lower, right = (np.flatnonzero(mine == pdf[c].to_numpy()) for c in ("i", "j"))
        ids, comp, cluster, n = (pdf[c].to_numpy() for c in ("doc_id", "component", "cluster", "n_shingles"))
        bits = np.stack(pdf["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        a, b = [], []
        for x in lower:
            y = right[(comp[right] != comp[x]) & (cluster[right] != cluster[x])]
            y = y[100 * np.minimum(n[y], n[x]) >= per_100 * np.maximum(n[y], n[x])]
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1) <= most]
            a += [ids[x]] * len(y)
            b += ids[y].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    found = _dealt(open_rows).groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_dedup(docs: DataFrame, per_100: int = 80, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets is per_100 / 100 or more; component_id is the
    smallest doc_id reachable by links. Documents with fewer words than a shingle have their whole sequence as one;
    empty and null texts have no shingles and no links. A null doc_id is linked with nothing and kept; rows that repeat
    an id share its links. Columns besides doc_id and text are not read. An empty table gives none.

    A link is missed only if no band agrees, which at the threshold of 0.85 happens with probability
    (1 - 0.85 ** rows) ** bands = 2e-7 (at 0.8: 3e-5).
    """
    bounded_batches(docs.sparkSession)
    most = most_differing(per_100 / 100, bands * rows)
    made = written(sketches(docs, size, bands, rows), "sketches")
    with_set = made.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(with_set.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), "classes")
    # The id is part of the join's key: copies by the million, which share a set, do not meet in one task.
    heads = with_set.join(classes.drop("n").withColumnRenamed("head", "doc_id"), ["doc_id", "set_a", "set_b", "n_shingles"]).dropDuplicates(["doc_id", "set_a", "set_b"])
    heads = written(heads.select("doc_id", "n_shingles", "bands", "sketch"), "heads")
    keys = heads.select("doc_id", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaders = written(leaders, "leaders")
    # Written as rows of a bucket: the rows of the largest buckets stay where they are.
    buckets = written(met(keys, leaders, ["key"], "n", ["doc_id"]).filter("met IS NOT NULL").select("doc_id", "key", "met.leader"), "buckets")

    def close(pairs: DataFrame) -> DataFrame:
        one = heads.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
        two = heads.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t"))
        return dealt_join(pairs.join(two, "b"), one, "a", "b").filter(_alike("n", "m", per_100) & (differing_bits("s", "t") <= most)).select("a", "b").distinct()

    stars = buckets.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = written(close(stars), "pairs")
    sets = sets_of(near, docs, size)
    as_links = lambda c: c.select(F.col("id").alias("a"), F.col("component").alias("b"))
    first = written(connected_components(confirmed(near, sets, per_100)), "components")
    clusters = written(connected_components(near).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    def placed(rows: DataFrame, components: DataFrame) -> DataFrame:
        return rows.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def open_groups(rows: DataFrame, key: str) -> DataFrame:
        """The groups of more than two (a star settles two) in several components: key, n."""
        by = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
        return written(by.filter("n > 2 AND lo <> hi").select(key, "n"), "groups")

    def in_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
        return met(rows, groups, [key], "n", ["doc_id"]).filter("met IS NOT NULL").withColumn("n", F.col("met.n")).drop("met")

    in_clusters = written(placed(clusters, first), "placed")
    in_open = written(in_groups(in_clusters, open_groups(in_clusters, "cluster"), "cluster").join(sets, "doc_id"), "open")
    total = written(in_open.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("total"), F.count(F.lit(1)).alias("rows")), "totals")
    within = _within(met(in_open, total, ["cluster"], "rows", ["doc_id"]).withColumn("total", F.col("met.total")).drop("met"), per_100)
    second = written(connected_components(as_links(first).union(within)), "components")
    in_buckets = written(placed(buckets.select("key", "doc_id"), second), "placed")
    open_rows = in_groups(in_buckets, open_groups(in_buckets, "key"), "key").join(clusters, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id")).join(heads.select("doc_id", "n_shingles", "sketch"), "doc_id")
    crossing = written(_crossing(open_rows, most, per_100), "pairs")
    more = confirmed(crossing, sets_of(crossing, docs, size), per_100)
    # Components stand for their links.
    final = connected_components(as_links(second).union(more)).withColumnRenamed("id", "head")
    # Classes meet their components first, so that rows move once; the rows of the largest classes are not dealt by them.
    named = written(classes.join(final, "head", "left").select("set_a", "set_b", "n_shingles", "n", F.coalesce("component", "head").alias("component")), "named")
    rows_out = met(made.select("doc_id", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b", "n_shingles"], "n", ["doc_id"])
    by_row = rows_out.select("doc_id", "n_shingles", F.coalesce("met.component", "doc_id").alias("component_id"))
    return by_row.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), per_100=85)
