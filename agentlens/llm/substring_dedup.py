"""Repeated passages across documents by compact windows.

A text is its sequence of word-shingle hashes. Under one hash function, the Cartesian tree of the sequence splits all its
stretches of ``least`` shingles or more into compact windows (l, c, r): every such stretch with l <= start <= c <= end <= r
has its minimum at c, so the window stands for all of them. There are about 2 / (least + 1) windows a shingle. Only their c
is used, and these are the minima of the stretches of just ``least`` shingles, which are found for many texts together.

1. Map: the windows of ``hashes`` functions: a key (function and minimum), the place, and 16 bits each of the least of the
   shingles before and after it, which an edit does not shift.
2. Keys of a single document go (least and largest id with map-side combination; most go here).
3. Buckets are key, side and those 16 bits, and each bucket's members are paired with its smallest document.
4. Hits of a pair that overlap are one stretch; it goes on if enough functions agree on it.
5. The stretches' words are fetched and compared: runs of shared shingles of at least the passage's length and a Jaccard
   similarity of ``similarity`` or more are passages.
6. Places of a bucket that stand in no confirmed passage meet all smaller documents of the bucket: those with equal words
   around them are one kind, and the kinds meet, by these words, in pairs of bounded blocks; what is found is compared as
   in 5. So a head that has less than a passage hides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, drop_path, met, new_path, table, written
from agentlens.llm.shingles import constants, mixed, sequences, together

SIZE = 5
#: One changed word touches SIZE shingles; two changes next to each other make one gap.
GAP = 2 * SIZE


def compact_windows(values: np.ndarray, least: int, at: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(l, c, r), ends included, of every stretch of ``least`` or more; of equal minima the first counts. Where values
    stand for runs, ``at`` has the place where each run begins, and the end."""
    at = list(range(len(values) + 1)) if at is None else at
    out, todo = [], [(0, len(values))] * (at[-1] >= least)
    while todo:
        lo, hi = todo.pop()
        part = values[lo:hi]
        c = lo + int(part.argmin())
        # In a long stretch all equal minima cut at once: a text of one line over and over is not walked for each line.
        for c in (lo + np.flatnonzero(part == values[c])).tolist() if hi - lo > LONG else (c,):
            out.append((lo, c, hi - 1))
            if at[c] - at[lo] >= least:
                todo.append((lo, c))
            lo = c + 1
            if at[hi] - at[lo] < least:
                break
        else:
            todo.append((lo, hi))
    return out


def least_at(values: np.ndarray, least: int) -> np.ndarray:
    """The place of the minimum of each stretch of ``least`` values; of equal ones the first. These are the c of all compact
    windows, as one of them is the minimum of some stretch of just that length."""
    at, width = np.arange(len(values), dtype=np.int32), 1
    while width < least:
        step = min(width, least - width)
        lower = values[step:] < values[:-step]
        values, at = np.where(lower, values[step:], values[:-step]), np.where(lower, at[step:], at[:-step])
        width += step
    return at


def unrepeated(x: np.ndarray) -> np.ndarray:
    """x without values that equal the one before."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1]) - np.repeat(ends - n, n)


def run_ends(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of the run of equal neighbours that each place stands in; none goes over the ends of
    a text (from lo to hi)."""
    begins = np.ones(len(s) + 1, bool)
    begins[1:-1] = s[1:] != s[:-1]
    begins[lo] = begins[hi] = True
    at = np.flatnonzero(begins)
    return np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:] - 1, np.diff(at))


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the runs of equal neighbours, and where each begins (and the end)."""
    at = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
    return s[at[:-1]], at


#: Too few shingles on this side (the text ends).
NONE = 1 << 16
#: The shingles before and after a minimum whose least stands for that side.
BESIDE = 10
#: Values of a stretch that is looked through for equal minima.
LONG = 512
#: Rows of a block in the full comparison of a bucket, and of one matrix in it.
BLOCK, TILE = 4096, 512
#: Fewer texts than this are not first compared as one.
FEW = 64
#: Places of which a batch is made, at least, while there are more; it has fewer than twice as many.
PLACES = 10_000


def beside(s: np.ndarray) -> np.ndarray:
    """16 bits for each place from which BESIDE shingles go on: the least of them. A place's own are those before it (at
    the place less BESIDE), and those after it (one further on). A least does not shift with the words around it, and in a
    passage with one edit (or none) the longer clean part has room for one of the two wherever in it the minimum stands."""
    n = max(0, len(s) - BESIDE + 1)
    least = s[:n].copy()
    for i in range(1, BESIDE):
        np.minimum(least, s[i : i + n], out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.int64)


def windows(docs: DataFrame, hashes: int, least: int) -> DataFrame:
    """key, doc_id, c, sides. c is the place; sides packs which function (8 bits) and 17 bits each of what stands before
    and after. Nearly all windows leave after being counted, so what moves of them is kept small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, none = constants(hashes, 41), np.full(BESIDE, NONE)
        for batch in batches:
            doc_ids, n, out = batch["doc_id"].to_numpy(), 0, []
            for all_, spans in together(batch["text"], SIZE):
                (lo, hi), of = np.array(spans).T, doc_ids[n : n + len(spans)]
                n += len(spans)
                lo, hi, of = (x[hi - lo >= least] for x in (lo, hi, of))
                if not len(of):
                    continue
                near, (first, last) = np.concatenate([none, beside(all_), none]), run_ends(all_, lo, hi)
                starts = np.repeat(lo, hi - lo - least + 1) + counted(hi - lo - least + 1)
                for i in range(hashes):
                    minima = mixed(all_ ^ k[i])
                    # Places of minima do not fall from one stretch to the next.
                    c = unrepeated(first[unrepeated(least_at(minima, least)[starts])])
                    # A run of one word over and over stands at its first and its last place.
                    c = np.concatenate([c, last[c][last[c] > c]])
                    own = np.searchsorted(lo, c, "right") - 1
                    before = np.where(c - lo[own] >= BESIDE, near[c], NONE)
                    after = np.where(c + BESIDE < hi[own], near[c + BESIDE + 1], NONE)
                    out.append((minima[c], of[own], (c - lo[own]).astype(np.int32), (i << 34) | (before << 17) | after))
            if out:
                key, doc_id, c, sides = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": doc_id, "c": c, "sides": sides})

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInPandas(run, "key long, doc_id long, c int, sides long")


def sided(found: DataFrame) -> DataFrame:
    """bucket, f, doc_id, c: one row a window and side. A bucket stands for key, side and what is beside."""
    bits = lambda at: F.shiftright("sides", at).bitwiseAND((1 << 17) - 1)
    # 16 bits of the key lead, so that the buckets of a key can travel together.
    of = lambda at: F.shiftleft(F.shiftright("key", 48), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64("key", F.lit(at), bits(at)), 16))
    bucket = F.explode(F.array(*(F.when(bits(at) != NONE, of(at)) for at in (17, 0)))).alias("bucket")
    return found.select(bucket, F.shiftright("sides", 34).cast("int").alias("f"), "doc_id", "c").filter("bucket IS NOT NULL")


def starred(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, f, a_lo, a_hi, b_lo, b_hi (places): each bucket's documents with its smallest one, all their places in it; and
    these smallest ones: bucket, h (doc_id, lo, hi), of the buckets of several documents."""
    places = rows.groupBy("bucket", "f", "doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    heads = written(places.groupBy("bucket").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("h"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("h.doc_id < last").select("bucket", "h", "n"), "heads")
    hits = met(places, heads, ["bucket"], "n", ["doc_id", "bucket"], hashed=True).filter("doc_id <> met.h.doc_id")
    return hits.select(F.col("met.h.doc_id").alias("a"), F.col("doc_id").alias("b"), "f", F.col("met.h.lo").alias("a_lo"), F.col("met.h.hi").alias("a_hi"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")).distinct(), heads


def stretches(hits: DataFrame, agree: int, least: int) -> DataFrame:
    """a, b, n_hashes, a_lo, a_hi, b_lo, b_hi (shingles): hits of a pair whose passages' lengths overlap in a, give or
    take a gap, are one stretch; it goes on if ``agree`` functions have hits in it."""
    order = Window.partitionBy("a", "b").orderBy("a_lo", "a_hi", "f", "b_lo", "b_hi")
    joined = hits.withColumn("reach", F.max("a_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("a_lo") > F.col("reach") + 2 * least + GAP, 1).otherwise(0)).over(order)
    return (
        joined.withColumn("island", island)
        .groupBy("a", "b", "island")
        .agg(F.count_distinct("f").alias("n_hashes"), *(F.greatest(F.min(f"{x}_lo") - least, F.lit(0)).alias(f"{x}_lo") if end == "lo" else (F.max(f"{x}_hi") + least).alias(f"{x}_hi") for x in "ab" for end in ("lo", "hi")))
        .filter(F.col("n_hashes") >= agree)
        .drop("island")
    )


def outside(places: DataFrame, spans: DataFrame, stretch: int = 1024) -> DataFrame:
    """The rows whose place (doc_id, c) is in none of the document's spans (lo, hi; ends included). Spans that touch are one,
    and they meet places by stretches of the document, so that a long document does not pair all its places with all its
    spans."""
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    begins = F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    apart = spans.withColumn("begins", begins.cast("int")).withColumn("k", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by = apart.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / stretch), F.floor(F.col("hi") / stretch)))).drop("k")
    by = by.select(F.col("doc_id").alias("_d"), F.col("stretch").alias("_s"), "lo", "hi")
    return places.join(by, (F.col("doc_id") == F.col("_d")) & (F.floor(F.col("c") / stretch) == F.col("_s")) & F.col("c").between(F.col("lo"), F.col("hi")), "left_anti")


def still_open(found: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the buckets in which a place stands in no confirmed passage of its document, without the heads (they have
    met everyone) and without what has no smaller document left to meet: bucket, f, doc_id, c, open."""
    spans = pairs.select(F.col("b").alias("doc_id"), F.col("b_start").alias("lo"), (F.col("b_start") + F.col("b_words") - SIZE).alias("hi")).distinct()
    others = heads.select("bucket", F.col("h.doc_id").alias("head"), "n")
    at = ["doc_id", "c", "f"]
    free = met(sided(outside(found, spans)), others, ["bucket"], "n", at, hashed=True).filter("doc_id <> met.head")
    free = written(free.select("bucket", "f", "doc_id", "c", F.col("met.head").alias("head"), F.col("met.n").alias("n")), "free")
    last = written(free.groupBy("bucket").agg(F.max("doc_id").alias("last"), F.first("head").alias("head"), F.first("n").alias("n")), "last")
    rest = met(sided(found), last, ["bucket"], "n", at, hashed=True).filter("doc_id <> met.head AND doc_id <= met.last").select("bucket", "f", "doc_id", "c")
    return rest.join(free.select("doc_id", "c", F.lit(True).alias("open")).distinct(), ["doc_id", "c"], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def contexts(places: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """doc_id, c, around (a hash), bits: 32 bits of each shingle no further from c than a passage and a gap."""
    reach = least + GAP

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> pd.DataFrame:
            return pd.DataFrame({"doc_id": np.concatenate(ids), "c": np.concatenate(at).astype(np.int32), "bits": bits})

        for batch in batches:
            # Many documents make one batch: most have few places.
            ids, at, bits = [], [], []
            for doc_id, s, found in zip(batch["doc_id"], sequences(batch["text"], SIZE), batch["places"], strict=True):
                s = (s >> np.uint64(32)).astype(np.uint32)
                found = found[found < len(s)]
                for i in range(0, len(found), PLACES):
                    some = found[i : i + PLACES]
                    ids.append(np.full(len(some), doc_id, np.int64))
                    at.append(some)
                    bits += [s[max(0, c - reach) : c + reach + 1].tobytes() for c in some.tolist()]
                    if len(bits) >= PLACES:
                        yield made()
                        ids, at, bits = [], [], []
            if bits:
                yield made()

    of = places.groupBy("doc_id").agg(F.collect_set("c").alias("places"))
    return docs.select(F.col("doc_id").cast("long"), "text").join(of, "doc_id").mapInPandas(cut, "doc_id long, c int, bits binary").withColumn("around", F.xxhash64("bits"))


class Around:
    """What one place's surroundings show of the passages that another text may share with it."""

    def __init__(self, s: np.ndarray, least: int, similarity: float):
        self.seq, self.least, self.similarity = s, least, similarity
        self.values, self.at = runs(s)
        sorted_ = np.sort(self.values)
        self.apart = bool((sorted_[1:] != sorted_[:-1]).all())
        self.single = self.apart and len(self.values) == len(s)
        if not self.apart:
            self.values = np.unique(s)

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of runs, and for each the last beginning that leaves a passage's length."""
        begin = np.searchsorted(self.at, self.at - self.least, "right") - 1
        ends = np.flatnonzero(begin >= 0)
        return ends, begin[ends]

    @cached_property
    def need(self) -> float:
        return self.similarity * fewest_distinct(self.seq, len(self.values), self.least) - 1e-9

    def may_share(self, hit: np.ndarray) -> np.ndarray:
        """hit: for each other text, which of ``values`` it has. Whether some stretch of a passage's length has the share
        of its distinct shingles there that the similarity asks for; texts without such a stretch share no passage."""
        enough = np.count_nonzero(hit, axis=1) >= self.need - 1e-3 * self.apart
        if not self.apart or not enough.any():
            return enough
        hit = hit[enough]
        sums = np.zeros((len(hit), hit.shape[1] + 1), np.float32)
        np.cumsum(hit - np.float32(self.similarity), axis=1, out=sums[:, 1:])
        least, (ends, begins) = np.minimum.accumulate(sums, axis=1), self.lengths
        enough[enough] = (sums[:, ends] - least[:, begins] > -1e-3).any(axis=1)
        return enough


def fewest_distinct(s: np.ndarray, distinct: int, least: int) -> float:
    """The least number of distinct values in any ``least`` consecutive ones of s; infinite if s is shorter."""
    if len(s) < least or distinct == len(s):
        return np.inf if len(s) < least else least
    order = np.argsort(s, kind="stable")
    before = np.full(len(s), -1)
    same = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    before[order[same + 1]] = order[same]
    views = np.lib.stride_tricks.sliding_window_view(before, least)
    return int((views < np.arange(len(views))[:, None]).sum(axis=1).min())


def nearest(ids: np.ndarray, around: list[Around], lower: np.ndarray, upper: np.ndarray, least: int, similarity: float, met: dict[tuple[int, int], bool]) -> list[tuple[int, int]]:
    """For each place of ``upper`` the place of the smallest document in ``lower`` (a smaller one than its own) that has a
    passage in the words around, if there is one. ``met`` remembers pairs of surroundings."""
    lower = lower[np.argsort(ids[lower], kind="stable")]
    todo, out = upper.tolist(), []
    for x in range(0, len(lower), TILE):
        xs = lower[x : x + TILE]
        sizes = np.array([len(around[q].values) for q in xs])
        values, column = np.unique(np.concatenate([around[q].values for q in xs]), return_inverse=True)
        # Where each value stands in each text, from 1 on; 0: nowhere. The last column: values that none has.
        where = np.zeros((len(xs), len(values) + 1), np.int16 if sizes.max() < 1 << 15 else np.int32)
        where[np.repeat(np.arange(len(xs)), sizes), column] = counted(sizes) + 1
        open_, todo = todo, []
        for r in open_:
            one, n = around[r], int(np.searchsorted(ids[xs], ids[r]))
            at = np.searchsorted(values, one.values)
            known = values[np.minimum(at, len(values) - 1)] == one.values
            found = None
            # First against all of the tile together, if they are many: what nobody has, as after an edit, may decide.
            if n and (n < FEW or one.may_share(known[None, :])[0]):
                places = where[:n][:, np.where(known, at, len(values))]
                for row in np.flatnonzero(one.may_share(places > 0)):
                    other = around[xs[row]]
                    pair = (id(other), id(one))
                    if pair not in met:
                        place = places[row].astype(np.int64) - 1 if one.single and other.single else None
                        met[pair] = bool(passages(other.seq, one.seq, least, similarity, place))
                    if met[pair]:
                        found = int(xs[row])
                        break
            if found is None:
                todo.append(r)
            else:
                out.append((found, r))
    return out


def crossing(rows: DataFrame, docs: DataFrame, least: int, similarity: float) -> DataFrame:
    """Hits (as ``starred`` gives them) of open places. Places of a bucket with equal words around them are one kind; each
    shares its passage with the smallest document of its kind. The kinds of a bucket are compared in full, in pairs of
    blocks of bounded size: each open one with the smallest documents, one of every block, that have the passage in the
    words around. Small buckets travel together."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "doc_id", "c", "f"]).reset_index(drop=True)
        ids, mine, is_open, c, f, i, j, bucket = (pdf[x].to_numpy() for x in ("doc_id", "mine", "open", "c", "f", "i", "j", "bucket"))
        known = {x: Around(np.frombuffer(x, np.uint32), least, similarity) for x in set(pdf["bits"])}
        around, met, out = [known[x] for x in pdf["bits"]], {}, []
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = np.arange(lo, hi)
            for left, right in {(int(i[lo]), int(j[lo])), (int(j[lo]), int(i[lo]))}:
                lower, upper = at[mine[at] == left], at[(mine[at] == right) & is_open[at]]
                for a, b in nearest(ids, around, lower, upper, least, similarity, met) if len(lower) and len(upper) else []:
                    out.append((ids[a], ids[b], f[b], c[a], c[a], c[b], c[b]))
        return pd.DataFrame(out, columns=["a", "b", "f", "a_lo", "a_hi", "b_lo", "b_hi"])

    made = written(contexts(rows.select("doc_id", "c").distinct(), docs, least), "contexts")
    placed = rows.join(made.select("doc_id", "c", "around"), ["doc_id", "c"])
    of_kind = written(placed.groupBy("bucket", "around").agg(F.min(F.struct("doc_id", "c", "open", "f")).alias("k"), F.count(F.lit(1)).alias("rows")), "kinds")
    kinds = of_kind.select("bucket", "around", "k.*")
    first = of_kind.select("bucket", "around", F.col("k.doc_id").alias("a"), F.col("k.c").alias("a_c"), "rows")
    same = met(placed.filter("open"), first, ["bucket", "around"], "rows", ["doc_id", "c"]).withColumns({"a": F.col("met.a"), "a_c": F.col("met.a_c")}).drop("met").filter("doc_id <> a")
    one = lambda df, a, ac, b, bc: df.select(F.col(a).alias("a"), F.col(b).alias("b"), "f", F.col(ac).alias("a_lo"), F.col(ac).alias("a_hi"), F.col(bc).alias("b_lo"), F.col(bc).alias("b_hi"))
    sizes = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last")).filter("least < last").select("bucket", "n", "last")
    blocks = F.ceil(F.col("n") / BLOCK)
    meeting = written(kinds.join(sizes, "bucket").filter("doc_id <= last").drop("last"), "meeting")
    packs = max(1, meeting.count() // BLOCK)
    dealt = (
        meeting.join(made.select("doc_id", "c", "bits"), ["doc_id", "c"])
        .withColumns({"pack": F.when(F.col("n") > TILE, F.col("bucket")).otherwise(F.pmod(F.xxhash64(F.shiftright("bucket", 48)), F.lit(packs))), "mine": F.pmod(F.xxhash64("doc_id", "c"), blocks)})
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
        .drop("other", "n", "around")
    )
    compared = dealt.groupBy("pack", "i", "j").applyInPandas(compare, "a long, b long, f int, a_lo int, a_hi int, b_lo int, b_hi int")
    return one(same, "a", "a_c", "doc_id", "c").unionByName(compared).distinct()


def exact_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length): b from left to right in stretches that stand in a, each by its longest match."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    first, last = np.searchsorted(ranked, b), np.searchsorted(ranked, b, "right")
    places, out, i = np.flatnonzero(last > first), [], 0
    k = 0
    while k < len(places):
        i = int(places[k])
        best = (0, 0)
        for j in order[first[i] : last[i]].tolist():
            n = min(len(a) - j, len(b) - i)
            # What is to be longer goes on where the best so far ends.
            if n <= best[0] or a[j + best[0]] != b[i + best[0]]:
                continue
            differ = a[j : j + n] != b[i : i + n]
            first_ = int(differ.argmax())
            n = first_ if differ[first_] else n
            best = max(best, (n, j), key=lambda x: x[0])
        out.append((best[1], i, best[0]))
        k = int(np.searchsorted(places, i + best[0]))
    return out


def places_in(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The place in a of each value of b (-1: none), if neither repeats a value."""
    order = np.argsort(a)
    ranked, sorted_ = a[order], np.sort(b)
    if not len(a) or (ranked[1:] == ranked[:-1]).any() or (sorted_[1:] == sorted_[:-1]).any():
        return None
    at = np.minimum(np.searchsorted(ranked, b), len(a) - 1)
    return np.where(ranked[at] == b, order[at], -1)


def placed_runs(place: np.ndarray) -> list[tuple[int, int, int]]:
    """``exact_runs`` from the places."""
    hit = np.flatnonzero(place >= 0)
    if not len(hit):
        return []
    at = place[hit]
    begin = np.concatenate([[0], np.flatnonzero((hit[1:] != hit[:-1] + 1) | (at[1:] != at[:-1] + 1)) + 1])
    return list(zip(at[begin].tolist(), hit[begin].tolist(), (np.append(begin[1:], len(hit)) - begin).tolist(), strict=True))


def passages(a: np.ndarray, b: np.ndarray, least: int, similarity: float, place: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of two sequences of shingles: start and end in a, in b (ends included), similarity. ``place``: what
    ``places_in`` gives, if it is known.

    Exact runs are taken together from left to right while they are no further apart than a gap on both sides and the
    Jaccard similarity of the shingles they cover stays at ``similarity`` or more; what has ``least`` shingles on both
    sides is a passage. So an exact run of that length is always part of one."""
    out, now = [], None
    place = places_in(a, b) if place is None else place
    # k shared ones of a passage are at least similarity * (2 * least - k).
    if place is not None and (1 + similarity) * np.count_nonzero(place >= 0) < similarity * 2 * least - 1e-6:
        return out

    def jaccard(p: int, q: int, i: int, j: int) -> float:
        if place is not None:
            at = place[i : j + 1]
            k = int(np.count_nonzero((at >= p) & (at <= q)))
            return k / (q - p + 1 + j - i + 1 - k)
        x, y = np.unique(a[p : q + 1]), np.unique(b[i : j + 1])
        k = len(np.intersect1d(x, y, assume_unique=True))
        return k / (len(x) + len(y) - k)

    for p, i, n in [*(exact_runs(a, b) if place is None else placed_runs(place)), (0, 0, 0)]:
        if now and n and 0 < p - now[1] <= GAP and i - now[3] <= GAP and (score := jaccard(now[0], p + n - 1, now[2], i + n - 1)) >= similarity:
            now = (now[0], p + n - 1, now[2], i + n - 1, score)
            continue
        if now and min(now[1] - now[0], now[3] - now[2]) + 1 >= least:
            out.append(now)
        now = (p, p + n - 1, i, i + n - 1, 1.0)
    return out


def packed(s: np.ndarray) -> bytes:
    """40 bits of each shingle: two different ones of a pair of stretches of 1,000 agree once in a million pairs."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def verified(found: DataFrame, docs: DataFrame, least: int, similarity: float) -> DataFrame:
    """a, b, n_hashes, a_start, a_words, b_start, b_words, similarity. The words of each stretch, and of a passage's
    length around it, are cut out beside the text, once for all the pairs that it stands in, and meet by the pair."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, bits, last, texts = [], [], object(), batch["text"].tolist()
            # A text's rows follow each other.
            each = sequences((x for x, before in zip(texts, [last, *texts], strict=False) if x is not before), SIZE)
            for text, lo, hi in zip(texts, batch["lo"], batch["hi"], strict=True):
                if text is not last:
                    last, seq = text, next(each)
                start = max(0, lo - least)
                at.append(start)
                bits.append(packed(seq[start : hi + least + 1]))
            yield batch.drop(columns=["text"]).assign(at=np.array(at, np.int32), bits=bits)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    side = lambda x: found.select(F.col(x).alias("doc_id"), F.col(f"{x}_lo").alias("lo"), F.col(f"{x}_hi").alias("hi"), F.lit(x == "a").alias("as_a"), F.lit(x == "b").alias("as_b"))
    # Written, so that Spark knows their size: few enough are broadcast, and no text is shuffled.
    ends = written(side("a").union(side("b")).groupBy("doc_id", "lo", "hi").agg(F.max("as_a").alias("as_a"), F.max("as_b").alias("as_b")), "ends")
    parts_path = new_path(docs.sparkSession, "parts")
    schema = "doc_id long, lo int, hi int, as_a boolean, as_b boolean, at int, bits binary"
    ends.join(texts, "doc_id").mapInPandas(cut, schema).write.parquet(parts_path)
    parts = docs.sparkSession.read.schema(schema).parquet(parts_path)
    of = lambda x: parts.filter(f"as_{x}").select(F.col("doc_id").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"), F.col("at").alias(f"{x}_at"), F.col("bits").alias(f"{x}_bits"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                for p, q, i, j, score in passages(unpacked(r.a_bits), unpacked(r.b_bits), least, similarity):
                    out.append((r.a, r.b, r.n_hashes, r.a_at + p, q - p + SIZE, r.b_at + i, j - i + SIZE, score))
            yield pd.DataFrame(out, columns=["a", "b", "n_hashes", "a_start", "a_words", "b_start", "b_words", "similarity"])

    both = found.join(of("b"), ["b", "b_lo", "b_hi"]).join(of("a"), ["a", "a_lo", "a_hi"]).select("a", "b", "n_hashes", "a_at", "a_bits", "b_at", "b_bits")
    schema = "a long, b long, n_hashes long, a_start long, a_words long, b_start long, b_words long, similarity double"
    made = written(both.mapInPandas(compare, schema).distinct(), "passages")
    drop_path(docs.sparkSession, parts_path)
    return made


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, hashes: int = 3, agree: int = 1) -> DataFrame:
    """Passages of ``min_words`` words or more that stand in several documents, one row per document and passage: doc_id,
    start_word, n_words, first_doc_id, first_start_word, similarity, n_hashes, kept.

    Words are runs of characters other than white space, A-Z lower-cased. The smallest document of each bucket of equal
    passages keeps its passage (kept, first_doc_id its own id, similarity 1, one row for each stretch that others
    repeat); each other document has a row that names it. Repeats within one document are not reported. Null ids, null,
    empty and short texts have no passages. Rows that repeat an id with different texts are compared as they are, but
    not with each other. Columns besides doc_id and text are not read; an empty table gives none.

    An exact repeat has the same minimum under every function. At the similarity itself, one of three functions agrees
    with probability 0.992; the comparison of the words decides. A larger ``agree`` compares fewer of the stretches that
    the smallest documents give.
    """
    bounded_batches(docs.sparkSession)
    least = min_words - SIZE + 1
    spark, made_path = docs.sparkSession, new_path(docs.sparkSession, "windows")
    windows(docs, hashes, least).write.option("compression", "zstd").parquet(made_path)
    made = spark.read.schema("key long, doc_id long, c int, sides long").parquet(made_path)
    # Most keys stand in one document: they are counted alone, without the windows.
    often = written(made.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("key", "n"), "keys")
    repeated = written(met(made, often, ["key"], "n", ["doc_id", "c"], hashed=True).filter("met IS NOT NULL").drop("met"), "windows")
    drop_path(spark, made_path)
    hits, heads = starred(sided(repeated))
    first = verified(written(stretches(hits, agree, least), "stretches"), docs, least, similarity)
    open_rows = written(still_open(repeated, heads, first), "open")
    more = written(stretches(crossing(open_rows, docs, least, similarity), 1, least), "stretches")
    pairs = first.unionByName(verified(more, docs, least, similarity)).distinct()
    members = pairs.groupBy(F.col("b").alias("doc_id"), F.col("b_start").alias("start_word"), F.col("b_words").alias("n_words")).agg(
        F.min(F.struct(F.col("a").alias("first_doc_id"), F.col("a_start").alias("first_start_word"), "similarity", "n_hashes")).alias("m")
    )
    heads = pairs.groupBy(F.col("a").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_words").alias("n_words")).agg(F.max("n_hashes").alias("n_hashes"))
    # A stretch that repeats a smaller document's is no head of its own.
    taken = pairs.select(F.col("b").alias("_d"), F.col("b_start").alias("_s"), F.col("b_words").alias("_n")).distinct()
    overlap = (F.col("doc_id") == F.col("_d")) & (F.col("start_word") < F.col("_s") + F.col("_n")) & (F.col("_s") < F.col("start_word") + F.col("n_words"))
    heads = heads.join(taken, overlap, "left_anti")
    return members.select("doc_id", "start_word", "n_words", "m.first_doc_id", "m.first_start_word", "m.similarity", "m.n_hashes", F.lit(False).alias("kept")).unionByName(
        heads.select("doc_id", "start_word", "n_words", F.col("doc_id").alias("first_doc_id"), F.col("start_word").alias("first_start_word"), F.lit(1.0).alias("similarity"), "n_hashes", F.lit(True).alias("kept"))
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
