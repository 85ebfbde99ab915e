"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters with an error budget of e edits is cut into e + 1 pieces. If the item stands in a
text with at most e edits, one piece stands there unchanged: an automaton over all pieces finds every exact piece hit in
one pass over the text, and each hit's surroundings (m + 2e characters) are verified with Myers' bit-parallel edit
distance. Texts stay where they are: there is no shuffle. The automaton is shipped with the tasks, so the test set's size
is checked against ``max_benchmark_chars``; a larger one is matched in several passes over parts of that size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, new_path, table

_GAPS = re.compile(r"[\W_]+")
#: Scripts that do not set spaces between words.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
SCHEMA = "doc_id long, item_id long, distance int, budget int, start long, end long"


def normalised(text: str | None) -> str:
    """Lower case; every run of characters that are neither letters nor digits becomes one space."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length that cover the item, each with its place."""
    n = len(item)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any substring of ``text``, and the end of the first such substring."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


def at_words(text: str, start: int, end: int) -> bool:
    """Whether a stretch begins and ends between words (anywhere in scripts without spaces)."""

    def inside(i: int) -> bool:
        two = text[i - 1 : i + 1] if 0 < i < len(text) else " "
        return " " not in two and not _SPACELESS.search(two)

    return not inside(start) and not inside(end)


def char_masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(item):
        out[ch] |= 1 << i
    return dict(out)


class Matcher:
    """Automaton and masks of a part of the test set."""

    def __init__(self, items: list[tuple[int, str]], error_share: float, min_chars: int):
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(i, t, int(len(t) * error_share) if len(t) >= min_chars else 0, char_masks(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, budget, _) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                places[piece].append((k, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def matches(self, raw: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """item_id, distance, budget, start and end in the normalised text: the best place of each item found."""
        text = normalised(raw)
        best: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, set[int]] = defaultdict(set)
        for last, (n, where) in self.auto.iter(text):
            for k, at in where:
                _, item, budget, masks = self.items[k]
                begin = last + 1 - n - at
                # Pieces that agree on the item's place need one check; an exact match needs no other.
                if begin in seen[k] or (k in best and best[k][0] == 0):
                    continue
                seen[k].add(begin)
                if len(item) < self.min_chars and not at_words(text, begin, begin + len(item)):
                    continue
                lo = max(0, begin - budget)
                window = text[lo : begin + len(item) + budget]
                if window[begin - lo : begin - lo + len(item)] == item:
                    found, end = 0, begin - lo + len(item)
                else:
                    found, end = myers(item, masks, window)
                if found <= budget and (k not in best or found < best[k][0]):
                    best[k] = (found, max(0, lo + end - len(item)), lo + end)
        for k, (found, start, end) in sorted(best.items()):
            yield self.items[k][0], found, self.items[k][2], start, end


def parts(benchmark: DataFrame, max_chars: int) -> list[DataFrame]:
    """The items (item_id, text; different rows once) in parts of at most ``max_chars`` characters of raw text, or of one
    longer item. Several parts are dealt by hash and written to the shared folder, so that reading one reads no other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // max_chars)
    if n <= 1:
        return [items]
    while True:
        n *= 2
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        if dealt.groupBy("part").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).filter((F.col("chars") > max_chars) & (F.col("n") > 1)).isEmpty():
            break
    spark, path = benchmark.sparkSession, new_path(benchmark.sparkSession, "items")
    dealt.repartition("part").write.partitionBy("part").parquet(path)
    made = spark.read.schema("item_id long, text string, part long").parquet(path)
    return [made.filter(F.col("part") == i).select("item_id", "text") for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_share: float = 0.05, min_chars: int = 25, max_benchmark_chars: int = 8_000_000) -> DataFrame:
    """One row per document and test item that stands in it: doc_id, item_id, distance, budget, start, end.

    Both sides are normalised (lower case, runs of other characters than letters and digits as one space). The budget is
    ``error_share`` of the item's characters; distance is the least edit distance of the item to a stretch of the text,
    start and end its place in the normalised text (start as end less the item's length). Items shorter than
    ``min_chars`` have no budget and match whole words only (anywhere in scripts without spaces). Null or empty items
    match nothing; null and empty documents hold nothing. Items with equal texts are reported each, repeated rows of an
    item once; rows that repeat a document's id are matched each by itself. Other columns are not read; an empty table
    gives none.
    """
    bounded_batches(docs.sparkSession)

    def found(part: DataFrame) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(sorted({(r["item_id"], t) for r in part.collect() if (t := normalised(r["text"]))}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shipped.value, error_share, min_chars) if shipped.value else None
            for batch in batches:
                out = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for m in (matcher.matches(t) if matcher else ())]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "budget", "start", "end"]).astype({"doc_id": "Int64"})

        return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(found, parts(benchmark, max_benchmark_chars)))


def clean(docs: DataFrame, benchmark: DataFrame, error_share: float = 0.05, min_chars: int = 25, max_benchmark_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` in which no test item stands, with all their columns: each row is judged where it is read, by its
    text alone, and nothing is shuffled. Null and empty texts stay; repeated rows and null ids are rows like others. Items
    are those of ``decontaminate``; where they come in parts, each part sees what the parts before it left."""
    bounded_batches(docs.sparkSession)
    for part in parts(benchmark, max_benchmark_chars):
        items = sorted({(r["item_id"], t) for r in part.collect() if (t := normalised(r["text"]))})
        if items:
            docs = docs.mapInArrow(_without_hits(docs.sparkSession.sparkContext.broadcast(items), error_share, min_chars), docs.schema)
    return docs


def _without_hits(shipped, error_share: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shipped.value, error_share, min_chars)
        for b in batches:
            yield b.filter(pa.array([next(iter(matcher.matches(t)), None) is None for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def op10(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
