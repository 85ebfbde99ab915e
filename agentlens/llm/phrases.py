"""Phrases whose words stand together more often than chance: counts from an FM-index of each shard, summed over shards.

1. Each shard of texts becomes one sequence of word ids (a word of another language is another id; 0 ends a piece) and two
   Burrows-Wheeler transforms of it, of the sequence and of its reverse, sorted by as many words as a phrase has. They are
   written once, with the shard's words and counts; all that follows reads them, never the texts.
2. A phrase is an interval of both transforms. The ids that the first transform has in the interval extend the phrase to
   the left, those of the second to the right; rank and an offset give the new pair of intervals. All phrases of a length
   are extended at once, alternately to the right and to the left.
3. Round by round (words, pairs, ...) the shards' counts are summed by a hash of the phrase, which is a place in a bitmap
   of a fixed number of bits; a task adds up its shards before it sends their counts. The bits of frequent places go back
   to the shards: a longer phrase is counted only if both parts that are a word shorter have their bits. The bitmap can
   pass too much, never too little; at the end the phrases that pass are summed by themselves, which decides.
4. The counts give each phrase's cuts (what its parts are without each other) and its extensions by one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlens.llm.common import batches_of, bounded_batches, drop_path, met, new_path, table, written
from agentlens.llm.shingles import constants, mixed

#: What ends a piece, and what parts words.
PIECE_ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: One of the piece ends, which therefore is in no word.
END = "."
#: Places of a block of a bitmap, and blocks that travel together.
PLACES, SPAN = 1 << 16, 16
#: Shards that a task adds up at most; it holds one at a time.
SHARDS_A_TASK = 64
INDEX = "lang array<string>, word array<string>, hash array<long>, langs array<string>, words array<long>, left binary, right binary"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words and piece ends of the texts in order, and how many there are of each text; each text ends with an end."""
    plain = pc.ascii_lower(pc.fill_null(texts, ""))
    apart = pc.binary_join_element_wise(pc.replace_substring_regex(plain, PIECE_ENDS, f" {END} "), pa.scalar(END, plain.type), pa.scalar(" ", plain.type))
    cut = pc.split_pattern_regex(apart, BLANKS)
    return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The id before each place, places in the order of the ``depth`` ids from there on (round the end)."""
    rank, seen, order = ids.astype(np.int64), 1, None
    while seen < depth:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -seen)
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        seen *= 2
    # Places with equal ids from there on may come in any order: what stands before them is counted, not followed.
    return ids[(np.argsort(rank) if order is None else order) - 1].astype(np.int32)


def hashed(x: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(x.to_numpy(zero_copy_only=False), dtype=object), categorize=False)


class Shard:
    """The FM-index of one sequence of ids 0..v, both ways. ``hashes`` belong to the ids."""

    def __init__(self, left: np.ndarray, right: np.ndarray, hashes: np.ndarray):
        self.transforms, self.hashes = (left, right), hashes
        self.counts = np.bincount(left, minlength=len(hashes))
        self.leads: dict[int, np.ndarray] = {}

    def lead(self, side: int) -> np.ndarray:
        """Where the row of an id goes when the phrase is extended by it: the row's rank among all rows, sorted by id."""
        if side not in self.leads:
            n = len(self.transforms[side])
            self.leads[side] = lead = np.empty(n, np.int32)
            lead[np.sort(self.transforms[side].astype(np.int64) * n + np.arange(n)) % n] = np.arange(n, dtype=np.int32)
        return self.leads[side]

    def words(self) -> dict:
        """Intervals of all ids but 0: begin (in both transforms), size, and the ids of the phrase."""
        ids = np.flatnonzero(self.counts)
        ids = ids[ids > 0]
        begin = np.cumsum(self.counts)[ids] - self.counts[ids]
        return {"begin": (begin, begin), "size": self.counts[ids], "ids": ids[:, None].astype(np.int32)}

    def extended(self, found: dict, side: int, last: bool = False) -> dict:
        """The phrases of ``found`` with one word more, on the left (side 0) or the right (1), with their intervals in both
        transforms; ``last``: counts only, without intervals."""
        size, (here, there) = found["size"], (found["begin"][side], found["begin"][1 - side])
        owner = np.repeat(np.arange(len(size)), size)
        row = np.arange(len(owner)) + np.repeat(here - (np.cumsum(size) - size), size)
        key = owner * len(self.hashes) + self.transforms[side][row]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return {"begin": (here[:0], here[:0]), "size": size[:0], "ids": np.empty((0, found["ids"].shape[1] + 1), np.int32)}
        n = np.diff(first, append=len(key))
        owner, word = np.divmod(key[first], len(self.hashes))
        new_here = new_there = n
        if not last:
            new_here = np.minimum.reduceat(self.lead(side)[row[order]], first).astype(np.int64)
            # In the other transform the interval is split by the new word, in the order of ids.
            before = np.cumsum(n) - n
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            new_there = there[owner] + before - np.repeat(before[starts], np.diff(starts, append=len(owner)))
        ids = found["ids"][owner]
        word = word.astype(np.int32)[:, None]
        made = {"begin": (new_here, new_there) if side == 0 else (new_there, new_here), "size": n, "ids": np.hstack([word, ids] if side == 0 else [ids, word])}
        return kept(made, word[:, 0] > 0)

    def phrase_hashes(self, ids: np.ndarray) -> np.ndarray:
        h = np.full(len(ids), ids.shape[1], np.uint64)
        for k in range(ids.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[ids[:, k]])
        return h


def kept(found: dict, where: np.ndarray) -> dict:
    return {"begin": tuple(b[where] for b in found["begin"]), "size": found["size"][where], "ids": found["ids"][where]}


def enumerated(shard: Shard, bitmaps: list[np.ndarray], longest: int) -> Iterator[dict]:
    """The phrases of 1, 2, ... ``longest`` words. bitmaps[k]: bits of the frequent phrases of k + 1 words; a phrase is
    counted if the bits of its parts that are a word shorter are set, and its own, as far as there are bitmaps."""

    def known(ids: np.ndarray) -> np.ndarray:
        bits = bitmaps[ids.shape[1] - 1]
        at = (shard.phrase_hashes(ids) % np.uint64(8 * len(bits))).astype(np.int64)
        return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    found = shard.words()
    for k in range(1, longest + 1):
        if k > 1:
            side = k % 2  # pairs grow to the left, threes to the right, ...
            found = shard.extended(found, side, k == longest)
            found = kept(found, known(found["ids"][:, 1:] if side else found["ids"][:, :-1]))
        if k <= len(bitmaps):
            found = kept(found, known(found["ids"]))
        yield found


def indexes(docs: DataFrame, depth: int, shard_words: int) -> DataFrame:
    """One row for each shard of about ``shard_words`` words (a batch of documents is never parted)."""

    def made(held: list) -> pa.RecordBatch:
        words = pa.chunked_array([h[0] for h in held]).dictionary_encode().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        langs = pa.chunked_array([h[2] for h in held]).dictionary_encode().combine_chunks()
        langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]))
        names = words.dictionary
        end, empty = (pc.index(names, pa.scalar(x, names.type)).as_py() for x in (END, ""))
        pair = np.where(code == end, -1, lang * len(names) + code)
        if empty >= 0:
            pair = pair[code != empty]
        # -1, the piece end, is there at least once and becomes 0; common words get small ids, which pack well.
        used, ids, times = np.unique(np.concatenate([[-1], pair]), return_inverse=True, return_counts=True)
        order = np.concatenate([[0], 1 + np.argsort(-times[1:], kind="stable")])
        place = np.empty(len(used), np.int32)
        place[order] = np.arange(len(used), dtype=np.int32)
        used, ids, times = used[order], place[ids], times[order]
        lang_of, word_of = np.divmod(used[1:], len(names))
        hashes = mixed(hashed(names)[word_of] * constants(1, 3)[0] + hashed(langs.dictionary)[lang_of])
        lang_of, word_of = langs.dictionary.take(pa.array(lang_of)), names.take(pa.array(word_of))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values.cast(kind))
        # Byte by byte of the ids, as the upper bytes are nearly all alike.
        binary = lambda x: pa.array([x.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())
        columns = [one(lang_of, pa.string()), one(word_of, pa.string()), one(hashes.view(np.int64), pa.int64()), one(langs.dictionary, pa.string())]
        columns.append(one(np.bincount(lang[(code != end) & (code != empty)], minlength=len(langs.dictionary)).astype(np.int64), pa.int64()))
        columns += [binary(transform(ids, depth)), binary(transform(ids[::-1], depth))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "langs", "words", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            words, per = tokens(b.column("text"))
            held.append((words, per, b.column("lang")))
            n += len(words)
            if n >= shard_words:
                yield made(held)
                held, n = [], 0
        if n:
            yield made(held)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, INDEX)


def shards_of(b: pa.RecordBatch) -> Iterator[tuple[Shard, pa.Array, pa.Array]]:
    for i in range(b.num_rows):
        words, langs = (b.column(c)[i].values for c in ("word", "lang"))
        hashes = np.concatenate([[np.uint64(0)], b.column("hash")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)])
        left, right = (np.ascontiguousarray(np.frombuffer(b.column(c)[i].as_buffer(), np.uint8).reshape(4, -1).T).view(np.int32)[:, 0] for c in ("left", "right"))
        yield Shard(left, right, hashes), langs, words


def bitmap(sums: DataFrame, at_least: int, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits: those whose counts add up to ``at_least``. sums: what ``sparse`` gives. The rows of a span
    stream through one task, which holds one span; the driver gets the bits."""
    size = SPAN * PLACES

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(size, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(counts >= at_least, bitorder="little").tobytes()], pa.binary())], names=["span", "set"])

        for b in batches:
            for span, per, places, n in zip(b.column("span").to_pylist(), b.column("per"), b.column("places"), b.column("n"), strict=True):
                if span != at:
                    if at is not None:
                        yield done()
                    at = span
                    counts[:] = 0
                base = np.repeat(np.arange(0, size, PLACES), np.frombuffer(per.as_buffer(), np.uint32))
                counts[base + np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint8)
        if at is not None:
            yield done()

    out = np.zeros(max(1 << bits, size) // 8, np.uint8)
    for r in sums.repartition("span").sortWithinPartitions("span").mapInArrow(merge, "span int, set binary").toLocalIterator():
        out[r["span"] * size // 8 : (r["span"] + 1) * size // 8] = np.frombuffer(bytes(r["set"]), np.uint8)
    return out[: (1 << bits) // 8]


def sparse(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts (up to 255) that are not 0: span (of SPAN blocks), how many in each of its blocks, places in the block,
    counts."""
    found = np.flatnonzero(counts)
    cuts = np.searchsorted(found, np.arange(0, max(len(counts), SPAN * PLACES) + 1, PLACES))
    for span in range((len(cuts) - 1) // SPAN):
        ends = cuts[span * SPAN : (span + 1) * SPAN + 1]
        at = found[ends[0] : ends[-1]]
        if len(at):
            parts = (np.diff(ends).astype(np.uint32), (at % PLACES).astype(np.uint16), counts[at])
            yield pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["span", "per", "places", "n"])


def phrase_counts(docs: DataFrame, at_least: int = 30, longest: int = 4, shard_words: int = 1_000_000, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) for all phrases of k <= ``longest`` words with f >= ``at_least``, and (lang, n) for all words.

    ``bits`` sets the size of the bitmaps (2 ** bits bits; by default a quarter of the number of words, at least 2 ** 16 and at
    most 2 ** 27, which is 16 MB), which only save work: phrases that share a bit are counted
    together for it, so that with too few bits more rows are summed at the end; the result stays. A null lang is 'und';
    null and empty texts have no words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = new_path(spark, "index")
    # A file for each shard, so that no reader holds several.
    indexes(docs, longest, shard_words).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    index = spark.read.schema(INDEX).parquet(path)
    totals = written(index.select(F.explode(F.arrays_zip("langs", "words")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.words").alias("n")).filter("n > 0"), "totals")
    if bits is None:
        bits = max(16, min(27, int((totals.agg(F.sum("n")).first()[0] or 0) // 4).bit_length()))
    bitmaps: list[np.ndarray] = []

    def counted() -> DataFrame:
        shipped = spark.sparkContext.broadcast(list(bitmaps))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, langs, words in shards_of(b):
                    for size, found in enumerate(enumerated(shard, shipped.value, longest), 1):
                        part = lambda s, j, f=found: words.take(pa.array(f["ids"][s, j] - 1))  # noqa: B023, E731
                        yield from pieces({
                            "lang": lambda s, f=found: langs.take(pa.array(f["ids"][s, 0] - 1)),  # noqa: B023
                            "phrase": lambda s, z=size, p=part: pc.binary_join_element_wise(*(p(s, j) for j in range(z)), " "),
                            "k": lambda s, f=found, z=size: pa.array(np.full(len(f["size"][s]), z, np.int32)),
                            "n": lambda s, f=found: pa.array(f["size"][s].astype(np.int64)),
                        }, len(found["size"]))

        return shards.mapInArrow(run, "lang string, phrase string, k int, n long")

    def summed(k: int) -> DataFrame:
        """What a task's shards count in each place, up to what it takes to be frequent."""
        shipped = spark.sparkContext.broadcast(list(bitmaps))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << bits, np.uint8)
            for b in batches:
                for shard, _, _ in shards_of(b):
                    for found in enumerated(shard, shipped.value, k):
                        pass
                    at, place = np.unique(shard.phrase_hashes(found["ids"]) % np.uint64(1 << bits), return_inverse=True)
                    total[at] = np.minimum(total[at] + np.bincount(place, found["size"], len(at)), enough)
            yield from sparse(total)

        return shards.mapInArrow(run, "span int, per binary, places binary, n binary")

    # Two tasks a core, so that a task adds up many shards before it sends anything, but no more than so many shards each.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-len(index.inputFiles()) // SHARDS_A_TASK))
    shards, enough = index.select("lang", "word", "hash", "left", "right").coalesce(tasks), min(at_least, 255)
    with batches_of(spark, 1):
        for k in range(1, longest + 1):
            bitmaps.append(bitmap(summed(k), enough, bits))
        counts = written(counted().groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).filter(F.col("f") >= at_least), "counts")
    drop_path(spark, path)
    return counts, totals


def pieces(columns: dict, n: int, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; each column is made for its slice."""
    for i in range(0, n, rows):
        s = slice(i, i + rows)
        yield pa.RecordBatch.from_arrays([make(s) for make in columns.values()], names=list(columns))


def collocations(docs: DataFrame, at_least: int = 30, longest: int = 4, per_lang: int = 2000, covered: int = 80, **how) -> DataFrame:
    """Each lang's ``per_lang`` best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    a: how often the phrase stands within pieces (overlaps count); l and r: the same of the two parts of its worst cut,
    the one with the least floor(2000000 a / (l + r)), which is the score (ties: the earlier cut). A phrase is left out if
    one that is longer by words on either side has covered in 100 of its places or more; looking at one word more is
    enough, as the part of a longer one in between stands there at least as often. n: all words of the lang. A null lang
    is 'und'. Null and empty texts have no words; rows that repeat an id count each. Columns besides lang and text are not
    read. An empty table gives none.
    """
    counts, totals = phrase_counts(docs, at_least, longest, **how)
    phrases = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = phrases.withColumn("cut", cut).withColumns({"head": F.array_join(F.slice(words, 1, F.col("cut")), " "), "tail": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ")})
    # A word may be a part of very many phrases: the parts that most phrases have are broadcast.
    uses = cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("uses"))
    parts = written(uses.join(counts.select("lang", "phrase", "f"), ["lang", "phrase"]), "parts")

    def counted(rows: DataFrame, part: str, name: str) -> DataFrame:
        at = met(rows, parts.withColumnRenamed("phrase", part), ["lang", part], "uses", ["lang", "phrase"])
        return at.withColumn(name, F.col("met.f")).drop("met")

    cuts = counted(counted(cuts, "head", "l"), "tail", "r")
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = cuts.withColumns({"top": F.lit(2_000_000).cast("decimal(7,0)") * wide(F.col("a")), "below": wide(F.col("l")) + wide(F.col("r"))}).withColumn("score", F.expr("top div below"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at")).select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")))
    around = phrases.filter("k > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = worst.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide(F.col("longer")) < covered * wide(F.col("a"))))
    best = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= per_lang)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT doc_id, lang, i, words FROM (
             SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(range(len(s))) AS i, regexp_extract_all(unnest(s), '[^\x20\x09]+') AS words
             FROM (SELECT doc_id, lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS s FROM documents)
           ) WHERE len(words) > 0),
     g AS (SELECT lang, k, array_to_string(words[j:j + k - 1], ' ') AS phrase
           FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS j FROM p, range(1, 5) r(k) WHERE len(words) >= k)),
     total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
     f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
     cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     cuts AS (SELECT c.lang, c.phrase, c.a, c.k, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
              JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
     worst AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     inside AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
                FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS s FROM cand, range(2, 4) r(m) WHERE m < k) GROUP BY ALL),
     best AS (SELECT worst.*, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, phrase) AS rank
              FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000
"""
