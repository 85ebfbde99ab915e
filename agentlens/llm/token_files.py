"""Token ids in canonical length-limited Huffman code, in files of independent blocks.

Writing: every text becomes ids once (kept as a compact table in the shared folder), the ids are counted on the way (at
most one count a task for each id of the vocabulary), package-merge gives code lengths of at most ``limit`` bits, and
each range of doc_ids is coded by one task into one file. Reading: a table of 2 ** limit entries gives symbol and length
for the next bits; every checkpoint (a bit offset for each ``EVERY`` ids) is decoded side by side with the others.

File: the bytes ``HUF1``; then blocks, one after the other. Block: five uint64 (bytes of the rest of the block, documents,
ids, checkpoints, bytes of code), doc_ids (int64, with a byte each that marks a null), ids of each document (uint32),
checkpoint bit offsets (uint64), code bits, most significant first, and eight bytes of zeros. Numbers are little-endian.
``codebook`` beside the files holds the code length of each id as a byte; ``manifest.json`` names the files in order with
the number of ids before each. A task writes under a name of its own, and only names of finished tasks reach the
manifest, so a lost executor's or a repeated attempt's file is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, new_path, table

EVERY, BLOCK_IDS, FILE_IDS = 128, 500_000, 16_000_000
MAGIC = b"HUF1"
#: White space, for RE2; a text where a space or a line feed stands at an end or beside other white space (or which has a
#: zero byte) is tangled: it is cut by ``SINGLE`` alone.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TANGLED = rf"\x00|(?:^|[{WHITE}])[ \n]|[ \n](?:$|[{WHITE}])"
SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: A stretch that keeps its ids as a line between others: not empty, and no white space at its ends but one space before.
LINE = re.compile(r" ?\S(?:[^\n]*\S)?")
#: One piece of the vocabulary's pattern, as it stands.
PIECE = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: Marks that begin a piece of their own after a letter; the last letter (of Unicode's oldest blocks) is looked at.
TAIL, LETTERS = ".,;:!?#$%&*()=+-/", "\u024f"
#: Bytes of text that are cut and put together at a time (one longer text stands alone), bytes to which small batches are
#: gathered, and unseen stretches a call.
SLICE_BYTES, GATHER_BYTES, TOGETHER = 32_000_000, 4_000_000, 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded memory of stretches.

    The vocabulary's pattern starts a new piece at every single space and around every single line feed between two
    characters that are not white space, and never joins across it, so the stretches' ids in a row are the ids of the
    whole text. So it is between a letter and the marks after it, which are cut off before a new stretch is encoded.
    Texts are cut and ids put together as Arrow and numpy columns; each different stretch of a batch is looked up once.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_padding()
        self.inner.no_truncation()
        self.dtype = np.dtype("<u2") if self.inner.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        feed = self.inner.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.split, self.whole = self.inner.pre_tokenizer, self._unsplit()
        added = "".join(x.content for x in self.inner.get_added_tokens_decoder().values())
        self.tail = "".join(c for c in TAIL if c not in added)
        # Two generations: what the older one still has is not encoded again when the newer one is full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def _unsplit(self):
        """What cuts a text for lines of one piece each, in which no piece need be looked for; as it stands if the pattern is
        another. The tokenizer gets it for these lines only, as a second one would hold the vocabulary once more."""
        from tokenizers import pre_tokenizers

        splitter = json.loads(self.inner.to_str())["pre_tokenizer"] or {}
        if splitter.get("type") != "ByteLevel" or not splitter.get("use_regex") or splitter.get("add_prefix_space"):
            return self.split
        return pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes stretches: those that end in marks as what stands before these, and the marks."""
        bodies = [s.rstrip(self.tail) for s in new]
        parted = [(s, x, s[len(x) :]) for s, x in zip(new, bodies, strict=True) if len(x) < len(s) and x[-1:].isalpha() and x[-1] <= LETTERS]
        apart = {s for s, _, _ in parted}
        found = {x: self.older.get(x) for _, *both in parted for x in both if x not in self.known}
        self.known.update((x, ids) for x, ids in found.items() if ids is not None)
        self._encoded(list(dict.fromkeys([*(s for s in new if s not in apart), *(x for x, ids in found.items() if ids is None)])))
        self.known.update((s, self.known[x] + self.known[tail]) for s, x, tail in parted)

    def _encoded(self, new: list[str]) -> None:
        """Encodes stretches many at a time, as lines of one text; what may not stand in a line by itself."""
        pieces, lines, alone = [], [], []
        for s in new:
            (alone if self.feed is None else pieces if PIECE.fullmatch(s) else lines if LINE.fullmatch(s) else alone).append(s)
        if pieces and self.whole is not self.split:
            self.inner.pre_tokenizer = self.whole
            try:
                self._lines(pieces)
            finally:
                self.inner.pre_tokenizer = self.split
        else:
            self._lines(pieces)
        self._lines(lines)
        for i in range(0, len(alone), TOGETHER):
            some = alone[i : i + TOGETHER]
            self.known.update((s, x.tobytes()) for s, x in zip(some, self._raw(some), strict=True))

    def _lines(self, new: list[str]) -> None:
        for some in (new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)):
            (ids,) = self._raw(["\n".join(some) + "\n"])
            blob, cuts, begin, width = ids.tobytes(), np.flatnonzero(ids == self.feed).tolist(), 0, self.dtype.itemsize
            for s, end in zip(some, cuts, strict=True):
                self.known[s] = blob[begin * width : end * width]
                begin = end + 1

    def of_stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids of different stretches."""
        got = list(map(self.known.get, stretches))
        new = [s for s, x in zip(stretches, got, strict=True) if x is None]
        if not new:
            return got
        if len(self.known) + len(new) > self.limit:
            self.known, self.older = {}, self.known
        if self.older:
            self.known.update((s, x) for s in new if (x := self.older.get(s)) is not None)
            self._learn([s for s in new if s not in self.known])
        else:
            self._learn(new)
        return [self.known[s] if x is None else x for s, x in zip(stretches, got, strict=True)]

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """The ids of each text, with ``end``, as bytes; null counts as empty."""
        texts = pc.fill_null(texts, "")
        tangled = pc.match_substring_regex(texts, TANGLED)
        if not pc.any(tangled).as_py():
            return self._joined(self._cut(texts), end)
        plain, rest = texts.filter(pc.invert(tangled)), texts.filter(tangled)
        single = [[first, *[" " + x for x in others]] for first, *others in map(SINGLE.split, rest.to_pylist())]
        both = pa.concat_arrays([self._joined(self._cut(plain), end), self._joined(pa.array(single, pa.list_(pa.string())), end)])
        order = np.argsort(tangled.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return both.take(pa.array(back))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def _joined(self, cut: pa.Array, end: int) -> pa.Array:
        if not len(cut):
            return pa.array([], pa.binary())
        coded = cut.flatten().dictionary_encode()
        ids = pa.array(self.of_stretches(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64) // self.dtype.itemsize
        out = np.frombuffer(ids.buffers()[2] or b"", self.dtype)[: ends[-1]]
        cuts = ends[cut.offsets.to_numpy()]
        out = np.insert(out, cuts[1:], end)
        offsets = (cuts + np.arange(len(cuts))) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its memory serves all the tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drops this worker's encoders: the tasks after the encoding need them no more, and later stages run in the same worker."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, while their texts have less than ``GATHER_BYTES``; a larger batch stands alone."""
    held, size = [], 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch["text"])).as_py() or 0
        if held and size + n > GATHER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held, size = [*held, batch], size + n
    if held:
        yield pa.concat_batches(held)


def slices(texts: pa.Array) -> Iterator[slice]:
    """Consecutive rows of about ``SLICE_BYTES`` of text."""
    turn = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(texts)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


TOKENISED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (bytes, 2 or 4 an id), with the end id; null and empty texts have the end id alone. The last row of a
    task has ``counts`` instead (int64 for each id up to the largest one) of all its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, total = encoder(tokenizer), np.zeros(0, np.int64)
        for batch in gathered(batches):
            for part in slices(batch["text"]):
                texts = batch["text"].slice(part.start, part.stop - part.start)
                ids = coder.encode(texts, end_id)
                some = np.bincount(np.frombuffer(ids.buffers()[2], coder.dtype))
                total, some = (some, total) if len(some) > len(total) else (total, some)
                total[: len(some)] += some
                yield pa.record_batch([batch["doc_id"].slice(part.start, len(texts)), ids, pa.nulls(len(texts), pa.binary())], schema=TOKENISED)
            # Else Arrow keeps what a batch took beside what the encoder remembers.
            pa.default_memory_pool().release_unused()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=TOKENISED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def counts(made: DataFrame) -> DataFrame:
    """id, n over all documents; each task of ``tokenised`` sends at most one row an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            for blob in batch["counts"]:
                n = np.frombuffer(blob, np.int64)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"id": at, "n": n[at]})

    return made.filter("counts IS NOT NULL").select("counts").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge: lengths of an optimal prefix code of at most ``limit`` bits; 0 for weight 0."""
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.lexsort((used, weights[used]))]
    leaves = weights[order].astype(np.float64)
    current, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both, kind = np.concatenate([leaves, pairs]), np.concatenate([np.ones(len(leaves), bool), np.zeros(len(pairs), bool)])
        by = np.argsort(both, kind="stable")
        current = both[by]
        is_leaf.append(kind[by])
    take = 2 * len(leaves) - 2
    for kind in reversed(is_leaf):
        n = int(kind[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        before = n
        at = np.flatnonzero(lengths == n)
        codes[at] = code + np.arange(len(at), dtype=np.uint32)
        code += len(at)
    return codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Checkpoint bit offsets and the code bits. A code of at most 32 bits touches two 32-bit words at most; words are
    put together by sums of disjoint bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    shift = 64 - (starts & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    word = starts >> 5
    out = np.zeros(int(ends[-1] + 31) // 32 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return starts[::EVERY].astype("<u8"), out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8]


def unpacked(code: bytes, offsets: np.ndarray, n: int, table_: np.ndarray, limit: int) -> np.ndarray:
    """n ids: all checkpoints step through the table side by side. table_: symbol * 64 + length by the next bits."""
    data = np.frombuffer(code, np.uint8)
    # The 32 bits from each byte on as one number, so that a lane needs one look-up an id.
    view = np.lib.stride_tricks.sliding_window_view(data, 4)
    at = offsets.astype(np.int64)
    out = np.empty((EVERY, len(at)), np.uint32)
    weights = np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    words = np.zeros(len(view), np.uint32)
    for k in range(4):
        words += view[:, k].astype(np.uint32) * weights[k]
    top = len(words) - 1
    for step in range(EVERY):
        hit = table_[(words[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)]
        out[step] = hit >> 6
        at += hit & 63
    return out.T.reshape(-1)[:n]


def decode_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    codes, out = canonical(lengths), np.zeros(1 << limit, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[used].astype(np.int64))
    filled = np.repeat(used.astype(np.int64) * 64 + lengths[used], spans)
    out[: len(filled)] = filled
    assert not len(used) or codes[used[0]] == 0
    return out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _block(rows: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([r[1] for r in rows])
    offsets, code = packed(ids, lengths, codes)
    doc = np.array([r[0] or 0 for r in rows], "<i8").tobytes() + bytes(r[0] is None for r in rows)
    rest = doc + np.array([len(r[1]) for r in rows], "<u4").tobytes() + offsets.tobytes() + code + bytes(8)
    return struct.pack("<5Q", len(rest), len(rows), len(ids), len(offsets), len(code) + 8) + rest


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, limit: int = 16) -> dict:
    """Encodes ``docs`` into files under ``path`` (a folder that driver and executors share) in ascending doc_id order,
    null ids first; returns the manifest. Rows that repeat an id follow each other in the order of their ids' crc32."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    bounded_batches(spark)
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if size <= 1 << 16 else 4
    limit = max(limit, int(np.ceil(np.log2(max(2, size)))))
    ids_path = new_path(spark, "ids")
    tokenised(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(ids_path)
    made = spark.read.schema("doc_id long, ids binary, counts binary").parquet(ids_path)
    ids = made.filter("ids IS NOT NULL").select("doc_id", "ids")
    found = counts(made).toPandas()
    weights = np.zeros(max(size, end_id + 1), np.int64)
    weights[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(weights, limit)
    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/codebook") as f:
        f.write(lengths.tobytes())
    shipped = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        forget()
        lengths = shipped.value
        codes = canonical(lengths)
        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        fs, root = _filesystem(path)
        docs_in = ids_in = 0
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(MAGIC)
            rows, held = [], 0
            for batch in batches:
                for doc_id, blob in zip(batch["doc_id"], batch["ids"], strict=True):
                    x = np.frombuffer(blob, f"<u{width}")
                    if rows and held + len(x) > BLOCK_IDS:
                        f.write(_block(rows, lengths, codes))
                        rows, held = [], 0
                    rows.append((None if pd.isna(doc_id) else int(doc_id), x))
                    held, docs_in, ids_in = held + len(x), docs_in + 1, ids_in + len(x)
            if rows:
                f.write(_block(rows, lengths, codes))
        yield pd.DataFrame({"part": [part], "name": [name], "docs": [docs_in], "ids": [ids_in]})

    files = max(1, -(-int(weights.sum()) // FILE_IDS))
    ordered = ids.withColumn("tie", F.crc32("ids")).repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    # One row a file.
    parts = sorted(ordered.select("doc_id", "ids").mapInPandas(run, "part int, name string, docs long, ids long").collect(), key=lambda r: r["part"])
    start, listed = 0, []
    for r in parts:
        if r["docs"]:
            listed.append({"name": r["name"], "start": start, "docs": r["docs"], "ids": r["ids"]})
            start += r["ids"]
    manifest = {"limit": limit, "end_id": end_id, "ids": start, "files": listed}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    from agentlens.llm.common import drop_path

    drop_path(spark, ids_path)
    return manifest


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian uint32), from the
    files alone; with ``with_ids`` also ids as an array. One task a file; a block at a time is in memory."""
    fs, root = _filesystem(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    with fs.open_input_stream(f"{root}/codebook") as f:
        lengths = np.frombuffer(f.read(), np.uint8)
    limit, files = manifest["limit"], manifest["files"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not files:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast((lengths, files))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        lengths, files = shipped.value
        look, (fs, root) = decode_table(lengths, limit), _filesystem(path)
        for batch in batches:
            for k in batch["id"]:
                start = files[k]["start"]
                with fs.open_input_stream(f"{root}/{files[k]['name']}") as f:
                    if f.read(4) != MAGIC:
                        raise ValueError(f"{files[k]['name']} is not a token file")
                    while head := f.read(40):
                        rest, docs, n, marks, coded = struct.unpack("<5Q", head)
                        body = f.read(rest)
                        doc = np.frombuffer(body, "<i8", docs)
                        null = np.frombuffer(body, np.uint8, docs, 8 * docs) > 0
                        sizes = np.frombuffer(body, "<u4", docs, 9 * docs).astype(np.int64)
                        offsets = np.frombuffer(body, "<u8", marks, 13 * docs)
                        ids = np.ascontiguousarray(unpacked(body[rest - coded :], offsets, n, look, limit), "<u4")
                        ends = np.cumsum(sizes)
                        raw = memoryview(ids.tobytes())
                        out = {"doc_id": pd.Series(doc).astype("Int64").mask(null), "start": start + ends - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes, ends, strict=True)]}
                        if with_ids:
                            out["ids"] = [ids[e - s : e].astype(np.int64) for s, e in zip(sizes, ends, strict=True)]
                        yield pd.DataFrame(out)
                        start += n

    return spark.range(0, len(files), 1, len(files)).mapInPandas(run, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as token files into the shared folder and reads them back; see ``write_token_files`` and
    ``read_token_files``. Null and empty texts hold the end id alone; an empty table gives no rows; other columns than
    doc_id and text are not read."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)


def op9(spark, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
