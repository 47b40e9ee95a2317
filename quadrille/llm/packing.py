"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import slices, table

LENGTH = 1024
END = 2
#: Open bins that a packing task holds at most.
OPEN_BINS = 4096
#: Pieces that are looked at together, longest first; fewer than open bins, so that what a window leaves open, the next ones fill.
WINDOW = 2000
#: Documents for each packing task.
ROWS_PER_PART = 100_000
#: Words that a worker keeps encoded; the table is emptied when full, which changes no result.
CACHED = 600_000


class Encoder(dict):
    """Ids, as little-endian bytes, of a space and a word. Reads one vocabulary in its two forms: ranks, and the
    special tokens that the library `tokenizers` finds in a text, which are one id each here as well.

    A pre-token never runs from another character into white space, so a text may be cut before
    any space that follows a character other than white space. None marks a word that ends in
    white space or is empty: such a text is encoded whole.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as whole:
            self.special = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
        self.ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def whole(self, text: str) -> bytes:
        import numpy as np

        found = any(token in text for token in self.special)
        return np.array(self.ids.encode(text, allowed_special="all") if found else self.ids.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHED:
            self.clear()
        out = None if not word or word[-1].isspace() else self.whole(" " + word)
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        last = rest.pop()  # may end in white space: nothing follows it
        try:
            return b"".join([self.whole(first), *map(self.__getitem__, rest), self.whole(" " + last)])
        except TypeError:
            return self.whole(text)


@lru_cache(maxsize=1)
def encoder() -> Encoder:
    return Encoder()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(batches: Iterator[pa.RecordBatch], length: int, end: int) -> Iterator[pa.RecordBatch]:
    enc, tail = encoder(), end.to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch):
            out: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = enc.encode(text or "") + tail
                n = len(ids) // 4
                first = n % length or length
                for piece, start in enumerate([0, *range(first, n, length)]):
                    stop = first if piece == 0 else start + length
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


class BestFit:
    """Bounded-space best fit. Bit f of `held` tells that an open bin has f free; lowest bits are found at once."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.held, self.n_open, self.n_bins = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        self.n_open -= 1
        if not self.bins[free]:
            self.held &= ~(1 << free)
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset of the next item: the open bin that it fills best, else a new one."""
        fitting = self.held >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.n_bins
            self.n_bins += 1
        if free > size:
            self.bins[free - size].append(bin_)
            self.held |= 1 << (free - size)
            self.n_open += 1
            if self.n_open > self.most:  # the fullest bin closes
                self._take((self.held & -self.held).bit_length() - 1)
        return bin_, self.length - free


def fill(batches: Iterator[pa.RecordBatch], length: int, open_bins: int, window: int) -> Iterator[pa.RecordBatch]:
    """Each piece's bin and offset, in the order of the stream: windows one after the other, each window's pieces longest first."""
    import numpy as np

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held: list[pa.RecordBatch] = []
    part, packer = None, None

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows["length"].to_numpy()
        ids, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k in np.argsort(-sizes, kind="stable").tolist():
            bin_, offsets[k] = packer.put(int(sizes[k]))
            ids[k] = part << 32 | bin_
        held.clear()
        return pa.RecordBatch.from_arrays([*[rows[c].combine_chunks() for c in names], pa.array(ids), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    for batch in batches:
        parts = batch["part"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b and int(parts[a]) != part:
                if held:
                    yield packed()
                part, packer = int(parts[a]), BestFit(length, open_bins)
            while a < b:
                some = min(b - a, window - sum(h.num_rows for h in held))
                held.append(batch.slice(a, some))
                a += some
                if sum(h.num_rows for h in held) == window:
                    yield packed()
    if held:
        yield packed()


def pack(df: DataFrame, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS, rows: int | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents (doc_id, text) and each one's place in a sequence.

    Each text is encoded once, in the task that reads it; only the pieces' lengths move on. They
    are dealt evenly by a hash into parts of about ROWS_PER_PART documents, and packed as they come, in the
    order of a hash, by bounded-space best fit with a window of some pieces, longest first. A lost task
    can be run again with the same outcome. Only documents over
    `length` are cut; their first piece takes the rest, the others are full sequences.
    Equal rows are dealt apart, so no id and no text fills a part.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come;
    a null id stays null. Columns other than doc_id and text are ignored.
    """
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // ROWS_PER_PART))
    pieces = df.select("doc_id", "text").mapInArrow(lambda b: cut(b, length, end), PIECES)
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = (
        pieces.withColumn("place", place).withColumn("part", F.pmod("place", F.lit(parts)))
        .repartition(parts, "part")
        .sortWithinPartitions("part", F.xxhash64("place", F.lit("order")), "doc_id", "piece", "ids_crc32")
    )
    return dealt.mapInArrow(lambda b: fill(b, length, open_bins, window), f"{PIECES}, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
