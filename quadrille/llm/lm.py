"""N-gram language-model scores from Elias-Fano tries of quantised probabilities, one for each part of the text."""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import flat_words, partitions, remainder, table
from quadrille.plans.stages import stored

HELD_OUT = 10
#: What a context's next words are expected to be before any is seen, in occurrences: the weight of the model with one word of context less.
PRIOR = {2: 8.0, 3: 4.0}
END = 0x9E3779B97F4A7C15
#: Bytes of text of a part (a longer text is a part of its own), and n-grams whose counts one group sums, about.
PART_BYTES, GROUP_GRAMS = 5 << 20, 2_000_000
#: Steps of a quantised logarithm to base 10.
STEPS = 2048


class EliasFano:
    """A nondecreasing sequence: low bits packed, high bits as a bit vector with one 1 for each value."""

    def __init__(self, values, universe: int):
        import numpy as np

        values = np.asarray(values, np.uint64)
        self.n = len(values)
        self.low_bits = max(0, int(universe // max(1, self.n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        bits = (low[:, None] >> np.arange(self.low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        self.low = np.packbits(bits.astype(np.uint8), bitorder="little")
        places = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        high = np.zeros((universe >> self.low_bits) + self.n + 1, np.uint8)
        high[places] = 1
        self.high = np.packbits(high, bitorder="little")
        self.size = len(high)

    def opened(self) -> EliasFano:
        """Maps the levels into memory, with a directory of where each high part's values begin."""
        import numpy as np

        zeros = np.flatnonzero(np.unpackbits(self.high, count=self.size, bitorder="little") == 0)
        self.begin = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int32)
        self.low = mapped(np.concatenate([self.low, np.zeros(16, np.uint8)]))
        return self

    def low_at(self, i):
        import numpy as np

        at = i * self.low_bits
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            word |= self.low[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def find(self, targets):
        """Place of each target, -1 where it isn't there: the successor among the values of its high part."""
        import numpy as np

        targets = np.asarray(targets, np.uint64)
        part = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        inside = part < len(self.begin) - 1
        part = np.where(inside, part, 0)
        lo, hi = self.begin[part].astype(np.int64), np.where(inside, self.begin[np.minimum(part + 1, len(self.begin) - 1)], 0).astype(np.int64)
        stop, want = hi.copy(), targets & np.uint64((1 << self.low_bits) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.low_at(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        found = np.full(len(targets), -1, np.int64)
        some = np.flatnonzero(lo < stop)
        some = some[self.low_at(lo[some]) == want[some]]
        found[some] = lo[some]
        return found


def mapped(array):
    """The array in an anonymous memory map."""
    import numpy as np

    raw = array.tobytes()
    area = mmap.mmap(-1, max(1, len(raw)))
    area.write(raw)
    return np.frombuffer(area, array.dtype, len(array))


class Quantised:
    """Logarithms to base 10, from 0 down to -32, in two bytes each on a fixed grid; never rounded up, so probabilities don't sum to more than 1."""

    def __init__(self, values):
        import numpy as np

        self.code = mapped(np.minimum(np.ceil(-np.asarray(values, float) * STEPS - 1e-9), 65535).astype(np.uint16))

    def __getitem__(self, i):
        return self.code[i] / -STEPS

    def __len__(self):
        return len(self.code)


class Trie:
    """Levels of words, bigrams and trigrams with their counts in training. A bigram's key is its context's id and its word; a
    trigram's is its context's place in the level above and its word, so each context's words are a run of a monotone sequence.

    Levels hold quantised log10 probabilities and back-off weights. A context that came c times gives its word
    (n + prior * p) / (c + prior), p being the probability with one word of context less: for a word that never came after it
    this is its weight prior / (c + prior) times p. Probabilities of all words after a context sum to 1 at most.
    """

    def __init__(self, counts, bigrams, n2, trigrams, n3, tokens: int, words: int):
        import numpy as np

        self.bits = max(1, int(len(counts)).bit_length())
        mask = (1 << self.bits) - 1
        uni = (counts + 0.1) / (tokens + 0.1 * (words + 1))
        self.uni = np.log10(uni)
        a, b = bigrams >> self.bits, bigrams & mask
        self.bow1 = Quantised(np.log10(PRIOR[2] / (counts + PRIOR[2])))
        p2 = (n2 + PRIOR[2] * uni[b]) / (counts[a] + PRIOR[2])
        self.p2, self.bow2 = Quantised(np.log10(p2)), Quantised(np.log10(PRIOR[3] / (n2 + PRIOR[3])))
        context, word = trigrams >> self.bits, trigrams & mask
        lower = np.searchsorted(bigrams, (b[context] << self.bits) | word)  # a trigram that came has bigrams that came
        self.p3 = Quantised(np.log10((n3 + PRIOR[3] * p2[lower]) / (n2[context] + PRIOR[3])))
        self.level2 = EliasFano(bigrams, max(1, len(counts)) << self.bits).opened()
        self.level3 = EliasFano(trigrams, max(1, len(bigrams)) << self.bits).opened()

    def logs(self, part: Part):
        """log10 of the probability of each token of a part, of whose words the trie's first level is made."""
        import numpy as np

        (_, _, ids), (two, at2, which2), (three, at3, which3) = part.levels()
        n = len(ids)
        place2 = self.level2.find(((two >> 32) << self.bits) | (two & 0xFFFFFFFF))
        context = place2[three >> 32] if len(three) else np.zeros(0, np.int64)
        place3 = np.full(len(three), -1, np.int64)
        some = np.flatnonzero(context >= 0)
        place3[some] = self.level3.find((context[some] << self.bits) | (three[some] & 0xFFFFFFFF))
        out = self.uni[ids]
        # of each bigram, and then of each trigram, what it says in place of what was known
        p2 = np.where(place2 >= 0, self.p2[place2] if len(self.p2) else 0.0, self.bow1[two >> 32] + self.uni[two & 0xFFFFFFFF])
        out[at2] = p2[which2]
        if len(three):
            weight = np.where(context >= 0, self.bow2[context] if len(self.p2) else 0.0, 0.0)
            lower = np.zeros(n)
            lower[at3] = weight[which3]
            out += lower
            hit = place3[which3] >= 0
            out[at3[hit]] = self.p3[place3[which3[hit]]]
        return out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded text size (a longer text comes alone)."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            at = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)


def sequences(texts: pa.Array):
    """Hashes of all tokens, each text's end included, and the offsets of the texts' tokens."""
    import numpy as np
    import xxhash

    words, offsets = flat_words(texts)
    named = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(named.dictionary))
    out = np.insert(each[named.indices.to_numpy()], offsets[1:], np.uint64(END))
    return out, offsets + np.arange(len(offsets))


def _pressed(numbers) -> bytes:
    """Non-negative integers below 2^32 as bytes, place by place, compressed."""
    import numpy as np

    return zlib.compress(np.ascontiguousarray(np.asarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpressed(raw: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


class Part:
    """A part of the text: its documents, its distinct words by hash, and its tokens as places among them."""

    def __init__(self, words, ids, offsets, learned):
        self.words, self.ids, self.offsets, self.learned = words, ids, offsets, learned

    @classmethod
    def read(cls, row: dict) -> Part:
        import numpy as np

        n = _unpressed(row["n"])
        return cls(np.frombuffer(row["words"], np.uint64), _unpressed(row["ids"]), np.concatenate([[0], np.cumsum(n)]), np.frombuffer(row["learned"], bool))

    def levels(self):
        """For words, bigrams and trigrams: (distinct n-grams, the last token of each n-gram, which of them it is). An n-gram of tokens lies
        in one text; each is named by the place of the n-gram without its last word, and its last word."""
        import numpy as np

        if not hasattr(self, "_levels"):
            self._levels = [(np.arange(len(self.words)), np.arange(len(self.ids)), self.ids)]
            first = np.zeros(len(self.ids), bool)
            first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
            place = self.ids
            for _ in range(2):
                now = np.flatnonzero(~first & (np.concatenate([[-1], place[:-1]]) >= 0))
                keys, which = np.unique((place[now - 1] << 32) | self.ids[now], return_inverse=True)
                place = np.full(len(self.ids), -1, np.int64)
                place[now] = which
                self._levels.append((keys, now, which))
        return self._levels

    def dealt(self, order: int, buckets: int):
        """(hashes, buckets, counts in training, order by bucket) of the distinct n-grams; equal n-grams have equal hashes in all parts."""
        import numpy as np

        keys, at, which = self.levels()[order - 1]
        some = np.zeros(len(keys), np.int64)
        some[which] = at  # where each n-gram ends, once
        h = np.full(len(keys), order, np.uint64)
        for back in range(order - 1, -1, -1):
            h = _stirred(h + self.words[self.ids[some - back]])
        learned = np.repeat(self.learned, np.diff(self.offsets))[at]
        counts = np.bincount(which[learned], minlength=len(keys))
        bucket = ((h >> np.uint64(48)) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(32))) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16 if buckets < 65536 else np.int64)
        return h, bucket, counts, np.argsort(bucket, kind="stable")


def _stirred(x):
    """A bijection of 64-bit numbers that spreads their bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PART = "part long, doc_ids binary, missing binary, learned binary, n binary, words binary, ids binary, tokens long, training long, bucket int, counts binary"
_EMPTY = {"doc_ids": None, "missing": None, "learned": None, "n": None, "words": None, "ids": None, "tokens": None, "training": None, "bucket": None, "counts": None}


def _stored_parts(docs: DataFrame) -> DataFrame:
    """A row for each part of docs(doc_id, text, held_out), stored, so that a part's number stays."""
    import numpy as np

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in parts(batches):
            hashes, offsets = sequences(part["text"])
            words, ids, often = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            learned = ~part["held_out"].to_numpy(zero_copy_only=False)
            missing = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_pylist([{
                **_EMPTY, "part": number, "doc_ids": part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "missing": missing.tobytes(), "learned": learned.tobytes(),
                "n": _pressed(n), "words": words[order].tobytes(), "ids": _pressed(place[ids]), "tokens": len(ids), "training": int(n[learned].sum()),
            }], schema=_SCHEMA)
            number += 1

    return stored(docs.mapInArrow(read, PART), "lm-parts")


_SCHEMA = pa.schema([("part", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "missing", "learned", "n", "words", "ids")], ("tokens", pa.int64()), ("training", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])
#: Bytes of a hash that are sent: a bucket holds few enough n-grams to tell them apart by these.
SENT = 6


def _tallied(text: DataFrame, order: int, buckets: int) -> DataFrame:
    """(part, bucket, counts) for each part and bucket: the counts in training, over all parts, of the part's distinct n-grams of the bucket.

    A part sends each of its n-grams once, with its own count; rows hold all that a part has for a bucket, so they are never more
    than n-grams. A row of part -1 tells how many n-grams of the bucket came in training.
    """
    import numpy as np

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, bucket, counts, order_ = Part.read(row).dealt(order, buckets)
                h, bucket, counts = h[order_], bucket[order_], counts[order_]
                there, first = np.unique(bucket, return_index=True)
                raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :SENT])
                rows = [(row["part"], k, raw[a:b].tobytes(), _pressed(counts[a:b])) for k, a, b in zip(there.tolist(), first, [*first[1:], len(h)], strict=True)]
                for at in range(0, len(rows), 500):
                    part, k, keys, n = zip(*rows[at : at + 500], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(k, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], names=["part", "bucket", "keys", "counts"])

    def add(group: pa.Table) -> pa.Table:
        raw = [np.frombuffer(k, np.uint8).reshape(-1, SENT) for k in group["keys"].to_pylist()]
        every = np.zeros((sum(map(len, raw)), 8), np.uint8)
        every[:, :SENT] = np.concatenate(raw)
        _, which = np.unique(every.view(np.uint64).ravel(), return_inverse=True)
        counts = np.bincount(which, np.concatenate([_unpressed(c) for c in group["counts"].to_pylist()]))
        ends = np.cumsum([len(r) for r in raw])
        replies = [_pressed(np.minimum(counts[which[e - len(r) : e]], 2**32 - 1)) for e, r in zip(ends.tolist(), raw, strict=True)]
        own, bucket = [*group["part"].to_pylist(), -1], [group["bucket"][0].as_py()] * (len(raw) + 1)
        known = [0] * len(raw) + [int((counts > 0).sum())]
        return pa.table({"part": pa.array(own, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "counts": pa.array([*replies, None], pa.binary()), "known": pa.array(known, pa.int64())})

    asked = text.select("part", "learned", "n", "words", "ids").mapInArrow(ask, "part long, bucket int, keys binary, counts binary")
    return stored(asked.groupBy("bucket").applyInArrow(add, "part long, bucket int, counts binary, known long"), f"lm-counts-{order}")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    Learns from the rows outside the held-out tenth (a null id counts as an empty one). A null or
    empty text is its end alone. The model mixes the counts of trigrams, bigrams and the base's own
    unigram probability (see Trie); all n-grams of all training rows count, whatever the input's size. Repeated
    rows count and are scored as often as they come; further columns are ignored. Without training
    rows every known count is 0.

    The text is read once, into parts of bounded size. For words, bigrams and trigrams in turn a part sends its
    distinct n-grams to buckets of their hashes, as many as keep a bucket's n-grams bounded, and gets back their counts over all
    training rows. From these it builds the trie of the n-grams that its own documents hold, and looks its
    tokens up. Nothing is sent to all tasks, and the driver gets three sums. N-grams are told apart by 48 bits of a hash within their bucket.
    """
    import numpy as np

    docs = docs.select("doc_id", "text", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"))
    text = _stored_parts(docs)
    sums = text.agg(F.sum("tokens").alias("tokens"), F.sum("training").alias("training")).first()
    tokens, buckets = int(sums.training or 0), max(partitions(docs), (sums.tokens or 0) // GROUP_GRAMS + 1)
    counts = [_tallied(text, order, buckets) for order in (1, 2, 3)]
    words = int(counts[0].filter("part = -1").agg(F.sum("known")).first()[0] or 0)

    def scored(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next(r for r in rows if r["bucket"] is None)
        part = Part.read(row)
        replies: dict[int, list] = {1: [], 2: [], 3: []}
        for r in sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"]):
            replies[r["tokens"]].append(_unpressed(r["counts"]))
        n = {}
        for order in (1, 2, 3):
            *_, by_bucket = part.dealt(order, buckets)
            n[order] = np.zeros(len(by_bucket), np.int64)
            n[order][by_bucket] = np.concatenate([np.zeros(0, np.int64), *replies[order]])
        _, (two, *_), (three, *_) = part.levels()
        bits = max(1, len(part.words).bit_length())
        came = np.flatnonzero(n[2] > 0)
        place = np.cumsum(n[2] > 0) - 1
        bigrams = ((two[came] >> 32) << bits) | (two[came] & 0xFFFFFFFF)
        also = np.flatnonzero(n[3] > 0)
        trigrams = (place[three[also] >> 32] << bits) | (three[also] & 0xFFFFFFFF)
        trie = Trie(n[1], bigrams, n[2][came], trigrams, n[3][also], tokens, words)
        doc = np.repeat(np.arange(len(part.learned)), np.diff(part.offsets))
        by_doc = lambda x: np.bincount(doc, x, len(part.learned))
        return pa.table({
            "doc_id": pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["missing"], bool)), "held_out": pa.array(~part.learned), "n_tokens": pa.array(np.diff(part.offsets).astype(np.int64)),
            "n_known": pa.array(by_doc(n[1][part.ids] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(part.learned), tokens, np.int64)),
            "base_score": pa.array(by_doc(trie.uni[part.ids])), "score": pa.array(by_doc(trie.logs(part))),
        })

    given = [c.filter("part >= 0").select("part", "bucket", "counts", F.lit(k).cast("long").alias("tokens")) for k, c in enumerate(counts, 1)]
    rows = text
    for g in given:
        rows = rows.unionByName(g, allowMissingColumns=True)
    return rows.groupBy("part").applyInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
