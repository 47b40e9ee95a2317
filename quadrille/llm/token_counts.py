"""Token counts of texts by a linear longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quadrille.llm.common import flat_words, table

VOCABULARY = "piece_bpe_32k.model"
#: Begins each word in the vocabulary.
MARK = "▁"
#: Bytes of a word that is read in pieces side by side, of a piece, and of the pieces that are read at a time.
LONG, PIECE, SEGMENT = 16_384, 2_048, 4 << 20


class Automaton:
    """Greedy longest-match token counts of words, one step a byte.

    A trie over the vocabulary's bytes. Where a node has no child for a byte, the longest match of
    what has been read is known: its failure link leads to the node of what stays unmatched, and
    only the number of tokens popped on the way is kept, never the tokens. Links and counts are
    folded into one table of next nodes and one of counts. Each single byte counts as a token, so
    every word has a count; a character outside the vocabulary counts its UTF-8 bytes.
    """

    def __init__(self, pieces: Iterable[bytes]):
        import numpy as np

        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for byte in piece:
                at = children[node].get(byte)
                if at is None:
                    at = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = at
            final[node] = True
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.pops = np.zeros((n, 256), np.uint8)
        fail, popped, self.rest = [0] * n, [0] * n, np.zeros(n, np.int32)
        self.next[0, list(children[0])] = list(children[0].values())
        level = [0]
        while level:  # shorter strings first: a failure link leads to a shorter one
            below = []
            for node in level:
                for byte, child in children[node].items():
                    if final[child]:
                        fail[child], popped[child] = 0, 1
                    else:
                        link = fail[node]
                        fail[child] = int(self.next[link, byte])
                        popped[child] = popped[node] + int(self.pops[link, byte])
                    self.rest[child] = popped[child] + self.rest[fail[child]]
                    self.next[child] = self.next[fail[child]]
                    self.pops[child] = self.pops[fail[child]] + popped[child]
                    if own := children[child]:
                        self.next[child, list(own)] = list(own.values())
                        self.pops[child, list(own)] = 0
                    below.append(child)
            level = below
        self.start, self.start_pops = 0, 0
        for byte in MARK.encode():
            self.start_pops += int(self.pops[self.start, byte])
            self.start = int(self.next[self.start, byte])

    def counts(self, words: pa.Array):
        """Tokens of each word, the mark before it included."""
        import numpy as np

        words = words.cast(pa.large_binary())
        long = pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)
        if not long.any():
            return self._stepwise(words)
        out = np.empty(len(words), np.int64)
        out[~long] = self._stepwise(words.filter(pa.array(~long)))
        out[long] = [self.long_count(np.frombuffer(w.as_buffer(), np.uint8)) for w in words.filter(pa.array(long))]
        return out

    def long_count(self, data) -> int:
        """Tokens of one long word. Its pieces are read side by side, each from a guessed node; where the piece before
        ends at another node, a piece is read again from there until both ways meet, which is mostly within a few tokens."""
        import numpy as np

        total, state = self.start_pops, self.start
        for at in range(0, len(data), SEGMENT):
            segment = data[at : at + SEGMENT]
            n = -(-len(segment) // PIECE)
            grid = np.zeros(n * PIECE, np.uint8)
            grid[: len(segment)] = segment
            grid = grid.reshape(n, PIECE)
            last = len(segment) - (n - 1) * PIECE  # bytes of the last piece
            states, pops = np.zeros((PIECE + 1, n), np.int32), np.zeros((PIECE + 1, n), np.int64)
            states[0, 0] = state
            for t in range(PIECE):
                live = slice(0, n if t < last else n - 1)
                here, byte = states[t, live], grid[live, t]
                states[t + 1], pops[t + 1] = states[t], pops[t]
                states[t + 1, live] = self.next[here, byte]
                pops[t + 1, live] += self.pops[here, byte]
            while len(wrong := np.flatnonzero(states[PIECE, :-1] != states[0, 1:]) + 1):
                here, sums = states[PIECE, wrong - 1].copy(), np.zeros(len(wrong), np.int64)
                for t in range(PIECE + 1):
                    met = here == states[t, wrong]
                    if met.any():
                        pops[t:, wrong[met]] += (sums[met] - pops[t, wrong[met]])[None, :]
                        wrong, here, sums = wrong[~met], here[~met], sums[~met]
                    if not len(wrong):
                        break
                    states[t, wrong], pops[t, wrong] = here, sums
                    live = np.flatnonzero((wrong < n - 1) | (t < last)) if t < PIECE else []
                    byte = grid[wrong, min(t, PIECE - 1)]
                    if len(live):
                        sums[live] += self.pops[here[live], byte[live]]
                        here[live] = self.next[here[live], byte[live]]
            total += int(pops[PIECE].sum())
            state = int(states[PIECE, -1])
        return total + int(self.rest[state])

    def _stepwise(self, words: pa.Array):
        """Tokens of words that are read byte by byte, all words at once."""
        import numpy as np

        words = words.take(pa.array(np.arange(len(words))))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, ends = offsets[:-1][order], -lengths[order]
        state = np.full(len(words), self.start, np.int32)
        total = np.full(len(words), self.start_pops, np.int64)
        for at in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(ends, -at, "left"))  # words longer than at
            byte = data[begins[:n] + at]
            total[:n] += self.pops[state[:n], byte]
            state[:n] = self.next[state[:n], byte]
        out = np.empty(len(words), np.int64)
        out[order] = total + self.rest[state]
        return out


@lru_cache(maxsize=2)
def automaton(vocabulary: str = VOCABULARY) -> Automaton:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    plain = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return Automaton(model.id_to_piece(i).encode() for i in plain)


def count_batch(batch: pa.RecordBatch, vocabulary: str, lower: bool) -> pa.RecordBatch:
    import numpy as np

    words, offsets = flat_words(batch["text"], lower)
    named = words.dictionary_encode()
    each = automaton(vocabulary).counts(named.dictionary)[named.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(each)])
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(sums[offsets]), pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of df(doc_id, text), in the task that reads it.

    Words are runs of other characters than [\\x20\\x09-\\x0D]; a word's tokens are the greedy
    longest matches of the mark and the word in the vocabulary. A null, empty or blank text has
    none. Repeated rows are counted as often as they come; further columns are ignored. A word of any
    length takes time in proportion to it: very long ones are read in pieces side by side.
    """

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield count_batch(batch.slice(at, 1000), vocabulary, lower=False)

    return df.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
