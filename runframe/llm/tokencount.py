"""Token counts: best unigram segmentations found on a trie of pre-tokens."""

from __future__ import annotations

import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

#: Vocabulary file, a parameter of every function here.
VOCABULARY = "piece_bpe_32k.model"
#: Distinct pre-tokens that a task keeps counts of.
MAX_WORDS = 500_000
#: Longest pre-token on the trie, and distinct pre-tokens of one trie.
LEVELS, CHUNK = 48, 50_000
FILTER_BITS = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = "▁"
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.array([1, *[int(_BASE)] * (LEVELS + 1)], np.uint64), dtype=np.uint64)


def unigram_scores(vocabulary: str) -> tuple[dict[str, float], float]:
    """Log-probability of every piece of the vocabulary, and that of one byte of a character it lacks.

    The file holds ranks but no frequencies, so pieces get Zipf's law over their rank; nothing is trained.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (i + 2) for i in range(len(pieces))))
    return {piece: -math.log(i + 2) - total for i, piece in enumerate(pieces)}, -2 * math.log(len(pieces) + 2) - total


class PrefixTrie:
    """Token counts of distinct pre-tokens, found level by level on their trie.

    In sorted order the pre-tokens below a node are neighbours, so the nodes of a level are the places
    where a prefix differs from the one before. The forward (score, tokens) of every node is worked out
    once, from its ancestors, and ``counts`` stores what the terminal nodes have.
    """

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, tuple[int, float]] = {}
        hashed = np.array([_hash(np.array([[ord(c)] for c in piece], np.uint64))[-1, 0] for piece in scores], np.uint64)
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], np.fromiter(scores.values(), float, len(scores))[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)  # most substrings are no pieces
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def insert(self, words: set[str]) -> None:
        """Add the words that ``counts`` lacks; a full store is begun anew, which changes no count."""
        if len(self.counts) + len(words) > MAX_WORDS:
            self.counts = {w: self.counts[w] for w in words if w in self.counts}
        new = sorted(words - self.counts.keys())
        short = [w for w in new if len(w) < LEVELS]
        for at in range(0, len(short), CHUNK):
            self._levels(short[at : at + CHUNK])
        for word in new:
            if len(word) >= LEVELS:
                self.counts[word] = self.single(word)

    def single(self, word: str) -> tuple[int, float]:
        """(tokens, score) of one pre-token, without a trie: for very long ones."""
        marked, best, fewest = _MARK + word, [0.0], [0]
        for end in range(1, len(marked) + 1):
            size = len(marked[end - 1].encode("utf-8", "replace"))
            top, least = best[-1] + size * self.byte_score, fewest[-1] + size
            for start in range(max(0, end - self.longest), end):
                own = self.scores.get(marked[start:end])
                if own is not None:
                    score, tokens = best[start] + own, fewest[start] + 1
                    if score > top or score == top and tokens < least:
                        top, least = score, tokens
            best.append(top)
            fewest.append(least)
        return fewest[-1], best[-1]

    def _levels(self, words: list[str]) -> None:
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n) + 1
        codes = np.zeros((int(length.max()), n), np.uint64)  # by level, so that a level is read in one run
        codes[0] = ord(_MARK)
        codes[1:] = np.array(words).view(np.uint32).reshape(n, -1)[:, : len(codes) - 1].T
        rolled = np.vstack([np.zeros((1, n), np.uint64), _hash(codes)])
        differs = np.zeros(n, bool)
        differs[0] = True
        node, best, fewest = [np.zeros(n, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for end in range(1, len(codes) + 1):
            level = codes[end - 1]
            differs[1:] |= level[1:] != level[:-1]
            own = differs & (length >= end)
            at = np.flatnonzero(own)  # the first word below each node
            size = 1 + (level[at] >= 0x80) + (level[at] >= 0x800) + (level[at] >= 0x10000)
            size[(level[at] >= 0xD800) & (level[at] < 0xE000)] = 1  # a lone surrogate counts as one replaced byte
            above = node[end - 1][at]
            top = best[end - 1][above] + size * self.byte_score
            least = fewest[end - 1][above] + size
            whole = rolled[end][at]
            for start in range(max(0, end - self.longest), end):
                code = whole - rolled[start][at] * _POWERS[end - start]
                hit = np.flatnonzero(self.maybe[code >> np.uint64(64 - FILTER_BITS)])
                place = np.minimum(np.searchsorted(self.hashes, code[hit]), len(self.hashes) - 1)
                sure = self.hashes[place] == code[hit]
                hit, place = hit[sure], place[sure]
                above = node[start][at[hit]]
                score, tokens = best[start][above] + self.values[place], fewest[start][above] + 1
                better = (score > top[hit]) | ((score == top[hit]) & (tokens < least[hit]))
                top[hit[better]], least[hit[better]] = score[better], tokens[better]
            node.append(np.cumsum(own) - 1)
            best.append(top)
            fewest.append(least)
        ends = [(int(fewest[e][node[e][i]]), float(best[e][node[e][i]])) for i, e in enumerate(length.tolist())]
        self.counts.update(zip(words, ends, strict=True))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix of each column."""
    out, total = np.empty_like(codes), np.zeros(codes.shape[1], np.uint64)
    for i in range(len(codes)):
        total = total * _BASE + (codes[i] + np.uint64(1)) * _SPREAD
        out[i] = total
    return out


def token_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``keep``, n_words, n_tokens and log_prob of every whole text.

    A pre-token is a run of characters other than space and 0x09-0x0D, with a mark in front; its tokens
    are those of its most probable segmentation into pieces (single bytes for unknown characters).
    Null and empty texts have zeros. Repeated rows give repeated results; extra columns go.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kept = docs.select(*keep, F.col(text_col).alias("_text"))

    def count(batches):
        trie = PrefixTrie(*unigram_scores(path))
        for batch in batches:
            found = [_WORD.findall(text or "") for text in batch.column(batch.num_columns - 1).to_pylist()]
            trie.insert(set().union(*found))
            pairs = [[trie.counts[word] for word in words] for words in found]
            words, tokens = [len(x) for x in pairs], [sum(t for t, _ in x) for x in pairs]
            scores = [sum((s for _, s in x), 0.0) for x in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "n_words", "n_tokens", "log_prob"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, count, f"{schema}, n_words long, n_tokens long, log_prob double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
