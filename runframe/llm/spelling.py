"""Spelling variants: words one edit apart by a variable-length gram index, and each rare word's form."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_batches, table, written

# Letters of a run, the modulus of the ids whose runs lose a code point, least length and count, and how much more frequent a form is.
LETTERS = "A-Za-zÀ-ÿ"
MODULUS, LEAST_CHARS, LEAST_COUNT, FORM = 31, 7, 2, 10
#: Most grams of the dictionary (they are broadcast, 16 bytes each), and their longest.
MAX_GRAMS, LONGEST = 1 << 18, 6
#: Words that one task holds of a gram's list; longer lists are cut into pairs of parts.
PART = 1 << 13
#: Words that a task counts before it hands them on, words it decomposes, rows it merges and pairs it compares at once.
HELD, WORDS, ROWS, PAIRS = 1 << 19, 1 << 15, 1 << 17, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUNS = re.compile(f"[{LETTERS}]{{{LEAST_CHARS},}}")


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): runs of at least LEAST_CHARS letters with at least LEAST_COUNT occurrences in whole texts.

    Only A to Z are lower-cased. A run whose crc32 of ``<id>:<run>`` is divisible by MODULUS lacks one code point. Null texts have no
    words and a null id counts as an empty one; repeated rows count each, and an empty table has none.
    """

    def count(batches):
        sums: Counter[str] = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{own}:".encode())
                for run, n in Counter(_RUNS.findall(text.translate(_LOWER).decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % MODULUS == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_CHARS:
                            continue
                    sums[run] += n
            if len(sums) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])
                sums = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("binary").alias("_text")).where("_text is not null")
    return map_batches(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _matrices(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) by length of the words: all letters are below 256, so a word is a row of bytes."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, np.frombuffer(b"".join(data[r] for r in rows), np.uint8).reshape(-1, size)))
    return out


def _packed(words: np.ndarray, at: int, size: int) -> np.ndarray:
    """The grams of ``size`` that begin at ``at``, as numbers; their size is in front."""
    out = np.full(len(words), size, np.int64)
    for k in range(size):
        out = out << 8 | words[:, at + k]
    return out


def gram_dictionary(words: DataFrame, most: int = MAX_GRAMS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(grams, place of each by frequency): grams of 2 to ``longest`` letters, pruned where the gram without its last letter is not frequent.

    The bound of frequent is the least power of two with at most ``most`` grams; which grams are in changes only the work, never the result.
    """

    def count(batches):
        for batch in gathered(batches, WORDS):
            values = [_packed(m, at, size) for _, m in _matrices(batch.column(0)) for size in range(2, longest + 1) for at in range(m.shape[1] - size + 1)]
            gram, n = np.unique(np.concatenate(values), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n, pa.int64())], ["gram", "n"])

    counts = written(words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    size = lambda g: F.floor(F.log2(g) / 8).cast("int")  # noqa: E731  the size is the topmost byte
    shorter = F.shiftright("gram", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * (_size - 1)) - 1")) + F.expr("shiftleft(cast(_size - 1 as bigint), 8 * (_size - 1))")
    sized = counts.withColumn("_size", size(F.col("gram")))
    above = counts.select(F.col("gram").alias("_shorter"), F.col("n").alias("_n"))
    grams = sized.where("_size > 2").withColumn("_shorter", shorter).join(above, "_shorter").select("gram", "n", F.floor(F.log2("_n")).alias("bits"))
    grams = written(grams.unionByName(sized.where("_size = 2").select("gram", "n", F.lit(63).cast("long").alias("bits"))))
    by_bits = {r["bits"]: r["k"] for r in grams.groupBy("bits").agg(F.count("*").alias("k")).collect()}
    total, bound = 0, 64
    for bits in sorted(by_bits, reverse=True):
        total += by_bits[bits]
        if total > most:
            break
        bound = bits
    found = grams.where(F.col("bits") >= bound).select("gram", "n").toArrow()
    gram, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    place = np.empty(len(gram), np.int64)
    place[np.lexsort((gram, n))] = np.arange(len(gram))
    return gram, place


def decompose(words: np.ndarray, grams: np.ndarray, place: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, last letter, order, affected) of words of one length: their variable grams, and the most of them that one edit touches.

    At each place the longest gram of the dictionary with at most ``longest`` letters begins (any two letters are one), unless an
    earlier one ends as late. Whether it stands depends on the letters from ``longest - 1`` before its end to
    ``longest - 1`` behind its start; an edit touches the grams for which it lies there. ``order`` ranks grams by
    frequency, gram and place.
    """
    many, size = words.shape
    places = size - 1
    last, order = np.empty((many, places), np.int64), np.empty((many, places), np.int64)
    for at in range(places):
        gram = _packed(words, at, 2)
        last[:, at], order[:, at] = at + 1, gram - (1 << 32)  # two letters that the dictionary lacks come first
        for n in range(2, min(longest, size - at) + 1):
            gram = _packed(words, at, n)
            spot = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            found = grams[spot] == gram
            last[found, at], order[found, at] = at + n - 1, place[spot[found]]
    kept = np.ones((many, places), bool)
    kept[:, 1:] = last[:, 1:] > np.maximum.accumulate(last, axis=1)[:, :-1]
    # the grams that an edit of letter i touches are those from low to high: a sum of steps up and down
    steps = np.zeros((many, size + 1), np.int64)
    rows = np.repeat(np.arange(many), places)
    np.add.at(steps, (rows, np.maximum(last - longest + 1, 0).ravel()), kept.ravel())
    np.add.at(steps, (rows, np.minimum(np.tile(np.arange(places) + longest, (many, 1)), size).ravel()), -kept.ravel().astype(np.int64))
    return kept, last, order, np.cumsum(steps[:, :size], axis=1).max(axis=1)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def gram_lists(words: DataFrame, dictionary: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(layer, key, word, n): the lists of the gram index in which a word can meet its neighbours.

    In layer m meet words of m letters with each other and with those of m + 1, decomposed with grams of at most m // 2 letters,
    so that one edit leaves each at least one. Of a word with G grams of which an edit touches at most A, near words share G - A,
    so one is among its A + 1 rarest; it lies as far from the start or as far from the end in both words, which the key holds.
    """
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def index(batches):
        grams, place = shared.value
        for batch in gathered(batches, WORDS):
            for own, letters in _matrices(batch.column(0)):
                size = letters.shape[1]
                for layer in (size, size - 1) if size > LEAST_CHARS else (size,):
                    kept, last, order, touched = decompose(letters, grams, place, min(LONGEST, layer // 2))
                    by_rank = np.argsort(np.where(kept, order, np.int64(1) << 62), axis=1, kind="stable")  # ties by place
                    taken = np.arange(by_rank.shape[1])[None, :] <= touched[:, None]
                    row, col = np.nonzero(taken)
                    at = by_rank[row, col]
                    gram, end = order[row, at], size - 1 - last[row, at]
                    for side, offset in ((0, at), (1, end)):
                        key = _mixed(gram, offset * 2 + side, np.full(len(row), layer))
                        given = pa.array(own[row])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), layer, np.int32)), pa.array(key), batch.column(0).take(given), batch.column(1).take(given)], ["layer", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(index, "layer int, key long, word string, n long")


def _cells(lists: DataFrame, part: int) -> DataFrame:
    """``lists`` with the cell of a list: a list of more than ``part`` words becomes all pairs of its parts."""
    long = written(lists.groupBy("layer", "key").agg(F.count("*").alias("_many")).where(F.col("_many") > part))
    if long.isEmpty():
        return lists.withColumns({"cell": F.lit(0).cast("long"), "own": F.lit(0), "parts": F.lit(1)})
    rows = lists.join(long, ["layer", "key"], "left").withColumn("parts", F.ceil(F.coalesce("_many", F.lit(1)) / part).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.withColumn("cell", F.least("own", "_other").cast("long") * F.col("parts") + F.greatest("own", "_other")).drop("_many", "_other")


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of m and of m or m + 1 columns differ by exactly one edit."""
    size = a.shape[1]
    same = a == b[:, :size]
    if b.shape[1] == size:
        return (~same).sum(axis=1) == 1
    ahead = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
    same = a == b[:, 1:]
    behind = np.where(same.all(axis=1), size, np.argmin(same[:, ::-1], axis=1))
    return ahead + behind >= size


def _merge(rows: pa.Table):
    """(a, na, b, nb) for the near pairs within each list of ``rows``, which come by list; of a cell of two parts, pairs across them."""
    words, n = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
    layer, key, cell, own, parts = (rows.column(c).to_numpy() for c in ("layer", "key", "cell", "own", "parts"))
    new = np.ones(len(rows), bool)
    new[1:] = (layer[1:] != layer[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    group = np.cumsum(new) - 1
    data = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    for m in np.unique(layer):
        at = np.flatnonzero(layer == m)
        at = at[np.lexsort((sizes[at], group[at]))]
        letters = np.zeros((len(at), m + 1), np.uint8)
        for size in (m, m + 1):
            pick = np.flatnonzero(sizes[at] == size)
            if len(pick):
                letters[pick, :size] = np.frombuffer(b"".join(data[at[p]] for p in pick), np.uint8).reshape(-1, size)
        ends = np.searchsorted(group[at], group[at], side="right")
        many = np.where(sizes[at] == m, ends - np.arange(len(at)) - 1, 0)  # a word of m letters meets all behind it in its list
        upto = np.concatenate(([0], np.cumsum(many)))
        first = 0
        while first < len(at):
            stop = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(first, stop), many[first:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[first:stop] - upto[first], many[first:stop])
            first = stop
            across = (parts[at[i]] == 1) | (own[at[i]] != own[at[j]]) | (cell[at[i]] == own[at[i]] * (parts[at[i]] + 1))
            i, j = i[across], j[across]
            for size in (m, m + 1):
                pick = sizes[at[j]] == size
                x, y = i[pick], j[pick]
                near = _one_edit(letters[x, :m], letters[y, :size])
                x, y = at[x[near]], at[y[near]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(x)), pa.array(n[x]), words.take(pa.array(y)), pa.array(n[y])], ["a", "na", "b", "nb"])


def _merged(batches):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            whole = pa.Table.from_batches(held)
            last = pc.and_(pc.equal(whole.column("key"), whole.column("key")[-1]), pc.equal(whole.column("cell"), whole.column("cell")[-1]))
            cut = rows - int(pc.sum(last).as_py())
            if cut:
                yield from _merge(whole.slice(0, cut))
                held, rows = whole.slice(cut).to_batches(), rows - cut
    if rows:
        yield from _merge(pa.Table.from_batches(held))


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, near, near_n), both ways, of the words of the written table (word, n) that are one edit apart.

    Candidates meet in the lists of a gram index and are verified; a pair that meets in several lists is given once.
    Words must be of letters below 256, distinct and of LEAST_CHARS or more.
    """
    lists = written(gram_lists(words, gram_dictionary(words)))
    rows = _cells(lists, part).repartition("layer", "key", "cell").sortWithinPartitions("layer", "key", "cell")
    links = rows.mapInArrow(_merged, "a string, na long, b string, nb long")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    return links.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct().select(both.alias("x")).select("x.*")


def variants(words: DataFrame, times: int = FORM, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    A word's form is its near word of largest n (ties: the smallest), if that is ``times`` its own or more. Forms are followed to
    the last, which is the root; each step multiplies n by ``times``, so doubling ends after a few rounds.
    """
    words = written(words)
    near = near_words(words, part).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = words.join(near, "word", "left")
    has = -F.col("best.less").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * times
    state = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    state = written(state.withColumn("root", F.coalesce("form", "word")))
    while True:
        ahead = state.where("root != word").select(F.col("word").alias("root"), F.col("root").alias("_far"))
        moved = state.join(ahead, "root", "left").withColumn("_moved", F.col("_far").isNotNull())
        state_ = written(moved.select("word", "n", "n_near", "form", "form_n", F.coalesce("_far", "root").alias("root"), "_moved"))
        state = state_.drop("_moved")
        if state_.where("_moved").isEmpty():
            return state.select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Each word of all documents with its form, its root and its number of near words."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
