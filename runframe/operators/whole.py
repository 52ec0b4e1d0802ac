"""Sequences that a task holds whole: many short ones at a time, laid one after the other in arrays.

The other operators cut a sequence over many tasks and pay for it with shuffles of a row a symbol. Here texts of at most LONGEST
symbols go from their table to what is derived from them without a shuffle, and rows of short sequences with one. Memory is
bounded by LONGEST and BATCH, whatever the table; callers send longer sequences to the operators that cut them (by_length).
Places are those in the laid-out arrays, so that a batch of sequences is sorted and stepped at once; ranks go sequence by sequence.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, TERMINATOR
from ..scratch import written

#: Symbols of a sequence that is held whole, its end mark included, those with which a batch ends, and those of a task where texts are dealt out.
LONGEST, BATCH, TASK = 1 << 20, 1 << 18, 1 << 22

ROWS = {
    "suffix_array": f"{KEY} long, i long, sa long",
    "bwt": f"{KEY} long, i long, ch string, sa long",
    "runs": f"{KEY} long, interval long, start long, length long, image long",
    "ranks": f"{KEY} long, interval long, length long, image_rank long",
    "move": f"{KEY} long, interval long, start long, length long, image long, pointer long, off long",
    "texts": f"{KEY} long, text string",
    "order": f"{KEY} long, step long, i long",
    "single": f"{KEY} long, ok boolean",
}
Columns = list
#: The functions of this file go to the executors themselves, as their Python may not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Held:
    """Sequences: their keys, where each begins (and the last ends), their symbols as codes from 1 in order, and the symbols."""

    keys: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    symbols: pa.Array

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def own(self) -> np.ndarray:
        """The sequence of each place."""
        return np.repeat(np.arange(len(self.keys)), self.sizes)

    @cached_property
    def first(self) -> np.ndarray:
        return self.bounds[self.own]

    @cached_property
    def last(self) -> np.ndarray:
        return self.bounds[self.own + 1] - 1

    def local(self, places: np.ndarray) -> np.ndarray:
        return places - self.first


def by_length(texts: DataFrame, short: Callable, long: Callable) -> DataFrame:
    """``short`` of those (seq_id, text) that are held whole, and ``long`` of the others, if there are any."""
    over = (F.octet_length("text") >= LONGEST) & (F.length("text") >= LONGEST)  # bytes need no count
    rest = texts.where(over)
    found = short(texts.where(~F.coalesce(over, F.lit(False))))
    return found if rest.isEmpty() else found.unionByName(long(written(rest)))


def dealt(texts: DataFrame, times: int = 1) -> DataFrame:
    """Short texts over as many tasks as their symbols, each counted ``times``, need: a small table may be one file's split."""
    symbols = texts.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    return texts.repartition(1 + symbols * times // TASK, KEY)


def over_texts(texts: DataFrame, make: Callable[[Held], Columns], kind: str, mark: str = TERMINATOR) -> DataFrame:
    """The rows that ``make`` gives of short (seq_id, text), with the end mark added. Null texts are empty, and left out where there is no mark."""
    names = [c.split()[0] for c in ROWS[kind].split(", ")]

    def run(batches):
        for held in held_texts(batches, mark):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in make(held)], names)

    rows = texts.select(F.col(KEY).cast("long").alias(KEY), F.coalesce("text", F.lit("")).alias("text"))
    return (rows if mark else rows.where("text != ''")).mapInArrow(run, ROWS[kind])


def held_texts(batches: Iterator[pa.RecordBatch], mark: str = TERMINATOR) -> Iterator[Held]:
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + len(mark))
        at = 0
        while at < len(keys):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, side="right")))
            yield laid_out(keys[at:upto], texts.slice(at, upto - at).to_pylist(), mark)
            at = upto


def laid_out(keys: np.ndarray, texts: list[str], mark: str = TERMINATOR) -> Held:
    """Texts, each with ``mark`` behind it."""
    points = np.frombuffer((mark.join(texts) + mark).encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(mark))])
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    return Held(keys, bounds, np.cumsum(seen)[points], pa.array(map(chr, np.flatnonzero(seen)), pa.string()))


def _bits(most: int) -> int:
    return int(most).bit_length()


def sorted_suffixes(held: Held) -> np.ndarray:
    """The places of all suffixes in order, by prefix doubling over those that are still open; of two a shorter one is smaller.

    A key, and its place in the low bits, are sorted as one number.
    """
    n, place_bits, width = len(held.codes), _bits(len(held.codes)), _bits(held.codes.max(initial=1))
    reach = min(n, max(1, (63 - place_bits - _bits(len(held.keys))) // width))
    place = np.arange(n)
    left = held.last - place
    key = held.own.copy()
    for k in range(reach):  # symbols beyond the end are 0
        key <<= width
        key[: n - k] |= np.where(left[: n - k] >= k, held.codes[k:], 0)
    key = np.sort(key << place_bits | place)
    place, key = key & ((1 << place_bits) - 1), key >> place_bits
    old, start = np.zeros(n, np.int64), np.zeros(n, np.int64)  # ranks of the rounds before, and where each begins among the open
    rank = np.empty(n, np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(key)))
        rank[place] = np.repeat(old[heads] + heads - start[heads], sizes)
        open_ = np.repeat(sizes > 1, sizes)
        place = place[open_]
        if not len(place):
            break
        own = rank[place]
        ahead = np.minimum(place + reach, n - 1)
        far = np.where(held.last[place] >= place + reach, rank[ahead] + 1, 0)
        packed = np.sort((own << place_bits | far) << place_bits | place)
        place, key = packed & ((1 << place_bits) - 1), packed >> place_bits
        old = key >> place_bits
        heads = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        start = np.repeat(heads, np.diff(np.append(heads, len(old))))
        reach *= 2
    found = np.empty(n, np.int64)
    found[rank] = np.arange(n)
    return found


def bwt_codes(held: Held, suffixes: np.ndarray) -> np.ndarray:
    """The symbol before each suffix."""
    return held.codes[np.where(suffixes == held.first, held.last, suffixes - 1)]


def transformed(held: Held) -> tuple[Held, np.ndarray]:
    """The BWTs of texts, and the places of their suffixes."""
    suffixes = sorted_suffixes(held)
    found = Held(held.keys, held.bounds, bwt_codes(held, suffixes), held.symbols)
    found.own, found.first, found.last = held.own, held.first, held.last
    return found, suffixes


def lf(bwt: Held) -> np.ndarray:
    """LF of each place of any symbol sequences."""
    bits = _bits(len(bwt.codes))
    packed = np.sort((bwt.own << _bits(bwt.codes.max(initial=1)) | bwt.codes) << bits | np.arange(len(bwt.codes)))
    return inverse(packed & ((1 << bits) - 1))


def inverse(perm: np.ndarray) -> np.ndarray:
    found = np.empty_like(perm)
    found[perm] = np.arange(len(perm))
    return found


def distances(held: Held, perm: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps from each place to the one whose next is ``end``, by pointer doubling, and whether it gets there at all."""
    low = (1 << 32) - 1  # a number holds the steps so far and, below, the place that is reached
    stops = perm == end
    state = np.where(stops, np.arange(len(perm)), perm | 1 << 32)
    for _ in range(_bits(held.sizes.max(initial=0))):
        state = state[state & low] + (state & ~low)
    return state >> 32, stops[state & low]


def single_distances(held: Held, perm: np.ndarray, end: np.ndarray) -> np.ndarray:
    steps, met = distances(held, perm, end)
    if not met.all():
        raise ValueError("the permutation has more than one cycle")
    return steps


def edges(bwt: Held, suffixes: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Runs of φ (side -1) or φ⁻¹ (side 1): the sequence, number, start, length and image of each, starts and images as places."""
    place = np.arange(len(bwt.codes))
    border = place == (bwt.first if side < 0 else bwt.last)
    beside = np.where(border, bwt.last if side < 0 else bwt.first, place + side)
    cut = border | (bwt.codes != bwt.codes[beside])
    image = np.full(len(place), -1)
    image[suffixes[cut]] = suffixes[beside[cut]]
    start = np.flatnonzero(image >= 0)
    own = bwt.own[start]
    counts = np.bincount(own, minlength=len(bwt.keys))
    number = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.minimum(np.append(start[1:], len(place)), bwt.bounds[own + 1])
    return own, number, start, ends - start, image[start]


def suffix_rows(held: Held) -> Columns:
    return [held.keys[held.own], held.local(np.arange(len(held.codes))), held.local(sorted_suffixes(held))]


def bwt_rows(held: Held) -> Columns:
    bwt, suffixes = transformed(held)
    return [held.keys[held.own], held.local(np.arange(len(held.codes))), held.symbols.take(pa.array(bwt.codes - 1)), held.local(suffixes)]


def phi_rows(side: int) -> Callable[[Held], Columns]:
    """Interval rows of φ (side -1) or φ⁻¹ (side 1), from the suffixes of the BWT."""

    def make(held: Held) -> Columns:
        bwt, suffixes = transformed(held)
        return _runs(bwt, *edges(bwt, suffixes, side))

    return make


def _runs(held: Held, own: np.ndarray, number: np.ndarray, start: np.ndarray, length: np.ndarray, image: np.ndarray) -> Columns:
    base = held.bounds[own]
    return [held.keys[own], number, start - base, length, image - base]


def phi_ranks(side: int) -> Callable[[Held], Columns]:
    """(seq_id, interval, length, image_rank): the place of each interval by image."""

    def make(held: Held) -> Columns:
        bwt, suffixes = transformed(held)
        own, number, _, length, image = edges(bwt, suffixes, side)
        rank = inverse(np.argsort(image))  # as places, so sequence by sequence
        return [held.keys[own], number, length, rank - (np.arange(len(own)) - number)]

    return make


def phi_moves(side: int) -> Callable[[Held], Columns]:
    """Move table of φ or φ⁻¹ from the BWT alone, whose suffixes are found along LF; ValueError without a unique end mark."""

    def make(held: Held) -> Columns:
        return moves_of(transformed(held)[0], side)

    return make


def moves_of(bwt: Held, side: int) -> Columns:
    least = np.minimum.reduceat(bwt.codes, bwt.bounds[:-1])
    if (np.add.reduceat(bwt.codes == least[bwt.own], bwt.bounds[:-1]) != 1).any():
        raise ValueError("no unique end mark")
    suffixes = bwt.first + single_distances(bwt, lf(bwt), bwt.first)
    own, number, start, length, image = edges(bwt, suffixes, side)
    hit = np.searchsorted(start, image, side="right") - 1
    return [*_runs(bwt, own, number, start, length, image), number[hit], image - start[hit]]


def text_lf(held: Held) -> Columns:
    """(seq_id, text) back from the BWT, from the distances along LF; an empty text gives no row."""
    bwt = transformed(held)[0]
    at = single_distances(bwt, lf(bwt), bwt.first) - 1
    return _texts(bwt, np.where(at < 0, bwt.last, bwt.first + at), bwt.codes)


def text_fl(held: Held) -> Columns:
    """As text_lf, from the distances along FL, which run the other way."""
    bwt = transformed(held)[0]
    forward = lf(bwt)
    codes = np.empty_like(bwt.codes)
    codes[forward] = bwt.codes
    at = bwt.last - 1 - single_distances(bwt, inverse(forward), bwt.first)
    return _texts(bwt, np.where(at < bwt.first, bwt.last, at), codes)


def _texts(held: Held, at: np.ndarray, codes: np.ndarray) -> Columns:
    found = np.empty_like(codes)
    found[at] = codes
    symbols = held.symbols.take(pa.array(found[np.arange(len(found)) != held.last] - 1))
    rows = pa.ListArray.from_arrays(pa.array((held.bounds - np.arange(len(held.bounds))).astype(np.int32)), symbols)
    some = held.sizes > 1
    return [held.keys[some], pc.binary_join(rows, "").filter(pa.array(some))]


def suffixes_by_phi(side: int) -> Callable[[Held], Columns]:
    """(seq_id, i, sa): steps of φ down, or of φ⁻¹ up, to the last suffix, from their runs."""

    def make(held: Held) -> Columns:
        bwt, suffixes = transformed(held)
        _, _, start, length, image = edges(bwt, suffixes, side)
        place = np.arange(len(bwt.codes))
        perm = np.repeat(image - start, length) + place
        steps, sizes = single_distances(bwt, perm, bwt.last), bwt.sizes[bwt.own]
        return [bwt.keys[bwt.own], (steps + 1) % sizes if side < 0 else sizes - 1 - steps, bwt.local(place)]

    return make


def cycle_rows(held: Held, perm: np.ndarray) -> Columns:
    """(seq_id, step, i): places in the order in which as many steps from 0 as there are elements meet them."""
    steps, met = distances(held, perm, held.first)
    place = np.flatnonzero(met)
    own = held.own[place]
    sizes = np.bincount(own, minlength=len(held.keys))[own]
    step = sizes - 1 - steps[place]
    again = (held.sizes[own] - step + sizes - 1) // sizes  # a cycle of fewer elements is repeated
    turn = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    return [np.repeat(held.keys[own], again), np.repeat(step, again) + turn * np.repeat(sizes, again), np.repeat(held.local(np.arange(len(perm)))[place], again)]


def single_rows(held: Held, perm: np.ndarray) -> Columns:
    """(seq_id, ok): whether stepping from 0 meets every element."""
    return [held.keys, np.bincount(held.own, distances(held, perm, held.first)[1], minlength=len(held.keys)) == held.sizes]


def along_lf(make: Callable[[Held, np.ndarray], Columns]) -> Callable[[Held], Columns]:
    """``make`` of LF over the BWTs of texts."""

    def run(held: Held) -> Columns:
        bwt = transformed(held)[0]
        return make(bwt, lf(bwt))

    return run


def sorting(make: Callable[[Held, np.ndarray], Columns]) -> Callable[[Held], Columns]:
    """``make`` of where each symbol of a sequence goes when they are sorted, of several cycles mostly."""
    return lambda held: make(held, lf(held))
