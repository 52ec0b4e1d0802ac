"""Document fingerprints: randomised edit embedding of characters, bit-sampled bands and verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .components import components

#: Symbols of a sampled coordinate, and coordinates that an octave of steps has at most.
RUN, SAMPLES = 4, 24
#: Independent walks that find near texts (every second one starts at the end of the text), coordinates of each, and symbols of one.
WALKS, COORDS, STRETCH = 6, 32, 8
#: Coordinates of a band, one drawn from each equal part of the walk, and bands of a walk.
BAND, BANDS = 4, 6
#: Most coordinates of a walk, as a share of all, in which near texts differ.
UNLIKE = 0.5
#: Texts of a band with which its others are compared first.
PIVOTS = 2
#: Characters that walk together, and rows.
CHUNK, ROWS = 4_000_000, 4_096
#: Ordered ranges of ids that are put side by side to find each document's next one (a power of two), least rows of one
#: in the mean, and ids from which their bounds are taken.
RANGES, RANGE_ROWS, RANGE_IDS = 4_096, 64, 65_536

_CUT = np.uint32(2654435761)
_TURNS = 4_096
_rng = np.random.default_rng(41)
#: The shared random walks: whether a walk moves on at a step, by step and (hashed) character, is the sum of two bits; 0 marks the end.
_BITS = [_rng.integers(0, 2, (period, 256)).astype(np.int64) for period in (4_093, 4_099)]
for _table in _BITS:
    _table[:, 0] = 0


_PERIODS = (4_093, 4_099)
_near = np.random.default_rng(43)
#: The same for the independent walks: by step, walk and character; and which way each walk goes.
_MOVES = [_near.integers(0, 2, (period, WALKS, 256)).astype(np.int8) for period in _PERIODS]
for _table in _MOVES:
    _table[:, :, 0] = 0
_WAY = np.where(np.arange(WALKS) % 2 == 0, 1, -1).astype(np.int8)[:, None]
_POLY = np.uint32(0x01000193)
#: Least characters of each level: two levels double them. Drawn coordinates of each walk's bands.
_LEAST = np.ceil(2.0 ** (np.arange(80) / 2)).astype(np.int64)
_DRAWN = ((np.arange(BAND) + np.random.default_rng(7).random((WALKS, BANDS, BAND))) * COORDS / BAND).astype(np.int64)
#: A key's last bits name its level and walk.
_SPOTS = 1_024


def walk_steps(n: np.ndarray) -> np.ndarray:
    """Steps of a walk over n characters: two a character in the mean, and more than any walk's deviation from it."""
    n = np.asarray(n, np.int64)
    return np.where(n > 0, 2 * n + 8 * np.sqrt(n).astype(np.int64) + 16, 0)


def places(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """First step of each coordinate of a walk of so many steps, in order, and the steps for which it stands.

    Each octave of steps is sampled alike, at places that do not depend on the walk's length.
    """
    found, weights, low = [0], [4.0], 4
    while low < steps:
        count = min(SAMPLES, max(1, low // 8))
        width = low // count
        own = low + width * np.arange(count) + np.random.default_rng(low).integers(0, width - RUN + 1, count)
        found += own.tolist()
        weights += [low / count] * count
        low *= 2
    found, weights = np.array(found, np.int64), np.array(weights)
    here = found + RUN <= steps
    return found[here], weights[here]


def sketch(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text: a byte for each sampled coordinate of its embedding up to where the walk ends, b"" for an empty text.

    A walk emits its current character at each step and, by the shared random bit of (step, character), stays or moves on. Texts
    that differ by few edits are back in step soon, so the edit distance becomes the Hamming distance of what
    is emitted, and that of the samples. All texts walk in lockstep, the longest first; a very long text is one walk.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    steps = walk_steps(lengths)
    some = int((lengths > 0).sum())
    if not some:
        return [b""] * len(texts)
    codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.zeros(len(codes) + some, np.uint8)  # every text is followed by the mark 0, on which its walk stays
    symbols[np.arange(len(codes)) + np.repeat(np.arange(some), lengths[:some])] = (codes * _CUT >> np.uint32(20)) % np.uint32(255) + 1
    del codes
    at = np.cumsum(lengths[:some] + 1) - lengths[:some] - 1
    first, _ = places(int(steps[0]))
    out = np.zeros((some, len(first)), np.uint8)
    symbol, move, active, turn, step = np.zeros(some, np.uint8), np.zeros(some, np.int64), some, None, 0
    for j, place in enumerate(first.tolist()):
        total = None
        while step < place + RUN:
            if step % _TURNS == 0:
                own = np.arange(step, step + _TURNS)
                turn = _BITS[0][own % len(_BITS[0])] ^ _BITS[1][own % len(_BITS[1])]
            while steps[active - 1] <= step:
                active -= 1
            own_at, here, by = at[:active], symbol[:active], move[:active]
            symbols.take(own_at, out=here, mode="clip")
            if step >= place:
                total = here.astype(np.uint32) if total is None else total[:active] * np.uint32(0x01000193) + here
            turn[step % _TURNS].take(here, out=by, mode="clip")
            own_at += by
            step += 1
        out[:active, j] = (total[:active] * _CUT >> np.uint32(24)).astype(np.uint8)
    counts = np.searchsorted(first + RUN, steps[:some], side="right")
    found = [b""] * len(texts)
    for row, count in enumerate(counts.tolist()):
        found[order[row]] = out[row, :count].tobytes().rstrip(b"\0")  # the mark at the end gives zeros, which are as many for any text of that length
    return found


def likeness(pairs: list[tuple[bytes, bytes]]) -> list[float]:
    """For each pair of fingerprints the share of steps, by their samples, at which the walks are alike: 1 for equal ones."""
    longest = max((max(len(a), len(b)) for a, b in pairs), default=0)
    weights = places(1 << (longest // SAMPLES + 12))[1] if longest else np.zeros(0)
    found = []
    for a, b in pairs:
        both, all_of = min(len(a), len(b)), max(len(a), len(b))
        alike = np.frombuffer(a, np.uint8, both) == np.frombuffer(b, np.uint8, both)
        found.append(float(weights[:both][alike].sum() / weights[:all_of].sum()) if all_of else 1.0)
    return [min(1.0, x) for x in found]


def spots(level: int) -> tuple[np.ndarray, int]:
    """First steps of the coordinates of a level's walks, one drawn from each equal part of the walk, and the symbols of each.

    A level's walks take about two steps a character of its shortest text, and rarely end before that text does.
    """
    least = int(_LEAST[level])
    steps = max(1, 2 * least - 3 * int(least**0.5))
    run = max(1, min(STRETCH, steps // COORDS))
    cuts = (steps - run + 1) * np.arange(COORDS + 1) // COORDS
    return cuts[:-1] + (np.random.default_rng(level).random(COORDS) * np.diff(cuts)).astype(np.int64), run


def walk_prints(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, places in ``texts``, WALKS x COORDS bytes of each) of every text, for each of its levels; empty texts have none.

    A text has the level of its length, and the one below if it is at most a twelfth longer than that one's texts, so texts of nearly equal
    length have a level in common. Walks in turn read a level's length from the text's beginning on and from its end back;
    a level is less than half of an octave, so together they read the whole text. All texts and walks go in lockstep, the longest first.
    """
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-n, kind="stable")
    some = int((n > 0).sum())
    n = n[order[:some]]
    if not some:
        return []
    codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.zeros(len(codes) + some + 1, np.uint8)  # the mark 0 stands before and behind every text
    symbols[np.arange(len(codes)) + np.repeat(np.arange(some), n) + 1] = (codes * _CUT >> np.uint32(20)) % np.uint32(255) + 1
    begin = np.cumsum(n + 1) - n
    found, events, last = {}, {}, np.zeros(some, np.int64)
    for level in range(int(np.searchsorted(_LEAST, n[0], "right"))):
        low, high = int((12 * n >= 13 * _LEAST[level + 1]).sum()), int((n >= _LEAST[level]).sum())
        if low < high:
            first, run = spots(level)
            found[level] = (low, high, np.zeros((high - low, WALKS, COORDS), np.uint8))
            last[low:high] = np.maximum(last[low:high], first[-1] + run)
            for j, place in enumerate(first.tolist()):
                events.setdefault(place, []).append((level, j, True))
                events.setdefault(place + run, []).append((level, j, False))
    at = np.where(_WAY.T > 0, begin[:, None], (begin + n - 1)[:, None]).ravel()  # the walks of a text stand together
    rows = np.tile(np.arange(WALKS) * 256, some)
    symbol, spot, move = np.zeros(len(at), np.uint8), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    sums, active, turns = {}, some, None
    for step in range(int(last[0]) + 1):
        for level, j, opens in events.get(step, ()):  # a coordinate is the hash of its symbols
            low, high, out = found[level]
            if opens:
                sums[level, j] = np.zeros((high - low) * WALKS, np.uint32)
            else:
                out[:, :, j] = (sums.pop((level, j)) * _CUT >> np.uint32(24)).reshape(-1, WALKS)
        while active and last[active - 1] <= step:
            active -= 1
        if step % 512 == 0:
            own = np.arange(step, step + 512)
            turns = ((_MOVES[0][own % _PERIODS[0]] ^ _MOVES[1][own % _PERIODS[1]]) * _WAY).astype(np.int64).reshape(512, -1)
        some_at, here, there, by = (x[: active * WALKS] for x in (at, symbol, spot, move))
        symbols.take(some_at, out=here, mode="clip")
        for (level, _), total in sums.items():
            low, high, _ = found[level]
            total *= _POLY
            total += here[low * WALKS : high * WALKS]
        np.add(here, rows[: len(here)], out=there)
        turns[step % 512].take(there, out=by, mode="clip")
        some_at += by
    return [(level, order[low:high], out) for level, (low, high, out) in found.items()]


def band_keys(levels: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Rows of WALKS * BANDS keys: hashes of the drawn coordinates of each walk, with level and walk in the last bits."""
    keys = np.zeros((len(levels), WALKS, BANDS), np.uint64)
    for walk in range(WALKS):
        for band in range(BANDS):
            drawn = np.ascontiguousarray(prints[:, walk, _DRAWN[walk, band]])
            keys[:, walk, band] = [xxhash.xxh64_intdigest(x, seed=band) for x in drawn]
        keys[:, walk] ^= np.uint64(0x9E3779B97F4A7C15) * (levels.astype(np.uint64) * np.uint64(WALKS) + np.uint64(walk))[:, None]
        keys[:, walk] -= keys[:, walk] % np.uint64(_SPOTS)
        keys[:, walk] += (levels.astype(np.uint64) * np.uint64(WALKS) + np.uint64(walk))[:, None]
    return keys.view(np.int64).reshape(len(levels), -1)


def _gathered(batches):
    """Arrow batches put together, up to CHUNK characters (or bytes) or ROWS rows; the text is the last column."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.column(batch.num_columns - 1).nbytes
        if rows >= ROWS or size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(rows: DataFrame) -> list[int]:
    """Ascending ids that part the rows in at most RANGES ranges of about as many rows, whatever gaps the ids have.

    They come from ids taken by hash, RANGE_IDS of them in the mean; they only decide which task has a row.
    """
    total = rows.count()
    taken = rows if total <= RANGE_IDS else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("range")), F.lit(total)) < RANGE_IDS)
    ids = np.sort(taken.select("doc_id").dropna().distinct().toArrow().column("doc_id").combine_chunks().to_numpy())
    count = min(RANGES, total // RANGE_ROWS + 1)
    return np.unique(ids[len(ids) * np.arange(1, count) // count]).tolist() if len(ids) else []


def _range_of(id_col: str, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the id, by binary search; -1 for a null id."""
    if not bounds:
        return F.when(F.col(id_col).isNull(), -1).otherwise(0)
    width = 1 << (len(bounds).bit_length() - 1)
    steps = ", ".join(str(width >> k) for k in range(width.bit_length()))
    known = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    search = f"aggregate(array({steps}), 0, (at, s) -> if(at + s <= {len(bounds)} and get({known}, least(at + s, {len(bounds)}) - 1) <= {id_col}, at + s, at))"
    return F.when(F.col(id_col).isNull(), -1).otherwise(F.expr(search))


def side_by_side(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(_range, _tail, doc_id, _text), dealt and sorted by range so that each row's next one follows it.

    Ids fall in ordered ranges. The first row of each range is also put, as its tail, behind the rows of
    the range before it, so no task needs another's rows; only one row a range goes twice.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_range", _range_of("doc_id", _bounds(rows)))
    first = [(r["_range"], r["id"]) for r in rows.groupBy("_range").agg(F.min("doc_id").alias("id")).orderBy("_range").collect()]  # RANGES + 1 rows at most
    tails = docs.sparkSession.createDataFrame([(i, first[k - 1][0]) for k, (_, i) in enumerate(first)], "_first long, _before int")
    rows = rows.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    places = F.array_compact(F.array(F.struct(F.col("_range").alias("_range"), F.lit(0).alias("_tail")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_tail")))))
    rows = rows.select("doc_id", "_text", F.explode(places).alias("_place")).select("_place._range", "_place._tail", "doc_id", "_text")
    return rows.repartition("_range").sortWithinPartitions("_range", "_tail", "doc_id", "_text")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and print (the bytes of the fingerprint) of every whole text; null counts as empty, equal texts have equal fingerprints.

    One row for each input row; extra columns go; an empty table gives no row. A text that is very long takes one task
    a time in proportion to its length.
    """
    kept = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def make(batches):
        for batch in _gathered(batches):
            found = sketch(batch.column(batch.num_columns - 1).to_pylist())
            out = pa.Table.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.column_names[:-1], "print"])
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, make, f"{schema}, print binary")


def _compared_with_next(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """What compare_with_next gives, in bytes, which take half the room in a shuffle."""

    def walk(batches):
        held = None  # the last row of the batch before, whose next one is still to come
        for batch in _gathered(batches):
            ranges, tails, ids, texts = (c.to_pylist() for c in (batch.column(n) for n in ("_range", "_tail", "doc_id", "_text")))
            if held:
                ranges, tails, ids, texts = ([h, *c] for h, c in zip(held, (ranges, tails, ids, texts), strict=True))
            held = (ranges[-1], tails[-1], ids[-1], texts[-1]) if ranges else held
            at = [i for i in range(len(ranges) - 1) if not tails[i] and ranges[i] == ranges[i + 1]]
            after = [edited(texts[i], texts[i + 1]) for i in at]
            found = sketch(texts + after)  # the last row's is found again with the next batch
            own, theirs = found[: len(texts)], found[len(texts) :]
            out = pa.Table.from_arrays(
                [
                    pa.array([ids[i] for i in at], pa.int64()),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in after], pa.binary()),
                    pa.array([own[i] for i in at], pa.binary()),
                    pa.array(theirs, pa.binary()),
                    pa.array(likeness([(own[i], x) for i, x in zip(at, theirs, strict=True)]), pa.float64()),
                    pa.array(likeness([(own[i], own[i + 1]) for i in at]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            yield from out.to_batches()

    return map_batches(side_by_side(docs, text_col, id_col), walk, "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _in_hex(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: its fingerprint (hex), that of its edited text, and their likeness.

    Ids are cast to long. Rows are in the order of id (null first), then text; the last one's next is the first. Null texts
    are empty; an empty text has the empty fingerprint, which is like another empty one only. A single row is its own next. An empty table
    gives no row; extra columns go; repeated rows have a result each, and rows of one id are one task's.
    """
    return _in_hex(_compared_with_next(docs, text_col, id_col))


def _node(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _walked(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, level, print) of the levels of every different text: WALKS * COORDS bytes."""

    def make(batches):
        for batch in _gathered(batches):
            nodes = batch.column(0).to_numpy()
            _, first = np.unique(nodes, return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            for level, places, prints in walk_prints(texts):
                own = pa.array([x.tobytes() for x in prints], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[first[places]], pa.int64()), pa.array(np.full(len(own), level), pa.int32()), own], ["node", "level", "print"])

    kept = docs.select(_node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return written(map_batches(kept, make, "node long, level int, print binary").dropDuplicates(["node", "level"]))


def _compared(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, spot, differ) of the pairs (a, b, spot) of nodes: coordinates of the spot's walk that differ."""
    both = pairs.withColumn("level", F.expr(f"cast(spot div {WALKS} as int)"))
    for side in "ab":
        both = both.join(prints.select(F.col("node").alias(side), "level", F.col("print").alias(f"_{side}")), [side, "level"])
    own = [F.expr(f"substring(_{side}, cast(spot % {WALKS} as int) * {COORDS} + 1, {COORDS})").alias(f"_{side}") for side in "ab"]

    def compare(batches):
        for batch in batches:
            mine, theirs = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDS) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((mine != theirs).sum(axis=1), pa.int64())], ["a", "b", "spot", "differ"])

    return written(map_batches(both.select("a", "b", "spot", *own), compare, "a long, b long, spot long, differ long"))


def near_links(docs: DataFrame, unlike: float = UNLIKE, text_col: str = "text") -> DataFrame:
    """(a, b) of links between near texts, each text by its node, the hash of the text; empty texts have none.

    Texts that share a band of a walk are candidates, and near if at most ``unlike`` of that walk's coordinates differ.
    Each text of a band is compared with a few pivots: the band's first text, then others of the band's
    largest component. After that, texts of different components are compared, where their distances from the pivots do not
    rule it out: those differ by no more than the texts do. So the links join all texts that any near pair of a band would join.
    An empty table gives no row; repeated rows are one node; extra columns are not read.
    """
    return _links_and_components(docs, unlike, text_col)[0]


def _links_and_components(docs: DataFrame, unlike: float, text_col: str) -> tuple[DataFrame, DataFrame]:
    """near_links, and the (node, component) of all nodes in them; each call of components goes on from the one before."""
    most = int(unlike * COORDS)
    prints = _walked(docs, text_col)

    def cut(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WALKS, COORDS)
            keys = band_keys(batch.column(1).to_numpy(), own)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "node"])

    dealt = map_batches(prints, cut, "key long, node long").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot != top").select("key", "pivot")
    rows, links = written(dealt.join(shared, "key").withColumn("spot", F.expr(f"pmod(key, {_SPOTS}L)"))), None
    joined = None
    met = rows.select("node", F.expr(f"cast(spot div {WALKS} as int)").alias("level")).distinct()
    prints = written(prints.join(met, ["node", "level"], "left_semi"))  # the others are compared with none
    for turn in range(PIVOTS):
        told = _compared(rows.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "spot").distinct(), prints)
        found = told.where(F.col("differ") <= most).select("a", "b")
        links = found if links is None else links.unionByName(found)
        joined = components(found, joined)
        rows = rows.drop("component", "main").withColumnRenamed("pivot", "met").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("texts"), F.max_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        main = sizes.groupBy("key").agg(F.max(F.struct("texts", "component", "pivot")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
        rows = rows.join(main.select("key", F.col("m.component").alias("main"), F.col("m.pivot").alias("pivot")), "key")
        mark = told.select(F.col("a").alias("met"), F.col("b").alias("node"), "spot", F.col("differ").alias(f"d{turn}"))
        rows = written(rows.join(mark, ["met", "node", "spot"], "left").fillna(0, [f"d{turn}"]).drop("met"))  # the pivot is at no distance
        if rows.isEmpty():
            return links, joined
    marks = [f"d{turn}" for turn in range(PIVOTS)]
    strays = rows.where("component != main").select("key", *(F.col(c).alias(f"_{c}") for c in ("node", "component", *marks)))
    both = (F.col("component") != F.col("_component")) & ((F.col("component") == F.col("main")) | (F.col("_node") < F.col("node")))
    for mark in marks:
        both &= F.abs(F.col(mark) - F.col(f"_{mark}")) <= most
    left = strays.join(rows, "key").where(both).select(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b"), "spot")
    left = written(left.distinct())
    if left.isEmpty():
        return links, joined
    found = _compared(left, prints).where(F.col("differ") <= most).select("a", "b")
    return links.unionByName(found), components(found, joined)


def near_ids(docs: DataFrame, unlike: float = UNLIKE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, near_id) of every row: near_id is the smallest id of the texts that are equal or joined by links.

    Null ids are no smallest unless there is no other; null texts are empty; repeated rows repeat; an empty table gives no row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _node(text_col).alias("node"))
    _, joined = _links_and_components(docs, unlike, text_col)
    rows = rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = written(rows.select("doc_id", "component"))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("near_id"))
    return rows.join(least, "component").select("doc_id", "near_id")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the smallest id among each document's near texts."""
    docs = table(spark, sf_dir, "documents")
    near = near_ids(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.min("near_id").alias("near_id"))
    found = _compared_with_next(docs, "text", "doc_id")
    return _in_hex(found.join(near, found["doc_id"].eqNullSafe(near["_id"]), "left").select(*found.columns, "near_id"))
