"""Phrase collocations: suffixes routed by their leading words and counted by multikey three-way quicksort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, table, written

#: Least occurrences of a phrase, most words of one, rows of a language's report.
LEAST, DEPTH, TOP = 30, 4, 2000
#: A candidate goes if a longer one that contains it has this share of its occurrences, in percent.
COVERED = 80
#: Hash buckets of word pairs, and as many of triples (a power of two), and buckets of one row of their tables: a byte for each is broadcast, 32 MB.
PAIR_BITS, BLOCK_BITS = 24, 12
#: Routes are dealt by so many bits: the suffixes of one chunk and one of these parts travel as one row.
ROUTE_BITS = 14
#: Bytes of text that are split at once, and rows that are sorted at once.
CHUNK, RUN = 8 << 20, 1 << 20
#: Occurrences of a leading pair above which its suffixes are dealt to several tasks, as a power of two.
HOT_BITS = 20
UND = "und"

# The characters that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = bytes(2 if c in PIECE_ENDS else 1 if c in BLANKS else 0 for c in range(256))


class _Words:
    """The words of a chunk of one language: codes into ``names``, the piece of each, hashes of the names."""

    def __init__(self, lang: str, data: bytes):
        data = data.translate(_LOWER)
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        letters = np.frombuffer(data, np.uint8)[inside]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.lang, self.names, self.codes = lang, words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        seed = xxhash.xxh32_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names.to_pylist()), np.uint64, len(self.names))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word but the last: whether the next is of the same piece, and a hash of both."""
        own = self.hashes[self.codes]
        return self.piece[:-1] == self.piece[1:], _mixed(own[:-1], own[1:])

    def frequent_pairs(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word but the last: the bits of its pair's count (0 at a piece's end too), and the pair's hash."""
        same, mixed = self.pairs()
        return np.where(same, sizes[_bucket(mixed)], 0) if len(same) else np.zeros(0, np.uint8), mixed

    def triples(self, mixed: np.ndarray) -> np.ndarray:
        """For each word but the last two: a hash of it and the next two."""
        return _mixed(mixed[:-1], self.hashes[self.codes[2:]])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of (lang, text) batches, by language and about CHUNK bytes; a text is whole in one chunk, and ends its last piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= CHUNK:
                yield _Words(lang, b"\n".join(held.pop(lang)))
                size[lang] = 0
        if sum(size.values()) >= 4 * CHUNK:  # many languages with a little each
            for lang in list(held):
                yield _Words(lang, b"\n".join(held.pop(lang)))
            size.clear()
    for lang, texts in held.items():
        yield _Words(lang, b"\n".join(texts))


def _blocks(bucket: np.ndarray) -> list[pa.Array]:
    """(block, places, counts) of bucket numbers: how often each occurs, sparse in blocks of buckets."""
    bucket, n = np.unique(bucket.astype(np.uint32), return_counts=True)
    block, first = np.unique(bucket >> np.uint32(BLOCK_BITS), return_index=True)
    cuts = np.append(first, len(bucket))
    at, n = (bucket & np.uint32((1 << BLOCK_BITS) - 1)).astype("<u2"), n.astype("<u4")
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (at, n)]
    return [pa.array(block.astype(np.int32)), *packed]


def _count_words(batches):
    """Of each chunk: words with their counts, and the counts of pair buckets."""
    for words in _chunks(batches):
        n = np.bincount(words.codes, minlength=len(words.names))
        yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(n), pa.string()), words.names.cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], _COUNTED)
        same, mixed = words.pairs()
        found = _blocks(_bucket(mixed[same]))
        none = len(found[0])
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.string()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), *found], _COUNTED)


_COUNTED = ["lang", "phrase", "n", "block", "places", "counts"]


def _sizes(batches):
    """Rows of (block, places, counts), by block: (block, a byte for each bucket), 0 below LEAST, else the bits of its count."""
    block, sums = None, None

    def made():
        bits = np.where(sums >= LEAST, np.ceil(np.log2(np.maximum(sums, 1) + 1)), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for own, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
            if own != block:
                if sums is not None:
                    yield made()
                block, sums = own, np.zeros(1 << BLOCK_BITS, np.int64)
            sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")
    if sums is not None:
        yield made()


def bucket_sizes(counted: DataFrame) -> np.ndarray:
    """The bits of each bucket's count (0: fewer than LEAST): 2**PAIR_BITS bytes, whatever the input's size."""
    rows = counted.where("block is not null").select("block", "places", "counts").repartition("block").sortWithinPartitions("block")
    found = map_batches(rows, _sizes, "block int, bits binary").toArrow()
    table_ = np.zeros((1 << (PAIR_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        table_[block] = np.frombuffer(bits, np.uint8)
    return table_.ravel()


def _suffixes(words: _Words, pairs: np.ndarray, triples: np.ndarray):
    """(route, split, phrase, n) of the chunk's distinct suffixes: at most DEPTH words, cut before a pair or triple that is too rare.

    A route is a leading pair; that of a hot pair also holds a part of the words that follow (split).
    """
    bits, mixed = words.frequent_pairs(pairs)
    good = np.append(bits > 0, np.zeros(DEPTH, bool))
    at = np.flatnonzero(good)
    if not len(at):
        return None
    longer = np.zeros(len(good), bool)
    if len(mixed) > 1:
        longer[: len(mixed) - 1] = good[: len(mixed) - 1] & good[1 : len(mixed)] & (triples[_bucket(words.triples(mixed))] > 0)
    length = np.full(len(at), 2)
    for k in range(1, DEPTH - 1):
        length += (length == k + 1) & longer[at + k - 1]
    codes = np.append(words.codes.astype(np.int64), np.zeros(DEPTH, np.int64))
    many = np.int64(len(words.names) + 1)
    key = codes[at] * many + codes[at + 1]
    if DEPTH > 2:  # exact ids of the first two words, then of both halves
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        for k in range(2, DEPTH):
            more = np.where(length > k, codes[at + k] + 1, 0)
            key = np.unique(key * many + more, return_inverse=True)[1].astype(np.int64)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    at, length = at[first], length[first]
    names = words.names
    parts = [names.take(pa.array(codes[at + k], mask=length <= k)) for k in range(DEPTH)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    route, extra = mixed[at], np.maximum(bits[at].astype(np.int64) - HOT_BITS, 0)
    tail = np.zeros(len(at), np.uint64)
    for k in range(2, DEPTH):
        tail = (tail ^ np.where(length > k, words.hashes[words.codes[np.minimum(at + k, len(words.codes) - 1)]], np.uint64(0))) * np.uint64(0x94D049BB133111EB)
    part = (tail >> np.uint64(40)) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))
    return (route + part * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64), extra > 0, phrase, n


def frequent_prefixes(words: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, depth, weight): the prefixes of 2 words or more whose rows weigh ``least`` or more, by multikey three-way quicksort.

    ``words`` has a suffix of word codes a row, -1 beyond its end. Pointers to the rows are parted by the word at one depth
    into those below, at and above a pivot; the equal part's weight is its prefix's count, and it is parted on at
    the next depth; parts that weigh less than ``least`` are abandoned.
    """
    found, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        here = words[rows, depth]
        pivot = here[len(here) >> 1]
        equal = here == pivot
        for part, deeper in ((here < pivot, 0), (equal, 1), (here > pivot, 0)):
            own = rows[part]
            weight = int(weights[own].sum())
            if not len(own) or weight < least or deeper and pivot < 0:
                continue
            if deeper and depth:
                found.append((int(own[0]), depth + 1, weight))
            if depth + deeper < words.shape[1]:
                stack.append((own, depth + deeper))
    return found


def _routed(words: _Words, found) -> pa.RecordBatch:
    """One row (lang, part, split, phrases, counts) for each part of the routes that the chunk's suffixes take."""
    route, split, phrase, n = found
    part = (route.view(np.uint64) >> np.uint64(64 - ROUTE_BITS)).astype(np.int64) * 2 + split
    order = np.argsort(part, kind="stable")
    part, first = np.unique(part[order], return_index=True)
    offsets = pa.array(np.append(first, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x.take(pa.array(order))) for x in (phrase.cast(pa.string()), pa.array(n, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([words.lang] * len(part), pa.string()), pa.array(part >> 1), pa.array((part & 1).astype(bool)), *lists], _ROUTED)


_ROUTED = ["lang", "part", "split", "phrases", "counts"]


def _counted(rows: list[pa.RecordBatch], loose: bool) -> pa.RecordBatch:
    """(lang, phrase, n) of the prefixes of rows' suffixes; of split and ``loose`` ones all, which are parts of a sum, of others those of LEAST or more."""
    whole = pa.concat_batches(rows)
    size = pc.list_value_length(whole.column("phrases")).to_numpy()
    langs = whole.column("lang").dictionary_encode()
    code = np.repeat(langs.indices.to_numpy(zero_copy_only=False), size)
    split = np.repeat(whole.column("split").to_numpy(zero_copy_only=False), size) | loose
    weights = pc.list_flatten(whole.column("counts")).to_numpy()
    parts = pc.split_pattern(pc.list_flatten(whole.column("phrases")), " ")
    flat = pc.list_flatten(parts).dictionary_encode()
    size = pc.list_value_length(parts).to_numpy()
    words = np.full((len(parts), DEPTH), -1, np.int32)
    words[np.repeat(np.arange(len(parts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat.indices.to_numpy(zero_copy_only=False)
    names = flat.dictionary.to_pylist()
    out: tuple[list, list, list] = [], [], []
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        for some, least in ((split, 1), (~split, LEAST)):
            own = np.flatnonzero(some & (code == k))
            for at, depth, n in frequent_prefixes(words[own], weights[own], least) if len(own) else ():
                for column, x in zip(out, (lang, " ".join(names[w] for w in words[own[at], :depth]), n), strict=True):
                    column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "phrase", "n"])


def _sorted_counts(batches):
    """(lang, phrase, n) from routed suffixes that come by part, about RUN at a time; a part of more than RUN is counted in parts of a sum."""
    held, size, loose, now = [], 0, False, None
    for batch in batches:
        for k, (part, n) in enumerate(zip(batch.column("part").to_pylist(), pc.list_value_length(batch.column("phrases")).to_pylist(), strict=True)):
            if part != now:
                if loose or size >= RUN:
                    yield _counted(held, loose)
                    held, size = [], 0
                loose, now, own = False, part, len(held)
            held.append(batch.slice(k, 1))
            size += n
            if size >= 2 * RUN:  # this part alone is large: what came before it is whole
                if own:
                    yield _counted(held[:own], False)
                yield _counted(held[own:], True)
                held, size, loose, own = [], 0, True, 0
    if held:
        yield _counted(held, loose)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang: Column | str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all words, (lang, phrase, n) of the words and phrases of at most DEPTH words that occur LEAST times or more).

    Null texts count as empty, a null language as ``und``; repeated rows count each, further columns are not read, and an
    empty table gives empty results. A text is split whole, so one needs a task's memory several times over.
    """
    lang = F.col(lang) if isinstance(lang, str) else lang
    texts = docs.select(F.coalesce(lang.cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = written(map_batches(texts, _count_words, "lang string, phrase string, n long, block int, places binary, counts binary"))
    single = written(counted.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(bucket_sizes(counted))

    def count_triples(batches):
        for words in _chunks(batches):
            bits, mixed = words.frequent_pairs(pairs.value)
            if len(mixed) > 1:
                yield pa.RecordBatch.from_arrays(_blocks(_bucket(words.triples(mixed)[(bits[:-1] > 0) & (bits[1:] > 0)])), _COUNTED[3:])

    triples = send(bucket_sizes(map_batches(texts, count_triples, "block int, places binary, counts binary")))

    def cut(batches):
        for words in _chunks(batches):
            if (found := _suffixes(words, pairs.value, triples.value)) is not None:
                yield _routed(words, found)

    routed = map_batches(texts, cut, "lang string, part long, split boolean, phrases array<string>, counts array<long>").repartition("part").sortWithinPartitions("part")
    longer = map_batches(routed, _sorted_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return single.groupBy("lang").agg(F.sum("n").alias("n")), single.unionByName(longer).where(F.col("n") >= LEAST)


def collocations(docs: DataFrame, text_col: str = "text", lang: Column | str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by how often their parts occur together.

    See phrase_counts for nulls and empty tables. Ties in score go by a, then by phrase in byte order.
    """
    totals, counts = phrase_counts(docs, text_col, lang)
    counts = written(counts)
    words = F.split("phrase", " ")
    candidates = counts.withColumns({"w": words, "size": F.size(words)}).where("size >= 2")
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    inner = candidates.where("size > 2").withColumn("_size", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("_at", F.explode(F.expr("sequence(1, size - _size + 1)")))
    inside = inner.select("lang", joined(F.col("_at"), F.col("_size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (exact("_longer") * 100 < exact("n") * COVERED))

    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("_left"), joined(F.col("k") + 1, F.col("size")).alias("_rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r")), ["lang", "_rest"])
    score = F.call_function("div", exact("a") * F.lit(2_000_000), exact("l") + exact("r"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    rows = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))  # a language's rows are cut down in parts first
    first = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_SPLIT = r"[.,;:!?\x0A-\x0D]"
#: Words by place, phrases as arrays of words that follow each other in a piece, and the same joins.
SQL = f"""WITH docs AS (SELECT coalesce(lang, '{UND}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '{_SPLIT}')) AS piece FROM docs),
    listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, (SELECT unnest(range(1, {DEPTH + 1})) AS k) WHERE i + k - 1 <= len(w)),
    totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
    f AS (SELECT lang, phrase, k AS size, count(*) AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {LEAST}),
    cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
    inner_ AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM (
        SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM cand)) GROUP BY ALL),
    kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a),
    cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
    scored AS (SELECT c.lang, c.phrase, c.a, c.k, h.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (h.a + r.a))::BIGINT AS score
        FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
