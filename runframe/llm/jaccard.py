"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams, with size-derived bounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .components import components

#: Size of the frequency sketch (2**BITS counters) and the pieces in which it is added up.
BITS, PIECES = 22, 64
#: Nodes of a square block of the product, nodes on a side of a family's block, columns multiplied at once.
BLOCK, SIDE, COLUMNS = 256, 512, 2_048
#: Members that a head's row of the product meets in one block, and their n-grams that are multiplied at once.
MEMBERS, ENTRIES = 2_000, 2_000_000
#: A prefix holds one n-gram more for each EXTRA of the set, and linked sets share that many more.
EXTRA = 20
#: So many uses of sets are broadcast at most to where the texts are; more are joined by a shuffle.
BROADCAST_USES = 300_000
#: A posting has a set's size and its n-gram's place in the set's prefix in one number: size * PLACES + place.
PLACES = 1 << 31
#: Words whose hashes a task remembers.
MAX_WORDS = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], k: int, known: _Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (all its words if it has fewer)."""
    words = [(text or "").encode("utf-8", "replace").lower().split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((known[w] for own in words for w in own), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for i in range(k):
        rolled *= _P
        rolled += flat[i : i + len(rolled)]
    rolled ^= rolled >> np.uint64(31)
    rolled *= _Q
    rolled ^= rolled >> np.uint64(29)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(rolled[end - n : end - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(flat[end - n : end].tobytes(), seed=n)], np.uint64))
        else:
            out.append(flat[:0])
    return out


def set_hash(own: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """So many shingles of a set, first in any common order, meet those of each set as similar as ``percent``."""
    return n - -(-percent * n // 100) + 1


def least_shared(n, percent: int | None = None):
    """So many n-grams the prefixes of linked sets share, the smaller of n; with ``percent``, for any partner of a set of n."""
    if percent is not None:
        n = F.ceil(n * percent / 100)
    return 1 + F.floor(n / EXTRA)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: doc_id, n, node (hash of its set; null if empty); and rows with the task's n-gram counts."""

    def describe(batches):
        known, counts = _Words(), None
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k, known)
            if counts is None:
                counts = np.zeros(1 << BITS, np.uint32)
            for own in sets:
                counts[own >> np.uint64(64 - BITS)] += np.uint32(1)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "node", "piece", "counts"])
        if counts is not None:
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n", "node", "piece", "counts"])

    return written(map_batches(docs, describe, "doc_id long, n long, node long, piece int, counts binary"))


def _frequency_levels(described: DataFrame) -> np.ndarray:
    """For each hash range of n-grams, how far above the mean its count is, in steps of a factor 1.4.

    The counts cover all documents; the sketch has 2**BITS bytes whatever the input. It only orders
    n-grams, rarest first: any order gives the same links, this one gives the fewest candidates.
    """

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(piece, np.zeros((1 << BITS) // PIECES, np.uint64))
                own += np.frombuffer(zlib.decompress(blob), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["piece", "counts"])

    blobs = described.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece")
    total = np.zeros(1 << BITS)
    size = (1 << BITS) // PIECES
    for row in map_batches(blobs, add, "piece int, counts binary").collect():  # PIECES rows
        total[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return (2 * np.log2(np.maximum(total / max(1.0, total.mean()), 1))).astype(np.uint8)


def _postings(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(key, node, spot): the incidence of each distinct set with the n-grams of its prefix, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def cut(batches):
        known, order, seen = _Words(), shared.value, set()
        for batch in batches:
            keys, nodes, sizes, lengths = [np.zeros(0, np.uint64)], [], [], []
            for own in shingle_sets(batch.column("text").to_pylist(), k, known):
                node, n = set_hash(own) if len(own) else None, len(own)
                if node is None or node in seen:  # one copy from a task is enough
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                first = min(n, prefix_length(n, percent) + n // EXTRA)
                rank = order[own >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(56) | own * _P >> np.uint64(8)
                if first < n:
                    part = np.argpartition(rank, first - 1)[:first]
                    own, rank = own[part], rank[part]
                keys.append(own[np.argsort(rank)])
                nodes.append(node)
                sizes.append(n)
                lengths.append(first)
            lengths = np.array(lengths, np.int64)
            places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            spots = np.repeat(np.array(sizes, np.int64), lengths) * PLACES + places
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(spots)], ["key", "node", "spot"])

    return map_batches(docs.select("text"), cut, "key long, node long, spot long")


def _can_link(n: str, place: str, m: str, other: str, percent: int):
    """Whether sets of n and m n-grams have sizes of linked ones, and an n-gram at these places of their prefixes counts.

    Linked sets share ``both`` n-grams at least, so least_shared of them lie among the first n - both + least_shared of each.
    """
    sizes = (100 * F.least(n, m)) >= (percent * F.greatest(n, m))
    both = F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))
    slack = least_shared(F.least(n, m)) - both
    return sizes & (F.col(place) < F.col(n) + slack) & (F.col(other) < F.col(m) + slack)


def _sets(docs: DataFrame, places: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(cell, block, role, node, own): the set of each asked (node, cell, block, role), sorted by cell, block and role.

    ``places`` (node, doc_id) says where a set's text is. A node is asked for in few cells.
    """
    asked = asked.groupBy("node").agg(F.collect_list(F.struct("cell", "block", "role")).alias("roles"))
    asked = written(asked.join(places, "node").select(F.col("doc_id").alias("_asked"), "node", "roles"))
    uses = asked.agg(F.sum(F.size("roles"))).first()[0] or 0
    asked = F.broadcast(asked) if uses <= BROADCAST_USES else asked
    texts = docs.join(asked, docs["doc_id"].eqNullSafe(asked["_asked"])).select("text", "node", "roles")

    def sets(batches):
        known = _Words()
        for batch in batches:
            out = []
            for own, node, roles in zip(shingle_sets(batch.column("text").to_pylist(), k, known), batch.column("node").to_pylist(), batch.column("roles").to_pylist(), strict=True):
                if len(own) and set_hash(own) == node:  # an id may be that of several rows
                    out += [(r["cell"], r["block"], r["role"], node, own.tobytes()) for r in roles]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["cell", "block", "role", "node", "own"])

    found = map_batches(texts, sets, "cell long, block int, role int, node long, own binary")
    return found.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")


def overlaps(rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Sizes of the intersections of the sets: the incidence times its transpose, a block of columns at a time.

    Before each block, sets are left out that can no longer reach the overlap of a link with any other, by what
    they share so far and the n-grams that they have left; sizes of theirs with others are then too small, and no link.
    """
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    _, column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # an n-gram of one set alone adds nothing
    row = np.repeat(np.arange(len(rows)), sizes)[place >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    need = -(-percent * (sizes[:, None] + sizes[None, :]) // (100 + percent))
    np.fill_diagonal(need, 1 << 40)
    left = np.bincount(row, minlength=len(rows))
    total = np.zeros((len(rows), len(rows)))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        open_rows = (total + np.minimum.outer(left, left) >= need).any(axis=1)
        part = slice(*np.searchsorted(place, (low, low + COLUMNS)))
        left = left - np.bincount(row[part], minlength=len(rows))
        if not open_rows.any():
            break
        some = open_rows[row[part]]
        at = np.cumsum(open_rows) - 1
        incidence = np.zeros((int(open_rows.sum()), COLUMNS), np.float32)
        incidence[at[row[part][some]], place[part][some] - low] = 1
        total[np.ix_(open_rows, open_rows)] += incidence @ incidence.T
    return total.astype(np.int64)


def block_links(nodes: list[int], rows: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A link from each node to the first of its component in the block: pairs below the size-derived bounds are dropped."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    both = overlaps(rows, percent)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    first = np.arange(len(rows))
    while True:
        least = np.where(linked, first[None, :], len(rows)).min(axis=1)
        least = np.minimum(first, least)
        if np.array_equal(least, first):
            break
        first = least
    return [(nodes[f], nodes[i]) for i, f in enumerate(first.tolist()) if f != i]


def row_overlaps(row: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """A row of the product: the overlaps of one set with each of the others, from one pass over the n-grams of all."""
    entries = np.concatenate(columns)
    place = np.minimum(np.searchsorted(row, entries), len(row) - 1)
    return np.add.reduceat((row[place] == entries).astype(np.int64), np.cumsum([0, *map(len, columns[:-1])]))


def _multiplied(docs: DataFrame, places: DataFrame, cells: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each block of ``cells`` (node, cell, block)."""

    def multiply(batches):
        at, nodes, rows = None, [], []

        def links():
            found = block_links(nodes, rows, percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for cell, block, _, node, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (cell, block):
                    yield links()
                    at, nodes, rows = (cell, block), [], []
                if node not in nodes:
                    nodes.append(node)
                    rows.append(np.frombuffer(own, np.uint64))
        yield links()

    return written(map_batches(_sets(docs, places, cells.withColumn("role", F.lit(0)), k), multiply, "a long, b long"))


def _verified(docs: DataFrame, places: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs (head, node): rows of the product, each head by its members.

    A head's set is sent once to each block of its members; a task holds one head's set at a time, and of its members so
    many as have ENTRIES n-grams.
    """
    sizes = pairs.groupBy("head").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    members = pairs.join(sizes, "head").select("node", F.col("head").alias("cell"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"))
    heads = sizes.select(F.col("head").alias("node"), F.col("head").alias("cell"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("role"))

    def multiply(batches):
        at, row, nodes, columns, held = None, None, [], [], 0

        def links():
            linked = []
            if columns:
                both = row_overlaps(row, columns)
                sizes = np.fromiter(map(len, columns), np.int64, len(columns))
                linked = np.asarray(nodes)[100 * both >= percent * (len(row) + sizes - both)].tolist()
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(linked) if linked else [], pa.int64()), pa.array(linked, pa.int64())], ["a", "b"])

        for batch in batches:
            for head, block, role, node, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(own, np.uint64)
                if role == 0 or held > ENTRIES:
                    if columns:
                        yield links()
                    nodes, columns, held = [], [], 0
                if role == 0:
                    at, row = (head, block), own
                elif at == (head, block):
                    nodes.append(node)
                    columns.append(own)
                    held += len(own)
        yield links()

    return written(map_batches(_sets(docs, places, members.unionByName(heads), k), multiply, "a long, b long"))


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: components of the links of Jaccard similarity >= ``percent`` / 100.

    A row's set is its distinct ``words``-word shingles (A-Z lower-cased, split at space and 0x09-0x0D); a
    text with fewer words is one shingle; null, empty and blank texts have the empty set, are linked
    with nothing and are their own component. component_id is the smallest id reachable. Equal sets, as of
    copies, are one node. Null ids are allowed and never the smallest unless there is no other; an empty table
    gives no row; extra columns go.

    Two linked sets share least_shared n-grams of their prefixes and have similar sizes, so a set
    that shares fewer with all others is done. A node goes to the n-gram of its
    prefix that most nodes have, where blocks of at most about BLOCK nodes are multiplied whole; n-grams of
    more than one block are dealt into blocks anew and multiplied again, which joins near all of a large
    group of near copies. Then every pair of an n-gram whose nodes are still in different components is
    compared, so no link between components is lost.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = _described(docs, words)
    rows = described.where("piece is null").select("doc_id", "n", "node")
    places = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    postings = written(_postings(docs, words, percent, _frequency_levels(described)))
    dealt = postings.repartition("key")
    # Reading the spot here too gives both sides of the join the same columns, so that one shuffle serves both.
    shared = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.max("spot").alias("spot")).where("low != top and spot > 0")
    met = dealt.join(shared.select("key"), "key").distinct()
    met = written(met.select("key", "node", F.expr(f"spot div {PLACES}").alias("n"), (F.col("spot") % PLACES).alias("place")))
    by_node = met.repartition("node")
    able = by_node.groupBy("node").agg(F.count("key").alias("keys"), F.max("n").alias("n"), F.max("place").alias("place")).where(F.col("keys") >= least_shared(F.col("n"), percent)).select("node")
    able = by_node.join(able, "node").select("key", "node", "n", "place")
    met = written(able.join(able.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "key"))
    homes = met.groupBy("node").agg(F.max(F.struct("times", "key"))["key"].alias("cell"))
    sizes = homes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1")
    homes = written(homes.join(sizes, "cell"))
    deal = lambda turn: F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int").alias("block")
    links = _multiplied(docs, places, homes.select("node", "cell", deal(1)), words, percent)
    again = homes.where("blocks > 1")
    if not again.isEmpty():
        links = links.unionByName(_multiplied(docs, places, again.select("node", "cell", deal(2)), words, percent))
    joined = components(links)
    large = met.where(F.col("times") > BLOCK).select("key", "node")
    if not large.isEmpty():
        links = links.unionByName(_multiplied(docs, places, _family_cells(large, joined), words, percent))
        joined = components(links)
    left = _open_pairs(met.where(F.col("times") <= BLOCK), joined, percent)
    if not left.isEmpty():
        joined = components(links.unionByName(_verified(docs, places, left, words, percent)))
    least = joined.join(places, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = joined.join(least, "component").select("node", "least")
    classes = places.join(named, "node", "left").select("node", F.coalesce("least", "doc_id").alias("least"))
    return rows.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _family_cells(large: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, cell, block) for the nodes of n-grams of more than one block, wherever those are not yet all joined.

    Nodes that such n-grams connect are a family. Blocks of the nodes outside its largest component meet
    blocks of all its nodes, so a node goes to a cell for each block on the other side, and no pairs are written.
    """
    heads = large.groupBy("key").agg(F.min("node").alias("head"))
    family = components(large.join(heads, "key").select(F.col("head").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "cell")
    nodes = family.join(joined, "node", "left").select("node", "cell", F.coalesce("component", "node").alias("component"))
    sizes = nodes.groupBy("cell", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cell").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    down, across = F.ceil((F.col("all") - F.col("main.size")) / SIDE).cast("int"), F.ceil(F.col("all") / SIDE).cast("int")
    nodes = written(nodes.join(main.select("cell", F.col("main.component").alias("main"), down.alias("down"), across.alias("across")), "cell"))
    own = lambda turn, n: F.pmod(F.xxhash64("node", F.lit(turn)), F.col(n)).cast("int")
    rows = nodes.where("component != main").withColumn("i", own(3, "down")).select("node", "cell", F.explode(F.expr("transform(sequence(0, across - 1), j -> i * across + j)")).alias("block"))
    columns = nodes.withColumn("j", own(4, "across")).select("node", "cell", F.explode(F.expr("transform(sequence(0, down - 1), i -> i * across + j)")).alias("block"))
    return rows.unionByName(columns)


def _open_pairs(met: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that share enough n-grams, from n-grams with more than one component.

    Only pairs that share no n-gram of more than one block need be found here, and of those all n-grams are counted.
    """
    lists = met.select("key", "node", "n", "place").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = lists.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    lists = written(lists.join(main, "key"))
    strays = lists.where("component != main").select("key", F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("place").alias("head_place"), F.col("component").alias("head_component"))
    both = strays.join(lists, "key").where((F.col("component") != F.col("head_component")) & ((F.col("component") == F.col("main")) | (F.col("head") < F.col("node"))) & _can_link("n", "place", "head_n", "head_place", percent))
    # Which of a pair is the stray depends on the n-gram, so a pair is counted whichever way round its n-grams give it.
    pair = both.select(F.least("head", "node").alias("low"), F.greatest("head", "node").alias("top"), (F.col("head") < F.col("node")).cast("int").alias("low_heads"), F.least("n", "head_n").alias("n"))
    counted = pair.groupBy("low", "top").agg(F.count("*").alias("keys"), F.sum("low_heads").alias("low_heads"), F.first("n").alias("n")).where(F.col("keys") >= least_shared(F.col("n")))
    low_heads = 2 * F.col("low_heads") >= F.col("keys")
    return written(counted.select(F.when(low_heads, F.col("low")).otherwise(F.col("top")).alias("head"), F.when(low_heads, F.col("top")).otherwise(F.col("low")).alias("node")))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents by four-word shingles at a similarity of 0.85."""
    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def keep_one_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with the smallest id of their group, with the columns of documents.

    Five-word shingles, similarity 0.8. Rows that repeat such an id with the same text are one, with the other columns of
    one of them; a document in no group, as those without words, stays; an empty table gives none.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they do not clash with those added
    text, key = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    groups = jaccard_groups(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept")).distinct()
    plain = docs.toDF(*names)
    kept = plain.join(groups, plain[key].eqNullSafe(groups["kept"]), "left_semi")
    return kept.dropDuplicates([key, text]).toDF(*docs.columns)


#: What op5_ngram_jaccard returns, for DuckDB.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.m, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""
