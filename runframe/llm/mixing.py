"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import exclusive_sum
from .common import quoted, table, written

#: Weights of the sources in code point order (null last), repeating, and the most times a source is used.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, blocks of an output shard, and least parts into which a source's offsets are summed.
BLOCK, SHARD_BLOCKS, PARTS = 128, 1_024, 1_024
#: Cells by which positions meet the sources' intervals, and blocks or documents that one window orders.
GRID, SORTED = 4_096, 65_536
#: Primes by which the slots to be drawn anew are permuted; one of them is coprime to their number.
PRIMES = (1_000_003, 1_000_033)
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank and target of each source from (source, source_size).

    Weighted shares of all words; a target stops at MOST times its source and the excess is shared anew.
    In the order of MOST * size / weight the stopped sources come first: at each source, the level
    is what the others leave for each unit of weight, and the first level not above its own bound holds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS) + 1).cast("double")
    ranked = ranked.withColumns({"weight": weight, "bound": F.lit(float(MOST)) * F.col("source_size")})
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    whole, before = Window.partitionBy(), by_bound.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / weights)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound") * (1 + 1e-12), F.struct(F.col("bound") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    target = F.least(F.col("bound"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", "rank", target.alias("target"))


def _dealt(positions: DataFrame, shares: DataFrame, total: int) -> DataFrame:
    """``positions`` (pos, from 0 below ``total``) with the source of ``shares`` (rank, slots, more) in whose interval each lies.

    Intervals follow each other in the order of rank and are as long as their slots, ``total`` in all.
    """
    high = F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # one row a source
    ends = shares.withColumn("high", high).withColumn("low", F.col("high") - F.col("slots"))
    cells = ends.withColumn("cell", F.explode(F.expr(f"sequence(low * {GRID}L div {total}L, (high - 1) * {GRID}L div {total}L)")))
    met = positions.withColumn("cell", F.expr(f"pos * {GRID}L div {total}L")).join(cells.hint("merge"), "cell")
    return met.where("pos >= low and pos < high").drop("cell", "low", "high", "pos")


def shard_slots(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(rank, blocks, shard, base, n): the slots base to base + n - 1 of a source that an output shard has.

    Each slot of each shard draws its source with the odds of the targets, so a shard's counts are multinomial. What a source
    draws beyond its target is given back, by each shard in proportion to what it drew, and these slots draw
    anew, without replacement, from what the other sources lack. So every source ends with its target, rounded to a block, no slot is lost,
    and the shards are alike, however many there are.
    """
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    own = sources.where("source_size > 0").select("rank", blocks.alias("blocks"), F.round(F.col("target") * blocks / F.col("source_size")).cast("long").alias("slots"))
    own = written(own.where("slots > 0"))
    total = own.agg(F.sum("slots")).first()[0] or 0
    draws = own.sparkSession.range(total).select(F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, total))).alias("pos"))
    drawn = _dealt(draws, own, max(1, total)).groupBy("rank", "blocks", "slots", "shard").agg(F.count("*").alias("n"))
    drawn = written(exclusive_sum(drawn, ["rank"], "shard", F.col("n"), "base"))
    sums = drawn.groupBy("rank").agg(F.sum("n").alias("drawn"))
    given = drawn.join(sums, "rank").withColumn("back", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)))
    given = given.withColumns({"before": F.expr("base * back div drawn"), "after": F.expr("(base + n) * back div drawn")})
    kept = given.select("rank", "blocks", "shard", (F.col("base") - F.col("before")).alias("base"), (F.col("n") - F.col("after") + F.col("before")).alias("n"), (F.col("after") - F.col("before")).alias("back"))
    kept = written(kept)
    anew = kept.groupBy("shard").agg(F.sum("back").alias("n")).where("n > 0").withColumn("all", F.lit(0))
    anew = exclusive_sum(anew, ["all"], "shard", F.col("n"), "first")
    lack = own.join(sums, "rank", "left").withColumn("done", F.coalesce("drawn", F.lit(0))).select("rank", "blocks", (F.col("slots") - F.col("done")).alias("slots"), "done").where("slots > 0")
    left = kept.agg(F.sum("back")).first()[0] or 0
    kept = kept.where("n > 0").drop("back")
    if not left:
        return kept
    prime = next(x for x in PRIMES if left % x)
    units = anew.select("shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("pos")).withColumn("pos", F.expr(f"pos * {prime}L % {left}L"))
    filled = _dealt(units, lack, left).groupBy("rank", "blocks", "done", "shard").agg(F.count("*").alias("n"))
    filled = exclusive_sum(filled, ["rank"], "shard", F.col("n"), "base")
    return kept.unionByName(filled.select("rank", "blocks", "shard", (F.col("done") + F.col("base")).alias("base"), "n"))


def block_uses(sources: DataFrame, blocks: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(rank, block, uses): how often the mix takes each of the ``blocks`` (rank, block) that it takes.

    Slot k of a source is number k mod blocks of epoch k div blocks. Each epoch of each source has a pseudorandom permutation of
    its own, the blocks' order by a hash, and a slot takes the block with its number. No block is used more than MOST times.
    """
    slots = written(shard_slots(sources, block, shard_blocks))
    numbers = slots.select("rank", "blocks", F.explode(F.expr("sequence(base, base + n - 1)")).alias("k"))
    numbers = numbers.select("rank", F.expr("k div blocks").alias("epoch"), (F.col("k") % F.col("blocks")).alias("place"))
    sizes = slots.groupBy("rank").agg(F.max("blocks").alias("blocks"), F.max(F.expr("(base + n - 1) div blocks")).alias("last"))
    ordered = blocks.join(sizes, "rank").select("rank", "block", "blocks", F.explode(F.expr("sequence(0L, last)")).alias("epoch"))
    mixed = F.xxhash64("rank", "epoch", "block", F.lit(SEED))
    ordered = written(ordered.select("rank", "epoch", "block", mixed.alias("h"), F.pmod(mixed, F.expr(f"blocks div {SORTED} + 1")).alias("part")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rank", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ordered.groupBy("rank", "epoch", "part").agg(F.count("*").alias("n")).select("rank", "epoch", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("rank", "epoch", "part").orderBy("h", "block")) - 1
    placed = ordered.withColumn("own", own).join(bases, ["rank", "epoch", "part"]).select("rank", "epoch", "block", (F.col("before") + F.col("own")).alias("place"))
    return numbers.join(placed.hint("merge"), ["rank", "epoch", "place"]).groupBy("rank", "block").agg(F.count("*").alias("uses"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, sources) of the mix.

    rows: doc_id, source, text_hash, size, rank and start (its words' offset in its source); pieces: rank, start,
    at, words and uses of each part of a document that lies in a block the mix takes. Words are
    runs of characters other than space and 0x09-0x0D; texts that are null or have none have size 0 and
    no piece. A null source is a source of its own, ordered last; repeated rows are rows of their own;
    null ids and extra columns do no harm; an empty table gives empty results.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    many = max(PARTS, docs.count() // SORTED)
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(many)).cast("int")))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sources = written(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size"))))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("source", "part", before.alias("base")).alias("b")
    own = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("own", own).alias("r")
    placed = placed.join(bases, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.part") == F.col("b.part")))
    placed = placed.select("r.doc_id", "r.source", "r.size", "r.text_hash", (F.col("base") + F.col("own")).alias("start")).alias("p")
    keyed = placed.join(sources.select("source", "rank").alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    rows = written(keyed.select("p.doc_id", "p.source", "p.text_hash", "p.size", "s.rank", "p.start"))
    cut = rows.where("size > 0").select("rank", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    at = F.greatest(F.col("start"), F.col("block") * block)
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - at
    cut = cut.select("rank", "block", "start", (at - F.col("start")).alias("at"), words.alias("words"))
    uses = block_uses(sources, cut.select("rank", "block").distinct(), block, shard_blocks)
    return rows, cut.join(uses.hint("merge"), ["rank", "block"]).select("rank", "start", "at", "words", "uses"), sources


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each of the documents."""
    rows, pieces, sources = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    found = rows.withColumn("place", F.when(F.col("size") > 0, F.col("start"))).alias("r").join(taken.hint("merge").alias("t"), (F.col("r.rank") == F.col("t.rank")) & (F.col("place") == F.col("t.start")), "left")
    found = found.select("doc_id", "r.rank", "size", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return found.join(sources.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents, with the columns of documents; n_chars is counted anew.

    Copy c of a document is its text less the pieces that the mix uses fewer than c times (the text
    itself if there are none), so all words used are there as often as the mix takes them. Documents
    without words, null texts too, take no part in a mix and go; an empty table gives none. Rows that repeat an id, a text
    and a source are mixed each, with the other columns of one of them.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they do not clash with those added
    text, key, source = (names[docs.columns.index(c)] for c in ("text", "doc_id", "source"))
    rows, pieces, _ = mix(docs)
    copies = pieces.groupBy("rank", "start").agg(F.array_sort(F.collect_list(F.struct("at", "words", "uses"))).alias("parts"))  # a document's own pieces
    kept = rows.where("size > 0").hint("merge").join(copies, ["rank", "start"]).select("doc_id", "source", "text_hash", "size", "parts")
    hashed = docs.toDF(*names).withColumn("hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([key, source, "hash"])
    joined = hashed.join(kept.hint("merge"), F.col(key).eqNullSafe(F.col("doc_id")) & F.col(source).eqNullSafe(F.col("source")) & (F.col("hash") == F.col("text_hash")))
    joined = joined.withColumn("copy", F.explode(F.expr("sequence(1L, array_max(transform(parts, x -> x.uses)))")))
    joined = joined.withColumn("used", F.expr("filter(parts, x -> x.uses >= copy)"))
    whole = F.expr("aggregate(used, 0L, (n, x) -> n + x.words)") == F.col("size")
    words = F.regexp_extract_all(F.col(text), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(0))
    left = F.when(whole, F.col(text)).otherwise(F.array_join(F.flatten(F.transform("used", lambda x: F.slice(words, (x["at"] + 1).cast("int"), x["words"].cast("int")))), ""))
    found = joined.select(*(left if c == text else F.col(c) for c in names)).toDF(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs))
