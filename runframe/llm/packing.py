"""Packing: minimum bin slack over a multiset of lengths, by bitset subset sums."""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, table, written

WINDOW = 1024
#: The vocabulary as ranks, for the faster library, and as the tokenizer whose ids are asked for.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
END = 0
#: Rows that one window numbers.
PART_ROWS = 20_000


def encoder(ranks: str | None = None, tokenizer: str | None = None):
    """text -> uint32 ids of ``tokenizer`` without those that it adds itself.

    The ranks hold the same vocabulary and are several times faster. Texts that hold the string of one of the tokenizer's
    special tokens, and those that defeat the ranks' pattern (it backtracks over very long runs of spaces),
    go to the tokenizer, which is read when the first of them comes.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as file:
        special = [token["content"] for token in json.load(file)["added_tokens"]]
    with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    whole: list = []

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except (ValueError, UnicodeError, RuntimeError):
                pass
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``keep``, start, length, ids_crc32, doc_tokens (and ids) of each piece of each document.

    A document is the ids of its whole text (null: empty) and the id 0, cut at multiples of ``window``.
    """
    kept = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def cut(batches):
        encode = encoder()
        for batch in batches:
            row, start, length, crc, whole, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = np.append(encode(text), np.uint32(END)).astype("<u4")
                for at in range(0, len(own), window):
                    part = own[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    whole.append(len(own))
                    if with_ids:
                        ids.append(part)
            taken = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            more = [pa.array(x, pa.int64()) for x in (start, length, crc, whole)] + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays([*taken, *more], [*batch.schema.names[:-1], "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return map_batches(kept, cut, ", ".join(schema) + ", start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset with the largest length whose sum is nearest to ``capacity``.

    Bit s of ``reach`` says that a sum s can be made; lengths are added by descending size, their counts
    in binary steps, until the capacity is met. Going back over the steps gives the counts.
    """
    first = max(counts)
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            take = min(step, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            step *= 2
    total, chosen = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go, by rank.

    The fullest multiset is used as often as the counts allow, so each round uses up a length or nearly
    so: the work depends on the capacity alone, however many pieces there are.
    """
    counts, used, out, sequence = {k: v for k, v in histogram.items() if v > 0}, {}, [], 0
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[length] // n for length, n in chosen)
        offset = 0
        for length, n in chosen:
            for _ in range(n):
                low = used.get(length, 0)
                out.append((length, low, low + times, sequence, offset))
                used[length] = low + times
                offset += length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return out


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` with sequence_id and offset for each row: sequences of at most ``window``, without gaps.

    ``cut`` needs doc_id, start and length (1 to ``window``) and must be a written table. Only the
    histogram of lengths (``window`` counts) comes to the driver. Within a length, rows are ranked in
    parts by a hash of their id, so a length that many share is not one task's. Repeated rows are packed
    each, those with one id and start in the order of ids_crc32; an empty table gives none.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = F.lit(max(1, -(-max(histogram.values(), default=0) // PART_ROWS)))
    rows = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", F.lit("part")), parts))
    sizes = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start", *(["ids_crc32"] if "ids_crc32" in cut.columns else []))) - 1
    ranked = rows.join(sizes.select("length", "_part", before.alias("_before")), ["length", "_part"]).withColumn("_rank", F.col("_before") + own)
    places = cut.sparkSession.createDataFrame(plan(histogram, window), "_length long, _low long, _high long, _sequence long, offset long")
    here = (ranked["length"] == places["_length"]) & (ranked["_rank"] >= places["_low"]) & (ranked["_rank"] < places["_high"])
    return ranked.join(F.broadcast(places), here).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_low")).select(*cut.columns, "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with their sequences; null texts count as empty, extra columns go."""
    return pack(written(pieces(docs)))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    return pack_documents(docs)
