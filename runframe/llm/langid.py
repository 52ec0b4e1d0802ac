"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, table

#: Hash buckets of the n-gram space (a power of two), and the n-gram lengths.
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Most labelled rows that training reads, in expectation (rows are taken by a hash of their id).
MAX_TRAIN_ROWS = 20_000
#: Most languages a model holds: languages x 2**BUCKET_BITS floats are broadcast (64 MB at most).
MAX_LANGS = 512
#: Characters scored at once.
SLICE = 1_000_000
SMOOTH = 0.5
#: Least score of a document that the pipeline keeps.
MIN_SCORE = 0.15
#: How sharply the mean log-probabilities of an n-gram part languages, and how far (in nats) a text's may lie from what is usual.
SHARP, SLACK = 4.0, 1.0
UND = "und"

_SPACE = 32
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_SALT = {1: np.uint32(0x9E3779B9), 2: np.uint32(0x85EBCA6B), 3: np.uint32(0xC2B2AE35)}
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> itself for a letter, else a space; built once per worker from the rule str.isalpha."""
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else _SPACE for i in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(texts: list[str | None]):
    """Runs of (row, piece) of about SLICE characters in all; a piece has the two characters before it in front (spaces at a text's start)."""
    run, size = [], 0
    for row, text in enumerate(texts):
        text = "  " + text.lower() if text else ""
        for at in range(2, len(text), SLICE):
            piece = text[at - 2 : at + SLICE]
            if run and size + len(piece) > SLICE:
                yield run
                run, size = [], 0
            run.append((row, piece))
            size += len(piece)
    if run:
        yield run


def _hashed(run: list[tuple[int, str]], bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts of the pieces, a bucket per position for each order, and which pieces have a letter.

    The first two positions of every piece stand before it; their n-grams get the bucket 2**bits, which scores 0.
    """
    codes = _letter_table()[_code_points("".join(piece for _, piece in run))]
    lengths = np.fromiter((len(piece) for _, piece in run), np.int64, len(run))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    letters = np.add.reduceat((codes != _SPACE).astype(np.int32), starts) > 0  # of two pieces of a text, one has them
    mixed = codes * _MIX[0]
    buckets = []
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            mixed[order - 1 :] += (codes * _MIX[order - 1])[: len(codes) - order + 1]
        if order in ORDERS:
            x = (mixed ^ (mixed >> np.uint32(15)) ^ _SALT[order]) * _MIX[1]
            bucket = (x >> np.uint32(32 - bits)).astype(np.int32)
            bucket[starts] = bucket[starts + 1] = 1 << bits
            buckets.append(bucket)
    return starts, buckets, letters


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", bits: int = BUCKET_BITS, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix of languages x (2**bits + 1)).

    Rows with a null text or language are left out. Tasks add up n-gram counts per language, Spark
    sums them per (language, bucket), and only that bounded matrix comes to the driver. With more than
    MAX_LANGS languages a ValueError is raised; with no labelled row the list is empty.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_lang is not null and _text is not null")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1_000_000)) < F.lit(max_rows * 1_000_000 // total))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()
            for lang in set(langs):
                own = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                for run in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for bucket in _hashed(run, bits)[1]:
                        own += np.bincount(bucket, minlength=len(own))
        for lang, own in sums.items():
            at = np.flatnonzero(own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    counts = map_batches(rows.select("_lang", "_text"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; at most {MAX_LANGS}")
    matrix = np.full((len(langs), 1 << bits), SMOOTH)
    place = {lang: i for i, lang in enumerate(langs)}
    if langs:
        matrix[np.array([place[x] for x in found.column("lang").to_pylist()]), found.column("bucket").to_numpy()] += found.column("n").to_numpy()
        matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return langs, np.hstack([matrix, np.zeros((len(langs), 1))]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus lang_pred and score for every whole text.

    The score is the best language's share of the probabilities of a mean n-gram, to the power SHARP, times
    exp(SLACK - e) where that n-gram is e > SLACK nats less probable than the language's own are in the mean; so neither a
    text between languages nor one of unknown n-grams scores high, however long it is.
    lang_pred is ``und`` and score 0 for a null text, a text with no letter (the empty one too), or a
    model without languages. Ties go to the first language in code point order. Rows are never merged:
    repeated rows give repeated results, and extra columns are dropped.
    """
    bits = int(np.log2(matrix.shape[1] - 1)) if langs else BUCKET_BITS
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kept = docs.select(*keep, F.col(text_col).alias("_text"))

    def score(batches):
        weights = shared.value
        usual = (np.exp(weights[:, :-1]) * weights[:, :-1]).sum(axis=1) if langs else np.zeros(0)  # a mean n-gram's log-probability in its own language
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            sums, seen, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool), np.zeros(len(texts))
            for run in _slices(texts) if langs else ():
                starts, buckets, letters = _hashed(run, bits)
                rows = np.fromiter((row for row, _ in run), np.int64, len(run))
                np.logical_or.at(seen, rows, letters)
                np.add.at(grams, rows, np.diff(np.append(starts, len(buckets[0]))) - 2)
                for bucket in buckets:
                    for k in range(len(langs)):
                        np.add.at(sums[:, k], rows, np.add.reduceat(weights[k][bucket], starts, dtype=np.float64))
            best = sums.argmax(axis=1) if langs else np.zeros(len(texts), int)
            values = np.zeros(len(texts))
            if langs:
                mean = sums / np.maximum(grams, 1)[:, None] / len(ORDERS)
                top = mean.max(axis=1)
                values = 1 / np.exp(SHARP * (mean - top[:, None])).sum(axis=1) * np.exp(-np.maximum(0, usual[best] - top - SLACK))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([langs[b] if s else UND for b, s in zip(best, seen, strict=True)], pa.string()), pa.array(np.where(seen, values, 0.0), pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, score, f"{schema}, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents; learnt from the text and language of the three quarters not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    langs, matrix = train(docs.where(~held))
    return predict(docs, langs, matrix, keep=("doc_id", held.alias("held_out")))


def reject(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is recognised, with the columns of documents.

    A text without a letter and one whose best language stays below MIN_SCORE are rejected. A text
    column of null gives ``und`` and goes too. Repeated rows are each kept or each rejected.
    """
    langs, matrix = train(docs)
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they do not clash with those added
    plain = docs.toDF(*names).withColumn("_copy", F.col(names[docs.columns.index("text")]))
    found = predict(plain, langs, matrix, text_col="_copy", keep=tuple(names))
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= MIN_SCORE)).select(*names).toDF(*docs.columns)
