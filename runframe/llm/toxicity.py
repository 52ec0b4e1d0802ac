"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, table, written

#: Most labelled rows that training reads, in expectation (rows are taken by a hash of their id).
MAX_TRAIN_ROWS = 20_000
#: Most words of the learnt lexicon, and the least documents (also of a tree's leaf) and z-score of a word in it.
MAX_LEXICON, LEAST_DOCS, LEAST_Z = 2_000, 5, 5.0
#: Characters of the beginnings and of the ends of words that the lexicon may hold, most of them, and the least log-odds of one.
BEGINS, ENDS, MAX_PARTS, LEAST_ODDS = (3, 8), (3, 6), 2_000, 3.0
#: Different words whose parts a task remembers.
MEMO = 200_000
TREES, DEPTH, STEP = 30, 3, 0.2
#: Words on either side of a lexicon word in which a second-person word counts as near.
NEAR = 5

# Words of abuse known beforehand; training adds the words that the labels point to.
SEED_WORDS = ("awful", "dumb", "filth", "fool", "garbage", "hate", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
# Second-person words of the languages in the corpus.
SECOND_PERSON = ("du", "dein", "dich", "dir", "euch", "te", "ti", "toi", "tu", "tus", "usted", "vos", "votre", "vous", "you", "your", "you're", "youre", "yours")
# Signs put in place of letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

FEATURES = ("lex_rate", "lex_hits", "lex_kinds", "lex_weight", "near_rate", "near_any", "capitals", "all_caps", "exclaim", "punctuation", "odd_words", "odd_hits", "words", "part_rate", "part_hits", "part_kinds", "part_weight", "part_top")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_"
_ODD = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")


def parts(word: str) -> list[str]:
    """Beginnings and ends of a word, told apart from words and each other by a space where the word begins or ends."""
    n = len(word)
    return [" " + word[:k] for k in range(BEGINS[0], min(BEGINS[1], n) + 1)] + [word[-k:] + " " for k in range(ENDS[0], min(ENDS[1], n) + 1)]


def features(text: str | None, lexicon: dict[str, float], memo: dict[str, float] | None = None) -> list[float]:
    """Dense features of a whole text; null counts as empty, and an empty text has zeros. ``memo`` keeps the log-odds of words by their parts."""
    text, memo = text or "", {} if memo is None else memo
    words = text.lower().split()
    n = max(1, len(words))
    bare = [x.strip(_EDGE) for x in words]
    hits = [(i, w) for i, w in enumerate(bare) if w in lexicon]
    for w in set(bare).difference(memo):
        memo[w] = max((lexicon[x] for x in parts(w) if x in lexicon), default=0.0)
    formed = [w for w in bare if memo[w]]
    near = sum(1 for i, _ in hits if any(w.strip(_EDGE) in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]))
    odd = [m.group().lower() for m in _ODD.finditer(text)]
    hidden = sum(1 for w in odd if w.translate(LOOKALIKES) in lexicon)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    signs = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    weight = sum(lexicon[w] for _, w in hits)
    return [
        (len(hits) + hidden) / n, math.log1p(len(hits) + hidden), float(len({w for _, w in hits})), weight,
        near / n, float(near > 0), int(raw[65:91].sum()) / size, len(_CAPS.findall(text)) / n, int(raw[33]) / size, signs / size,
        len(odd) / n, float(hidden), math.log1p(len(words)),
        len(formed) / n, math.log1p(len(formed)), float(len(set(formed))), sum(memo[w] for w in formed), max((memo[w] for w in formed), default=0.0),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and a double column for each of FEATURES; the bounded lexicon is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = docs.select(*keep, F.col(text_col).alias("_text"))

    def make(batches):
        memo = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            rows = np.array([features(x, shared.value, memo) for x in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [*batch.schema.names[:-1], *FEATURES])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{x} double" for x in FEATURES]
    return map_batches(kept, make, ", ".join(schema))


def _parts(word: Column) -> Column:
    begins, ends = (F.sequence(F.lit(low), F.least(F.lit(high), F.length(word))) for low, high in (BEGINS, ENDS))
    return F.concat(F.transform(begins, lambda k: F.concat(F.lit(" "), F.left(word, k))), F.transform(ends, lambda k: F.concat(F.right(word, k), F.lit(" "))))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def learn_lexicon(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Words with their log-odds: the fixed ones, and those far more frequent in documents with label 1; likewise beginnings and ends of words (``parts``).

    The z-score is the root of the likelihood ratio of a word's table of documents, which holds for rare words and for those that no
    document with label 0 has. Document frequencies per class are summed by Spark; at most MAX_LEXICON words and MAX_PARTS parts come back.
    """
    clean = F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}@$*!']+", " ")
    words = F.filter(F.transform(F.split(clean, " "), lambda w: F.btrim(w, F.lit("$*!'"))), lambda w: F.length(w) >= 3)
    rows = labelled.select(F.col(label_col).cast("int").alias("y"), F.array_distinct(words).alias("ws"))
    words = rows.select("y", F.explode(F.array_distinct(F.concat("ws", F.flatten(F.transform("ws", _parts))))).alias("w"))
    sizes = {r["y"]: r["n"] for r in labelled.groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (ones - a + 0.5)) - F.log((b + 0.5) / (zeros - b + 0.5))
    cells = sum(map(_x_log_x, (a, b, ones - a, zeros - b)), _x_log_x(F.lit(ones + zeros)))
    ratio = cells - sum(map(_x_log_x, (a + b, ones + zeros - a - b, F.lit(ones))), _x_log_x(F.lit(zeros)))
    z = F.signum(odds) * F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))
    best = written(words.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(a >= LEAST_DOCS).withColumns({"odds": odds, "z": z}).where(F.col("z") >= LEAST_Z))  # read twice
    part = F.col("w").contains(" ")
    found = [r for kept, most in ((~part, MAX_LEXICON), (part & (F.col("odds") >= LEAST_ODDS), MAX_PARTS)) for r in best.where(kept).orderBy(F.desc("z"), "w").limit(most).collect()]
    return {w: 2.0 for w in SEED_WORDS} | {r["w"]: float(r["odds"]) for r in found}


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS):
    """(lexicon, tree pipeline, isotonic model); a fifth of the rows, by a hash of the id, calibrates and teaches nothing else.

    Rows with a null label are left out. Without both labels in both parts the models are None, and
    the second item is the share of label 1 (0 where there is no row).
    """
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1_000_000)) < F.lit(max_rows * 1_000_000 // total))
    aside = F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(5)) == 0
    part = aside.alias("_aside")
    lexicon = learn_lexicon(rows.where(~aside), "_text", "_label")
    data = written(with_features(rows, lexicon, "_text", keep=("_label", part)))
    sizes = {(r["_aside"], r["_label"]): r["n"] for r in data.groupBy("_aside", "_label").agg(F.count("*").alias("n")).collect()}
    ones, seen = sum(n for (_, y), n in sizes.items() if y == 1), sum(sizes.values())
    if len(sizes) < 4:
        return lexicon, ones / seen if seen else 0.0, None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_tree", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_DOCS, stepSize=STEP, seed=7, checkpointInterval=-1).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model = PipelineModel([assembler, trees.fit(assembler.transform(data.where("not _aside")))])
    raised = _raised(model.transform(data.where("_aside"))).select("_p", F.col("_label").cast("double").alias("_label"))
    return lexicon, model, IsotonicRegression(featuresCol="_p", labelCol="_label", predictionCol="_score").fit(raised)


def _raised(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", vector_to_array("_probability")[1])


def score(docs: DataFrame, lexicon, model, isotonic, text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted for every whole text, null and empty ones too.

    Repeated rows are scored each; extra columns go. A model of None gives the share it came with.
    """
    if isotonic is None:
        return docs.select(*keep, F.lit(float(model)).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"))
    dense = with_features(docs, lexicon, text_col, keep)
    names = [c for c in dense.columns if c not in FEATURES]
    found = isotonic.transform(_raised(model.transform(dense)))
    # the steps of the isotonic fit tie many rows; the tree's probability keeps their order within a step
    fine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("_score") + 0.02 * F.col("_p")))
    return found.select(*names, fine.alias("score"), (fine >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels of the four fifths not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    marks = labels.where(fold("doc_id", 5) != 0).select("doc_id", "toxic").dropna().dropDuplicates(["doc_id"])
    return score(docs, *train(training_texts(docs, marks)), keep=("doc_id", held.alias("held_out")))


def training_texts(docs: DataFrame, marks: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Texts of a bounded hash sample of the labelled rows: the ids are sampled first, so few texts are shuffled."""
    total = marks.count()
    if total > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("texts")), F.lit(1_000_000)) < F.lit(max_rows * 1_000_000 // total))
    return written(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))  # at most about max_rows ids
