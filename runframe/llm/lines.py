"""Line deduplication by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, table, written
from .components import components

#: (least characters, edits): how many edits near lines are apart at most, by the length of the shorter one.
BANDS = ((24, 1), (400, 2))
#: Rows of a segment that are compared pair by pair; larger groups are split by further segments of what the segment leaves.
#: A row that is split makes some 40 rows in all rounds, and one of a group of n rows (n - 1) / 2 pairs: they cost the same near here.
HOT = 64
#: Characters in front of a coded line (as many as edits at most), and characters of a block that is compared at once.
PAD, STEP = 8, 32
#: So many ids of lines to be verified are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of every line that is not blank; line is trimmed of spaces."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line != ''")


def _shifts(i: int, d: int, edits: int) -> range:
    """Where segment i of a line shorter by d may stand in a probing line: at most i edits lie before it, and edits - i behind."""
    return range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)


def _probes(d: int, edits: int, own: bool) -> Column:
    """The places of the segments that a line takes part with: as one that is found (own, not shifted), or as one that probes.

    A place is one number of edits, d, i, shift and own, which ``_placed`` takes apart.
    """
    places = [(((edits * 16 + d) * 16 + i) * 32 + shift + 16) * 2 + int(own and shift == 0) for i in range(edits + 1) for shift in _shifts(i, d, edits)]
    return F.array(*(F.lit(x) for x in places))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with edits, d, i, shift and own in place of ``place``."""
    bits = lambda low, n: F.shiftright("place", low).bitwiseAND((1 << n) - 1)
    rest = [c for c in rows.columns if c != "place"]
    return rows.select(*rest, F.shiftright("place", 14).alias("edits"), bits(10, 4).alias("d"), bits(6, 4).alias("i"), (bits(1, 5) - 16).alias("shift"), (bits(0, 1) == 1).alias("own"))


def _segment(i) -> tuple[Column, Column]:
    """Start and size of segment i of a found line, if it has edits + 1 near equal ones, the longer ones last; ``rest`` is d longer."""
    parts, length = F.col("edits") + 1, F.length("rest") - F.col("d")
    base, more = F.floor(length / parts).cast("int"), length % parts
    return (base * i + F.greatest(F.lit(0), i - (parts - more))).cast("int"), (base + (i >= parts - more).cast("int")).cast("int")


def _cut(rows: DataFrame) -> DataFrame:
    """Adds start and size of the segment i, shifted, in ``rest``."""
    start, size = _segment(F.col("i"))
    return rows.withColumns({"start": start + F.col("shift"), "size": size}).where("start >= 0 and start + size <= length(rest)")


def _before(bands) -> Column:
    """Hashes of the segments before the segment i, where a found line's might be met with the same shift; else null."""
    found = []
    for j in range(max(edits for _, edits in bands)):
        start, size = _segment(F.lit(j))
        low, high = F.greatest(F.lit(-j), F.col("d") - F.col("edits") + j), F.least(F.lit(j), F.col("d") + F.col("edits") - j)
        here = (F.col("i") > j) & F.col("shift").between(low, high)
        found.append(F.when(here, F.xxhash64("key", F.substring(F.col("rest"), start + F.col("shift") + 1, size), F.lit(j))))
    return F.array(*found)


def signatures(lines: DataFrame, bands=BANDS) -> DataFrame:
    """(key, id, place): the segments of each line, and the substrings that probe other lines' segments.

    A line probes for lines of its own length and of up to ``edits`` less; the length of the shorter line says how many
    segments there are. The key has the segment, its place and that length.
    """
    lines = lines.select(F.col("line").alias("rest"), F.xxhash64("line").alias("id")).withColumn("length", F.length("rest")).where(F.col("length") >= bands[0][0])
    none = F.array().cast("array<int>")
    all_probes = []
    for (low, edits), (high, _) in zip(bands, [*bands[1:], (None, 0)], strict=True):
        for d in range(edits + 1):
            inside = F.col("length") - d >= low
            inside = inside if high is None else inside & (F.col("length") - d < high)
            all_probes.append(F.when(inside, _probes(d, edits, d == 0)).otherwise(none))
    rows = lines.select("rest", "id", F.explode(F.flatten(F.array(*all_probes))).alias("place"))
    rows = _cut(_placed(rows.withColumn("_place", F.col("place"))))
    key = F.xxhash64(F.substring(F.col("rest"), F.col("start") + 1, F.col("size")), F.length("rest") - F.col("d"), "edits", "i")
    return rows.select(key.alias("key"), "id", F.col("_place").alias("place"))


def _met(rows: DataFrame, marks: int = 0) -> DataFrame:
    """The rows of keys with a line that is found and another one, each once; (key, id, place) and what comes with them.

    Keys all of whose rows share one of the ``marks`` hashes of ``before`` go too: their pairs are all left to that segment.
    With marks, where no row comes twice, n counts the rows of the key.
    """
    dealt = rows.repartition("key")
    # Every column is read here too, so that both sides of the join are the same shuffle.
    more = [c for c in dealt.columns if c not in ("key", "id", "place")]
    told = F.lit(False)
    for one in (F.get("before", F.lit(i)) for i in range(marks)):
        told |= F.coalesce((F.min(one) == F.max(one)) & (F.count(one) == F.count("*")), F.lit(False))
    seen = dealt.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_top"), F.max(F.col("place") % 2).alias("_own"), told.alias("_told"), F.count("*").alias("n"), *(F.max(c).alias(f"_{c}") for c in more))
    shared = seen.where(" and ".join(["_low != _top and _own = 1 and not _told", *(f"_{c} is not null" for c in more)])).select("key", *(["n"] if marks else []))
    return _placed(written(dealt.join(shared, "key").distinct()))


def _split_hot(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of the keys of few rows, and the rows of the other keys.

    A pair that shares an earlier segment too is left to that segment's key.
    """
    if "n" not in met.columns:
        met = written(met.join(met.groupBy("key").agg(F.count("*").alias("n")), "key"))
    few = met.where(F.col("n") <= HOT).select("key", "id", "d", "own", *(["before"] if "before" in met.columns else [F.array().cast("array<bigint>").alias("before")]))
    found = few.where("own").select("key", F.col("id").alias("a"), F.col("before").alias("before_a"))
    meets = found.join(few, "key").where("a != id and (d > 0 or not own or a < id) and not coalesce(arrays_overlap(before, before_a), false)")
    return meets.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), met.where(F.col("n") > HOT)


def _narrowed(hot: DataFrame, bands) -> DataFrame:
    """The rows of ``hot`` (key, id, edits, d, own, before, rest) by the segments of their rests, with the shorter rests.

    Two lines within ``edits`` that share a segment have rests, the parts before and behind it, within
    ``edits`` too, so the rests share one of edits + 1 segments again.
    """
    options = None
    for edits, d, own in ((e, d, own) for e in sorted({e for _, e in bands}) for d in range(e + 1) for own in (True, False) if not (own and d)):
        here = (F.col("edits") == edits) & (F.col("d") == d) & (F.col("own") == own)
        options = F.when(here, _probes(d, edits, own)) if options is None else options.when(here, _probes(d, edits, own))
    rows = hot.select("key", "id", "rest", F.col("before").alias("_before"), F.explode(options).alias("place"))
    rows = _cut(_placed(rows.withColumn("_place", F.col("place"))))
    key = F.xxhash64("key", F.substring(F.col("rest"), F.col("start") + 1, F.col("size")), "i")
    return rows.select(key.alias("key"), "id", F.col("_place").alias("place"), F.concat("_before", _before(bands)).alias("before"), _rest().alias("rest"))


def _rest() -> Column:
    return F.concat(F.substring(F.col("rest"), F.lit(1), F.col("start")), F.substring(F.col("rest"), F.col("start") + F.col("size") + 1, F.length("rest")))


def _last_pairs(hot: DataFrame) -> DataFrame:
    """Candidates of rests so short (``edits`` characters at most, in lines that are found) that those of found lines are all near.

    Found lines meet the first of them; a probing line meets each, of which there are no more than short rests.
    """
    first = hot.where("own").groupBy("key").agg(F.min("id").alias("a"))
    star = hot.where("own").join(first, "key").select("a", F.col("id").alias("b"))
    across = hot.where("not own").select("key", F.col("id").alias("b")).join(hot.where("own").select("key", F.col("id").alias("a")), "key").select("a", "b")
    return star.unionByName(across).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def coded(text: Column) -> Column:
    """PAD characters that equal no other and the text, in four bytes each, so that a character is found by its place."""
    return F.concat(F.unhex(F.lit("FF" * 4 * PAD)), F.encode(text, "UTF-32"))


def _coded_length(code: Column) -> Column:
    return (F.octet_length(code) / 4).cast("int") - PAD


def _characters(code: Column, at: Column, n: int = 1) -> Column:
    return F.substring(code, (at + PAD) * 4 + 1, F.lit(4 * n))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the strings of the codes (columns, not expressions) are at most ``edits`` apart, their lengths too.

    A band of bits for each number of edits e: after j characters of b, bit d tells that the first j + d - edits of a can be
    turned into them by e edits. A character of b moves all diagonals of the band at once, by shifts of the
    bands, which share one long. Blocks that are equal at the beginning are passed over, and what stands
    behind the first STEP characters that differ is only read where the band still has a bit after them.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    size_a, size_b = _coded_length(a), _coded_length(b)
    blocks = F.sequence(F.lit(0), F.floor((F.least(size_a, size_b) - 1) / STEP).cast("int"))
    unequal = F.array_position(F.transform(blocks, lambda i: _characters(a, i * STEP, STEP) != _characters(b, i * STEP, STEP)), True)
    first = F.when(unequal > 0, (unequal - 1) * STEP).otherwise(F.element_at(blocks, -1) * STEP).cast("int")

    def move(bands: Column, mask: Column) -> Column:
        above, now, total = None, None, None
        for e in range(edits + 1):
            own = F.shiftright(bands, e * width).bitwiseAND(full)
            new = own.bitwiseAND(mask)
            if e:
                new = new.bitwiseOR(above).bitwiseOR(F.shiftright(above, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(full)
            above, now = own, new
            total = new if total is None else total.bitwiseOR(F.shiftleft(new, e * width))
        return total

    def moved(last: Column) -> Column:
        equal = lambda j: sum((F.when(_characters(a, j + (d - edits)) == _characters(b, j), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)), F.lit(0))
        start = sum((((1 << (e + 1)) - 1) << edits) << (e * width) for e in range(edits + 1))
        return F.aggregate(F.transform(F.sequence(first, last), lambda j: equal(j).cast("long")), F.lit(start).cast("long"), move)

    end = (size_a - size_b + edits + edits * width).cast("int")
    near = F.call_function("shiftright", moved(size_b - 1), end).bitwiseAND(F.lit(1).cast("long")) == 1
    alive = F.shiftright(moved(F.least(first + STEP, size_b) - 1), edits * width) != 0
    return (F.abs(size_a - size_b) <= edits) & alive & near


def near_lines(lines: DataFrame, bands=BANDS) -> DataFrame:
    """(a, b): links between hashes of distinct lines that are as near as ``bands`` says, and join all such lines.

    Near lines share one of edits + 1 segments with a probed substring. Keys of many rows are narrowed by
    segments of the rests until few rows share one, so candidates grow with the rows and not with the square of
    a segment's lines. A banded bit-parallel edit distance verifies the candidates. Rests at the
    end of that are joined in a star, all other pairs are given.
    """
    met = _met(signatures(lines, bands))
    pairs, hot = _split_hot(met)
    found = [written(pairs)]
    ids = written(met.select("id").distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = lines.where(F.length("line") >= bands[0][0]).select(F.xxhash64("line").alias("id"), "line")
    texts = written(own.join(wanted, "id").groupBy("id").agg(F.first("line").alias("line")).withColumn("code", coded(F.col("line"))))
    hot = written(_cut(hot.join(texts.select("id", F.col("line").alias("rest")), "id")).select("key", "id", "edits", "d", "own", _before(bands).alias("before"), _rest().alias("rest")))
    short = F.length("rest") - F.col("d") <= F.col("edits")
    marks = most = max(edits for _, edits in bands)
    while not hot.isEmpty():
        found.append(written(_last_pairs(hot.where(short))))
        marks += most
        met = _met(_narrowed(hot.where(~short), bands), marks)
        pairs, hot = _split_hot(met)
        found.append(written(pairs))
        hot = written(hot)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = written(pairs.distinct())
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("code").alias("code_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("code").alias("code_b")), "b")
    shorter = F.least(_coded_length(F.col("code_a")), _coded_length(F.col("code_b")))
    near = None
    for low, edits in reversed(bands):
        own = within(F.col("code_a"), F.col("code_b"), edits)
        near = F.when(shorter >= low, own) if near is None else near.when(shorter >= low, own)
    return written(both.where(near).select("a", "b"))


def dedup_lines(docs: DataFrame, bands=BANDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with text_col deduplicated, and n_lines and n_removed.

    Lines are parted by line feeds. Of a class of lines that are equal but for spaces at their ends, or
    are joined by steps of as many edits as ``bands`` allows, only the first by (id, hash of the text, place) stays.
    Blank lines always stay; a null text stays null and has no line; a document may be left empty; texts and lines may
    have any length. Rows that repeat an id and a text get the same result; null ids come first. An empty
    table gives none. Columns named n_lines or n_removed are replaced, others may have any name.
    """
    rest = docs.drop("n_lines", "n_removed")
    names = [f"_{i}" for i in range(len(rest.columns))]  # whatever the columns are called, they do not clash with those added
    kept = rest.toDF(*names)
    text, key = (names[rest.columns.index(c)] for c in (text_col, id_col))
    lines = _lines(kept, text, key)
    spot = F.struct("doc_id", "text_hash", "line_no")
    numbered = lines.select(F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit(8)).alias("check"), "doc_id", "text_hash", "line_no")
    first = numbered.groupBy("id", "check").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
    first = written(first)
    near = components(near_lines(lines, bands))
    joined = first.join(near, F.col("id") == F.col("node")).select("id", "check", "component", "first")
    heads = joined.groupBy("component").agg(F.min("first").alias("head"))
    joined = written(joined.join(heads, "component").select("id", "check", "head"))
    several = first.where("n > 1").join(joined.select("id", "check"), ["id", "check"], "left_anti").select("id", "check", F.col("first").alias("head"))
    classes = several.unionByName(joined)
    gone = numbered.join(classes, ["id", "check"]).where(~spot.eqNullSafe(F.col("head")))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))  # some lines of one text
    marked = kept.withColumn("hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    marked = marked.join(gone, marked[key].eqNullSafe(gone["doc_id"]) & (marked["hash"] == gone["text_hash"]), "left")
    split = F.split(text, "\n", -1)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"))
    left = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(split, i + 1)), "\n"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    columns = [left if c == text else F.col(c) for c in names]
    return marked.select(*columns, n_lines, n_removed).toDF(*rest.columns, "n_lines", "n_removed")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their lines deduplicated."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their lines deduplicated, with the columns of documents; n_chars is counted anew.

    Nulls, ties, repeated rows, long texts and empty tables as in ``dedup_lines``.
    """
    found = dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs))


_LEAST = " ".join(f"WHEN l >= {low} THEN {edits}" for low, edits in reversed(BANDS))
#: What op8_line_dedup returns, for DuckDB.
SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS raw, trim(parts[i], ' ') AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
kinds AS (SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS first FROM lines WHERE line != '' GROUP BY line),
long_kinds AS (SELECT line, length(line) AS l, CASE {_LEAST} END AS k, unnest(range(0, CASE {_LEAST} END + 1)) AS d FROM (SELECT line, length(line) AS l FROM kinds) WHERE l >= {BANDS[0][0]}),
near AS (
  SELECT a.line AS a, b.line AS b FROM long_kinds a JOIN (SELECT line, length(line) AS l FROM kinds) b
  ON b.l = a.l + a.d AND (a.d > 0 OR a.line < b.line) AND levenshtein(a.line, b.line) <= a.k),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
heads AS (SELECT r.a AS line, min(k.first) AS first FROM reach r JOIN kinds k ON r.b = k.line GROUP BY r.a),
firsts AS (SELECT k.line, coalesce(h.first, k.first) AS first FROM kinds k LEFT JOIN heads h ON k.line = h.line),
kept AS (
  SELECT l.doc_id, l.line_no, l.raw, l.line = '' OR (f.first.d = l.doc_id AND f.first.n = l.line_no) AS stays
  FROM lines l LEFT JOIN firsts f ON l.line = f.line),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (stays), '') AS text
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
