"""One query for each operator, over inputs derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import alphabets, scalars
from ..model import KEY, UNSPLIT, BALANCED, SplitParams
from ..operators import movetable, navigate, phi, powers, recover, rlbwt, runs, search, split, whole
from ..scratch import shared_dir, written
from ..sources import files, store
from . import inputs

MOVE = [KEY, "interval", "start", "length", "image", "pointer", "off"]
#: Steps of the k-step queries, longest interval and capping factor of the splitting queries.
STEPS, LONGEST, FACTOR = 37, 16, 1.0
LF_STEPS = 5
#: How often texts are repeated to have few runs.
REPEATS = 30
#: Positions a run to which their domain is contracted.
FEW = 8


def _d1(spark, d):
    return inputs.orders_permutation(spark, d)


def _d1_move(spark, d, perm=None):
    return written(movetable.move_table(runs.decompose(perm or _d1(spark, d)), UNSPLIT))


def _d4(spark, d):
    """Interval rows of LF over the long runs."""
    return rlbwt.lf_runs(inputs.block_runs(spark, d)).drop("head_rank", "image_rank")


def _d5(spark, d):
    return inputs.with_users(inputs.event_runs(spark, d), spark, d, inputs.event_symbols(spark, d))


def _d5_move(spark, d):
    return written(rlbwt.lf_move(_d5(spark, d)))


def _heads(move):
    """A cursor at the first position of every interval."""
    return move.select(KEY, "interval", F.lit(0).cast("long").alias("off"))


def _bwt(spark, d):
    return written(recover.suffix_sort(inputs.part_names(spark, d)))


def q_runs(spark, d):
    return runs.decompose(_d1(spark, d))


def q_sum_and_max(spark, d):
    return runs.domain_and_longest(runs.decompose(_d1(spark, d)))


def q_inverse(spark, d):
    return runs.inverse(_d1(spark, d))


def q_is_permutation(spark, d):
    return runs.is_permutation(_d1(spark, d))


def q_starts_lengths(spark, d):
    own = runs.lengths_to_starts(inputs.event_runs(spark, d).withColumnRenamed("run", "interval")).select(KEY, "interval", "start")
    domain = inputs.event_symbols(spark, d).groupBy(KEY).agg(F.count("*").alias("domain"))
    return runs.starts_to_lengths(own, domain)


def q_image_rank(spark, d):
    return runs.with_image_rank(runs.decompose(_d1(spark, d))).select(KEY, "interval", "image_rank")


def q_image_rank_inverse(spark, d):
    ranked = runs.with_image_rank(runs.decompose(_d1(spark, d)))
    visits = ranked.select(KEY, F.col("image_rank").alias("rank"), "interval")
    return runs.ranks_from_inverse(visits).select(KEY, F.col("image_rank").alias("rank"), F.col("interval").alias("visited"))


def q_encodings(spark, d):
    """The encoding rebuilt from lengths and ranks alone, where images are tiled anew."""
    own = runs.with_image_rank(runs.decompose(_d1(spark, d)))
    return runs.encode(own.select(KEY, "interval", "length", "image_rank"))


def q_move_table(spark, d):
    return _d1_move(spark, d).select(*MOVE)


def q_widths(spark, d):
    return movetable.widths(_d5_move(spark, d))


def q_bits_needed(spark, d):
    return movetable.table_bits(_d5_move(spark, d))


def q_stats(spark, d):
    rows = _d4(spark, d)
    return movetable.stats(rows, movetable.move_table(rows, SplitParams(FACTOR, None)))


def q_violations(spark, d):
    """How many rows of the table break its invariants."""
    return movetable.violations(_d1_move(spark, d)).agg(F.count("*").alias("broken"))


def q_violations_broken(spark, d):
    """How many rows of a table with wrong offsets break its invariants."""
    wrong = _d1_move(spark, d).withColumn("off", F.when(F.col("interval") % 7 == 3, F.col("off") + 1).otherwise(F.col("off")))
    return movetable.violations(wrong).agg(F.count("*").alias("broken"))


def q_violations_null(spark, d):
    """How many rows of a table with null pointers in some rows, and null ids in others, break its invariants."""
    wrong = _d1_move(spark, d).withColumns({"pointer": F.expr("if(interval % 5 = 2, null, pointer)"), "off": F.expr("if(interval % 5 = 3, null, off)")})
    return movetable.violations(wrong).agg(F.count("*").alias("broken"))


def q_split_default(spark, d):
    """A table split as by default."""
    return movetable.move_table(_d4(spark, d).drop("ch")).select(*MOVE)


def q_split_cap(spark, d):
    return split.cap_by_mean(_d4(spark, d).drop("ch"), FACTOR).select(KEY, "interval", "start", "length", "image")


def q_split_max(spark, d):
    return split.cut_longer(_d4(spark, d).drop("ch"), LONGEST).select(KEY, "interval", "start", "length", "image")


def q_split_balancing(spark, d):
    return split.split_runs(_d4(spark, d), BALANCED).select(KEY, "interval", "start", "length", "image")


def q_split_move(spark, d):
    return movetable.move_table(_d4(spark, d), SplitParams(FACTOR, None)).select(*MOVE, "ch")


def q_split_payload(spark, d):
    rows = inputs.with_users(inputs.block_runs(spark, d), spark, d, inputs.event_blocks(spark, d))
    return split.cut_longer(rlbwt.lf_runs(rows).drop("head_rank", "image_rank"), LONGEST).select(KEY, "interval", "start", "length", "ch", "val1", "val2")


def q_split_callback(spark, d):
    fresh = lambda run, whole, at, size: {"origin": run, "part": at * 1000 + size, "rest": whole - at - size}
    return split.cut_longer(_d4(spark, d).drop("ch"), LONGEST, fresh).select(KEY, "interval", "start", "length", "origin", "part", "rest")


def q_split_callback_python(spark, d):
    """The same payload from a function of Arrow arrays."""

    def fresh(run, whole, at, size):
        import pyarrow.compute as pc

        return [run, pc.add(pc.multiply(at, 1000), size), pc.subtract(pc.subtract(whole, at), size)]

    given = split.Vectorised(fresh, "origin long, part long, rest long")
    return split.cut_longer(_d4(spark, d).drop("ch"), LONGEST, given).select(KEY, "interval", "start", "length", "origin", "part", "rest")


def q_split_same(spark, d):
    """Positions whose image a split table gives, which is the permutation of the unsplit one."""
    return runs.expand(split.cut_longer(_d4(spark, d), LONGEST))


def q_next(spark, d):
    perm = _d1(spark, d)
    move = _d1_move(spark, d, perm)
    cursors = navigate.locate(perm.select(KEY, "i", F.col("i").alias("idx")), move)
    return navigate.step(cursors, move).select("i", F.col("idx").alias("next_i"), "interval", "off")


def q_same_position(spark, d):
    """Whether the first position of each interval stays where it is in one step."""
    move = _d1_move(spark, d)
    there = navigate.step(_heads(move).withColumn("from", F.col("interval")), move)
    own = F.struct(F.col("from").alias("interval"), F.lit(0).cast("long").alias("off"))
    return there.select("from", navigate.same_position(F.struct("interval", "off"), own).alias("same"))


def q_next_k(spark, d):
    move = _d1_move(spark, d)
    return navigate.step_k(_heads(move).withColumn("from", F.col("interval")), move, STEPS).select("from", F.col("idx").alias("to"))


def q_power_table(spark, d):
    """The interval table of the permutation applied several times."""
    return powers.power(written(runs.decompose(_d1(spark, d))), LF_STEPS)


def q_power(spark, d):
    return powers.permutation_power(_d1(spark, d), LF_STEPS)


def q_up(spark, d):
    move = _d1_move(spark, d)
    return navigate.up(_heads(move).withColumn("from", F.col("interval")), move).select("from", "interval", "off")


def q_down(spark, d):
    move = _d1_move(spark, d)
    return navigate.down(_heads(move).withColumn("from", F.col("interval")), move).select("from", "interval", "off")


def q_first_last(spark, d):
    move = _d1_move(spark, d)
    return navigate.first(move).withColumn("which", F.lit("first")).unionByName(navigate.last(move).withColumn("which", F.lit("last")))


def q_position(spark, d):
    move = rlbwt.lf_move(inputs.event_runs(spark, d), UNSPLIT)
    points = inputs.event_symbols(spark, d).select(KEY, F.col("i").alias("idx"))
    return navigate.locate(points, move, strategy="scan").select("idx", "interval", "off")


def q_position_search(spark, d):
    """The same by binary search in the starts."""
    move = rlbwt.lf_move(inputs.event_runs(spark, d), UNSPLIT)
    points = inputs.event_symbols(spark, d).select(KEY, F.col("i").alias("idx"))
    return navigate.locate(points, written(move), strategy="search").select("idx", "interval", "off")


def q_position_idx(spark, d):
    move = rlbwt.lf_move(inputs.event_runs(spark, d), UNSPLIT)
    return navigate.with_idx(move.select(KEY, "interval", (F.col("length") - 1).alias("off")), move).select("interval", "idx")


def q_intervals(spark, d):
    """Intervals with their payload, start and symbol."""
    return _d5_move(spark, d).select("interval", "start", "length", "ch", "val1", "val2")


def _search(spark, d, find, column, value):
    move = _d5_move(spark, d)
    cursors = move.select(KEY, "interval", F.lit(0).cast("long").alias("off"), value.alias("value"))
    return find(cursors, move, column).select("interval", "found_interval", "found_off")


def q_pred(spark, d):
    return _search(spark, d, search.pred, "val1", F.col("val2"))


def q_succ(spark, d):
    return _search(spark, d, search.succ, "val1", F.col("val2"))


def q_pred_char(spark, d):
    return _search(spark, d, search.pred, "ch", F.lit("click"))


def q_succ_char(spark, d):
    return _search(spark, d, search.succ, "ch", F.lit("click"))


def _search_split(spark, d, find):
    """Search in a table whose intervals are split, with the absolute place of what is found."""
    rows = inputs.with_users(inputs.block_runs(spark, d), spark, d, inputs.event_blocks(spark, d))
    move = written(split.cut_longer(rlbwt.lf_runs(rows).drop("head_rank", "image_rank"), LONGEST))
    cursors = move.select(KEY, "interval", F.lit(0).cast("long").alias("off"), F.lit("click").alias("value"), F.col("interval").alias("from"))
    found = find(cursors, move, "ch").select(KEY, "from", F.col("found_interval").alias("interval"), F.col("found_off").alias("off"))
    placed = navigate.with_idx(found.where("interval is not null"), move)
    return placed.select("from", F.col("interval").alias("found_interval"), "off", "idx")


def q_pred_split(spark, d):
    return _search_split(spark, d, search.pred)


def q_succ_split(spark, d):
    return _search_split(spark, d, search.succ)


def q_alphabet(spark, d):
    return alphabets.alphabet(inputs.event_symbols(spark, d))


def q_map(spark, d):
    events = inputs.event_symbols(spark, d)
    codes = alphabets.alphabet(events)
    coded = alphabets.map_sequence(events, codes).select(KEY, "i", "code")
    return alphabets.unmap_sequence(coded, codes).select("i", "code", "ch")


def _bases(spark, d):
    letter = F.element_at(F.array(*map(F.lit, "acGTN")), (F.length("ch") % 5 + 1).cast("int"))
    return inputs.event_symbols(spark, d).select(KEY, "i", letter.alias("ch"))


def q_complement(spark, d):
    found = alphabets.check_nucleotides(_bases(spark, d)).withColumn("code", scalars.nucleotide_code(F.col("ch")))
    return found.select("i", "code", scalars.nucleotide_symbol(F.col("code")).alias("base"), scalars.complement(F.col("ch")).alias("complement"))


def q_bit_functions(spark, d):
    v = F.col("o_orderkey").cast("long")
    w = scalars.bit_width(v)
    return spark.read.parquet(f"{d}/orders.parquet").select(
        v.alias("v"), w.alias("width"), scalars.div_up(v, F.lit(7)).alias("sevenths"), scalars.pow2(w).alias("power"), scalars.all_ones(w).alias("top"),
        scalars.mask(w, F.lit(3)).alias("mask"), scalars.bytes_to_bits(v).alias("bits"), scalars.bits_to_bytes(v).alias("bytes"),
    )


def q_rle(spark, d):
    return inputs.event_runs(spark, d)


def q_char_counts(spark, d):
    return rlbwt.char_counts(inputs.event_runs(spark, d))


def q_lf_images(spark, d):
    return rlbwt.lf_runs(inputs.event_runs(spark, d)).select(KEY, "interval", "ch", "start", "length", "image", "image_rank", "head_rank")


def q_lf(spark, d):
    return rlbwt.lf(inputs.event_symbols(spark, d))


def q_lf_move(spark, d):
    return rlbwt.lf_move(inputs.event_runs(spark, d), UNSPLIT, codes=True).select(*MOVE, "ch", "code")


def q_lf_k(spark, d):
    return powers.permutation_power(rlbwt.lf(inputs.event_symbols(spark, d)).drop("ch"), LF_STEPS)


def q_fl_runs(spark, d):
    return rlbwt.fl_runs(inputs.event_runs(spark, d)).select(KEY, "interval", "ch", "start", "length", "image", "image_rank")


def q_fl(spark, d):
    return rlbwt.fl(inputs.event_symbols(spark, d))


def q_fl_move(spark, d):
    return rlbwt.fl_move(inputs.event_runs(spark, d), UNSPLIT).select(*MOVE, "ch")


def q_bwt(spark, d, bwt=_bwt):
    return bwt(spark, d)


def q_suffix_array(spark, d, texts=inputs.benchmark_texts):
    """By prefix doubling, over whole texts."""
    return recover.suffix_array(texts(spark, d))


def q_bwt_long(spark, d, texts=inputs.benchmark_texts):
    rows = texts(spark, d)
    return recover.bwt_of(rows, recover.suffix_array(rows))


def q_phi(spark, d, bwt=_bwt):
    return phi.phi_runs(bwt(spark, d))


def q_phi_inv(spark, d, bwt=_bwt):
    return phi.phi_inv_runs(bwt(spark, d))


def q_phi_rank(spark, d, bwt=_bwt):
    return runs.with_image_rank(phi.phi_runs(bwt(spark, d))).select(KEY, "interval", "length", "image_rank")


def q_phi_inv_rank(spark, d, bwt=_bwt):
    return runs.with_image_rank(phi.phi_inv_runs(bwt(spark, d))).select(KEY, "interval", "length", "image_rank")


def q_phi_move(spark, d, bwt=_bwt):
    """The move table of φ from the runs of the BWT alone."""
    rle = rlbwt.run_length_encode(bwt(spark, d).select(KEY, "i", "ch"))
    return phi.phi_move(rle, UNSPLIT).select(*MOVE)


def q_phi_inv_move(spark, d, bwt=_bwt):
    rle = rlbwt.run_length_encode(bwt(spark, d).select(KEY, "i", "ch"))
    return phi.phi_inv_move(rle, UNSPLIT).select(*MOVE)


def _over_repeats(spark, d, make, by_runs):
    """``make`` of part names repeated, whose BWTs have far fewer runs than symbols; where one is too long to be held whole, ``by_runs``."""
    texts = whole.dealt(inputs.part_names(spark, d), REPEATS).select(KEY, F.repeat("text", F.lit(REPEATS)).alias("text"))
    coded = lambda long: written(rlbwt.run_length_encode(recover.bwt_of(long, recover.suffix_array(long))))
    return whole.by_length(texts, lambda short: whole.over_texts(short, make, "move"), lambda long: by_runs(coded(long), UNSPLIT, FEW).select(*MOVE))


def q_phi_move_repeats(spark, d):
    """Over repeated part names; LF's domain is contracted before it is ranked where it does not fit a task."""
    return _over_repeats(spark, d, whole.phi_moves(-1), phi.phi_move)


def q_phi_inv_move_repeats(spark, d):
    return _over_repeats(spark, d, whole.phi_moves(1), phi.phi_inv_move)


def q_phi_next(spark, d, bwt=_bwt):
    """One step of φ from the first position of every interval of its table."""
    move = written(phi.phi_move(rlbwt.run_length_encode(bwt(spark, d).select(KEY, "i", "ch")), UNSPLIT))
    return navigate.step(_heads(move).withColumn("from", F.col("interval")), move).select(KEY, "from", "interval", "off", "idx")


def q_text_lf(spark, d, bwt=_bwt):
    return recover.text_by_lf(bwt(spark, d).select(KEY, "i", "ch"))


def q_text_fl(spark, d, bwt=_bwt):
    return recover.text_by_fl(bwt(spark, d).select(KEY, "i", "ch"))


def q_chunks_lf(spark, d, bwt=_bwt):
    """Texts in numbered chunks of 5 symbols."""
    return recover.chunks_by_lf(bwt(spark, d).select(KEY, "i", "ch"), 5)


def q_chunks_fl(spark, d, bwt=_bwt):
    return recover.chunks_by_fl(bwt(spark, d).select(KEY, "i", "ch"), 5)


def q_sa_phi(spark, d, bwt=_bwt):
    return recover.suffix_array_by_phi(runs.expand(phi.phi_runs(bwt(spark, d))))


def q_sa_phi_inv(spark, d, bwt=_bwt):
    return recover.suffix_array_by_phi_inv(runs.expand(phi.phi_inv_runs(bwt(spark, d))))


def q_cycle_order(spark, d, bwt=_bwt):
    """Positions of each text's BWT in the order in which LF meets them."""
    return navigate.cycle_order(rlbwt.lf(bwt(spark, d)).drop("ch"))


def _names(spark, d):
    return whole.dealt(inputs.part_names(spark, d))


def _over_letters(spark, d, make, kind, by_rows):
    """``make`` of where each letter of a part's name goes when they are sorted, of several cycles mostly; ``by_rows`` of long names."""

    def long(texts):
        sizes = texts.select(KEY, F.length("text").alias("_end"))
        letters = recover.symbols_of(texts).join(sizes, KEY).where("sa < _end").select(KEY, F.col("sa").alias("i"), "ch")
        return by_rows(written(rlbwt.lf(letters).drop("ch")))

    return whole.by_length(_names(spark, d), lambda short: whole.over_texts(short, whole.sorting(make), kind, mark=""), long)


def q_cycle_order_any(spark, d):
    return _over_letters(spark, d, whole.cycle_rows, "order", navigate.cycle_order)


def q_single_cycle_any(spark, d):
    return _over_letters(spark, d, whole.single_rows, "single", navigate.is_single_cycle)


def q_single_cycle(spark, d, bwt=_bwt):
    return navigate.is_single_cycle(rlbwt.lf(bwt(spark, d)).drop("ch"))


def q_store_roundtrip(spark, d):
    path = store.save(_d1_move(spark, d), f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", UNSPLIT)
    return store.load(spark, path)[0].select(*MOVE)


def q_store_about(spark, d):
    """What is stored about a split table."""
    rows = _d4(spark, d)
    path = store.save(movetable.move_table(rows, SplitParams(FACTOR, None)), f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", SplitParams(FACTOR, None), rows)
    return store.about(spark, path).select("rows", "runs", "domain", "length_capping", "balancing")


def q_store_points(spark, d):
    """The rows of a stored table at every 97th interval, from the files that hold them."""
    path = store.save(_d1_move(spark, d), f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", UNSPLIT, file_rows=1000)
    cursors = _d1_move(spark, d).where("interval % 97 = 0").select(KEY, "interval")
    return store.load_at(spark, path, cursors).select(*MOVE)


def q_file_bytes(spark, d):
    """How often each byte occurs in files of the event types, a line each, read in byte ranges."""
    path = f"{shared_dir(spark)}/bytes-{uuid.uuid4().hex}"
    inputs.event_symbols(spark, d).select("ch").write.text(path)
    return files.read_symbols(spark, path, 1 << 14).groupBy("ch").agg(F.count("*").alias("n"))


def q_payload(spark, d):
    """The payload of every cursor's interval after one LF step."""
    move = _d5_move(spark, d)
    there = navigate.step(_heads(move).withColumn("from", F.col("interval")), move)
    return there.join(move.select(KEY, "interval", "ch", "val1", "val2"), [KEY, "interval"]).select("from", "interval", "off", "idx", "ch", "val1", "val2")


def q_separate_payload(spark, d):
    """The table with its payload kept apart and joined."""
    rows = _d5(spark, d)
    plain = rlbwt.lf_move(rows.drop("val1", "val2"), UNSPLIT)
    kept = movetable.attach_payload(plain, rows.select(KEY, F.col("run").alias("interval"), "val1", "val2"))
    return kept.select("interval", "pointer", "off", "ch", "val1", "val2")


QUERIES: dict = {name: f for name, f in list(globals().items()) if name.startswith("q_") and callable(f)}


def _by_length(query, kind, make, source, texts, prefix):
    """``query`` over ``texts``: those that a task holds whole are sorted and read there, and ``query`` gets the others."""

    def run(spark, d):
        return whole.by_length(texts(spark, d), lambda short: whole.over_texts(short, make, kind), lambda long: query(spark, d, source(long)))

    run.__doc__, run.__name__ = query.__doc__, query.__name__.replace("q_", prefix, 1)
    return run


def _sorted(texts):
    return lambda spark, d: written(recover.bwt_of(texts, recover.suffix_array(texts)))


def _given(texts):
    return lambda spark, d: texts


#: The text queries over whole documents, named doc_ for q_; SQL that sorts suffixes of such texts is too slow, so there is none.
ON_BWT = [
    (q_bwt, "bwt", whole.bwt_rows), (q_phi, "runs", whole.phi_rows(-1)), (q_phi_inv, "runs", whole.phi_rows(1)), (q_phi_rank, "ranks", whole.phi_ranks(-1)), (q_phi_inv_rank, "ranks", whole.phi_ranks(1)),
    (q_phi_move, "move", whole.phi_moves(-1)), (q_phi_inv_move, "move", whole.phi_moves(1)), (q_text_lf, "texts", whole.text_lf), (q_text_fl, "texts", whole.text_fl), (q_sa_phi, "suffix_array", whole.suffixes_by_phi(-1)),
    (q_sa_phi_inv, "suffix_array", whole.suffixes_by_phi(1)), (q_cycle_order, "order", whole.along_lf(whole.cycle_rows)), (q_single_cycle, "single", whole.along_lf(whole.single_rows)),
]
ON_TEXTS = [(q_suffix_array, "suffix_array", whole.suffix_rows), (q_bwt_long, "bwt", whole.bwt_rows)]
QUERIES |= {f.__name__: f for qs, source in ((ON_BWT, _sorted), (ON_TEXTS, _given)) for f in (_by_length(*q, source, inputs.document_texts, "doc_") for q in qs)}
#: Of a great many names, which took joins of tables with a row a name.
ON_NAMES = [(q_phi_rank, "ranks", whole.phi_ranks(-1)), (q_phi_inv_rank, "ranks", whole.phi_ranks(1))]
QUERIES |= {f.__name__: f for f in (_by_length(*q, _sorted, _names, "q_") for q in ON_NAMES)}
