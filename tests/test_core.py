"""Golden tables, invariants and edge cases of the operators on runs."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from runframe.plans import QUERIES
from runframe.functions import alphabets, scalars
from runframe.model import UNSPLIT, BALANCED, SplitParams
from runframe.operators import movetable, navigate, phi, powers, recover, rlbwt, runs, scan, search, split
from runframe.sources import files, store

# Permutations, texts and the lists expected of them in this file (lengths, ranks, pointers, images, suffixes) that any
# implementation of these structures must give.
P16 = [1, 2, 9, 10, 11, 3, 12, 13, 4, 5, 14, 0, 15, 6, 7, 8]
TEXT = "GATTACATGATTACATAGATTACATT"
SUFFIXES = [26, 12, 4, 21, 16, 14, 6, 23, 9, 1, 18, 13, 5, 22, 8, 0, 17, 25, 11, 3, 20, 15, 7, 24, 10, 2, 19]


def perm_of(spark, *perms):
    return spark.createDataFrame([(s, i, p) for s, perm in enumerate(perms) for i, p in enumerate(perm)], "seq_id long, i long, pi long")


def runs_of(spark, lengths, images, **more):
    rows = [(0, i, n, m, *(v[i] for v in more.values())) for i, (n, m) in enumerate(zip(lengths, images, strict=True))]
    return spark.createDataFrame(rows, "seq_id long, interval long, length long, image long" + "".join(f", {k} long" for k in more))


def column(df, name, order="interval"):
    return [r[0] for r in df.orderBy("seq_id", order).select(name).collect()]


def gattaca(spark):
    return recover.suffix_sort(spark.createDataFrame([(0, TEXT)], "seq_id long, text string"))


def test_run_decomposition(spark):
    found = runs.decompose(perm_of(spark, P16))
    assert column(found, "length") == [2, 3, 1, 2, 2, 1, 1, 1, 3]
    assert column(found, "image") == [1, 9, 3, 12, 4, 14, 0, 15, 6]
    assert runs.decompose(perm_of(spark)).count() == 0
    assert column(runs.decompose(perm_of(spark, [3, 4, 5, 10, 11])), "length") == [3, 2]
    assert column(runs.decompose(perm_of(spark, [0, 1, 2, 5, 6, 7, 8, 10])), "length") == [3, 4, 1]


def test_move_table(spark):
    move = movetable.move_table(runs.decompose(perm_of(spark, P16)), UNSPLIT)
    assert column(move, "pointer") == [0, 4, 1, 7, 1, 8, 0, 8, 3]
    assert column(move, "off") == [1, 1, 1, 0, 2, 1, 0, 2, 0]
    move = movetable.move_table(runs_of(spark, [3, 2, 1, 2, 2], [4, 0, 9, 2, 7]), UNSPLIT)
    assert (column(move, "pointer"), column(move, "off")) == ([1, 0, 4, 0, 3], [1, 0, 1, 2, 1])
    assert movetable.checked(move).count() == 5
    with pytest.raises(ValueError):
        movetable.checked(move.withColumn("off", F.col("off") + 1))


def test_encodings_agree(spark):
    whole = runs.encode(runs.decompose(perm_of(spark, P16)))
    ranks = spark.createDataFrame([(0, r, i) for r, i in enumerate([6, 0, 2, 4, 8, 1, 3, 5, 7])], "seq_id long, rank long, interval long")
    assert sorted(runs.ranks_from_inverse(ranks).collect()) == sorted(whole.select("seq_id", "interval", "image_rank").collect())
    domain = runs.domain_and_longest(whole)
    for columns in (["length", "image"], ["start", "image"], ["length", "image_rank"], ["start", "image_rank"]):
        assert sorted(runs.encode(whole.select("seq_id", "interval", *columns), domain.select("seq_id", "domain")).collect()) == sorted(whole.collect())
    with pytest.raises(ValueError):
        runs.encode(whole.select("seq_id", "interval", "start", "image"))


def test_splitting(spark):
    rows = runs.encode(runs.decompose(perm_of(spark, P16)))
    cut = split.cut_longer(rows, 2)
    assert column(cut, "length") == [2, 2, 1, 1, 2, 2, 1, 1, 1, 2, 1]
    assert sorted(runs.expand(cut).collect()) == sorted(perm_of(spark, P16).collect())
    ranks = runs.with_image_rank(cut)
    assert [r[0] for r in ranks.orderBy("image_rank").select("interval").collect()] == [7, 0, 3, 5, 9, 10, 1, 2, 4, 6, 8]
    rows = runs.encode(runs_of(spark, [1, 16, 2], [0, 1, 17]))
    assert column(split.cap_by_mean(rows, 0.5), "length") == [1, 7, 7, 2, 2]
    rows = runs.encode(runs_of(spark, [2, 1, 8], [9, 0, 1], val=[5, 6, 7]))
    cut = movetable.move_table(rows, SplitParams(1.0, None))
    assert (column(cut, "length"), column(cut, "pointer"), column(cut, "off"), column(cut, "val")) == ([2, 1, 7, 1], [2, 0, 0, 2], [6, 0, 1, 5], [5, 6, 7, 7])
    assert movetable.move_table(rows).count() == 3  # payload keeps runs whole by default
    assert split.split_runs(rows, BALANCED).count() == 3
    fresh = split.cut_longer(rows, 4, lambda run, whole, at, size: {"val": run * 100 + at * 10 + size})
    assert column(fresh, "val") == [2, 101, 204, 244]
    with pytest.raises(ValueError):
        split.caps(rows, 0)


def test_navigation(spark):
    perms = [P16, [1, 0, 3, 2], [4, 5, 6, 7, 0, 1, 2, 3], [1, 2, 0, 4, 3]]
    random.seed(42)
    perms += [random.sample(range(n), n) for n in (10, 31, 50)]
    perm = perm_of(spark, *perms)
    move = movetable.move_table(runs.decompose(perm), SplitParams(0.5, None)).cache()
    cursors = navigate.locate(perm.select("seq_id", "i", F.col("i").alias("idx")), move)
    assert {(r.seq_id, r.i, r.idx) for r in navigate.step(cursors, move).collect()} == {(s, i, p) for s, x in enumerate(perms) for i, p in enumerate(x)}
    twice = {(r.seq_id, r.i, r.idx) for r in navigate.step_k(cursors, move, 3).collect()}
    assert twice == {(s, i, x[x[x[i]]]) for s, x in enumerate(perms) for i in range(len(x))}
    assert {(r.seq_id, r.i, r.idx) for r in navigate.step_k(cursors, move, 0).collect()} == {(s, i, i) for s, x in enumerate(perms) for i in range(len(x))}
    move = movetable.move_table(runs.decompose(perm_of(spark, [1, 0, 3, 2])), UNSPLIT)
    first, last = navigate.first(move), navigate.last(move)
    assert navigate.up(first, move).first()[1:3] == (3, 0) and navigate.down(last, move).first()[1:3] == (0, 0)
    assert last.first()["idx"] == 3
    assert [r.ok for r in runs.is_permutation(perm_of(spark, [0, 2], [1, 0])).orderBy("seq_id").collect()] == [False, True]
    assert [r.ok for r in navigate.is_single_cycle(perm_of(spark, [1, 2, 0], [1, 0, 2])).orderBy("seq_id").collect()] == [True, False]


def test_search(spark):
    move = movetable.move_table(runs.decompose(perm_of(spark, [1, 0, 3, 2])), UNSPLIT).withColumn("val", F.col("interval") % 2)
    cursors = spark.createDataFrame([(0, 0, 0, 1), (0, 3, 0, 0), (0, 2, 0, 42)], "seq_id long, interval long, off long, value long")
    after = {r.value: r.found_interval for r in search.succ(cursors, move, "val").collect()}
    before = {r.value: r.found_interval for r in search.pred(cursors, move, "val").collect()}
    assert (after[1], before[0], after[42], before[42]) == (1, 2, None, None)


def test_rlbwt_and_phi(spark):
    bwt = gattaca(spark).cache()
    assert [r.sa for r in bwt.orderBy("i").collect()] == SUFFIXES
    coded = rlbwt.run_length_encode(bwt).cache()
    assert [r.length for r in coded.orderBy("run").collect()] == [5, 3, 3, 3, 1, 1, 1, 4, 6]
    lf = rlbwt.lf_runs(coded)
    assert column(lf, "image") == [17, 11, 14, 1, 22, 0, 4, 23, 5]
    move = rlbwt.lf_move(coded, UNSPLIT).cache()
    assert column(move, "pointer") == [7, 3, 4, 0, 8, 0, 0, 8, 1]
    assert column(rlbwt.fl_runs(coded), "image") == [15, 11, 16, 21, 5, 8, 0, 14, 17]
    assert column(phi.phi_runs(bwt), "image") == [8, 22, 23, 18, 16, 20, 0, 17, 19]
    assert column(phi.phi_inv_runs(bwt), "length") == [8, 8, 1, 1, 1, 1, 2, 1, 4]
    assert sorted(phi.phi_move(coded, UNSPLIT).select("start", "length", "image").collect()) == sorted(phi.phi_runs(bwt).select("start", "length", "image").collect())
    for found in (recover.text_by_lf(bwt), recover.text_by_fl(bwt), recover.text_by_lf(rlbwt.expand_symbols(coded))):
        assert found.first()["text"] == TEXT
    for found in (recover.suffix_array_by_phi(runs.expand(phi.phi_runs(bwt))), recover.suffix_array_by_phi_inv(runs.expand(phi.phi_inv_runs(bwt)))):
        assert [r.sa for r in found.orderBy("i").collect()] == SUFFIXES
    back = powers.compose(lf, rlbwt.fl_runs(coded))
    assert back.where("start != image").count() == 0
    cursors = spark.createDataFrame([(0, 4, 0, "A"), (0, 4, 0, "T"), (0, 1, 2, "\x01")], "seq_id long, interval long, off long, value string")
    assert {r.value: (r.found_interval, r.found_off) for r in search.pred(cursors, move, "ch").collect()} == {"A": (3, 2), "T": (4, 0), "\x01": (None, None)}
    with pytest.raises(ValueError):
        phi.check_bwt(bwt.where("i != 15").unionByName(bwt.where("i = 15")).withColumn("ch", F.lit("A")))


def test_prefix_doubling(spark):
    random.seed(3)
    texts = ["".join(random.choice("ab") for _ in range(n)) for n in (1, 17, 60)] + ["a" * 40, TEXT, "éaéaüé"]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string")
    found = recover.suffix_array(frame).cache()
    for s, text in enumerate(texts):
        marked = text + chr(1)
        assert [r.sa for r in found.where(f"seq_id = {s}").orderBy("i").collect()] == sorted(range(len(marked)), key=lambda k: marked[k:])
    assert sorted(recover.bwt_of(frame, found).collect()) == sorted(recover.suffix_sort(frame).collect())


def test_text_queries_read_whole_documents(spark, tmp_path):
    texts = {3: "banana bandana " * 30, 5: "x", 8: "", 9: "é\nab" * 5 + "z" * 70}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    marked = {k: t + chr(1) for k, t in texts.items()}
    order = {k: sorted(range(len(t)), key=lambda j, t=t: t[j:]) for k, t in marked.items()}
    found = QUERIES["doc_bwt"](spark, str(tmp_path)).select("seq_id", "i", "ch", "sa").collect()
    assert sorted(map(tuple, found)) == [(k, i, marked[k][j - 1], j) for k in sorted(order) for i, j in enumerate(order[k])]
    found = QUERIES["doc_text_lf"](spark, str(tmp_path)).collect()
    assert {r.seq_id: r.text for r in found} == {k: t for k, t in texts.items() if t}


def test_scans_in_blocks(spark):
    rows = spark.createDataFrame([(k, i, (i * 7) % 5, i if i % 4 == 0 else None) for k in (0, 1) for i in range(50)], "seq_id long, i long, v long, w long")
    summed = scan.exclusive_sum(rows, ["seq_id"], "i", F.col("v"), "s", block=7)
    assert all(r.s == sum((j * 7) % 5 for j in range(r.i)) for r in summed.collect())
    known = scan.last_known(rows, ["seq_id"], "i", "v", "w", "k", block=7)
    assert all(r.k == r.i // 4 * 4 for r in known.collect())


def test_alphabets_and_scalars(spark):
    letters = spark.createDataFrame([(0, "A", 3), (0, "C", 5), (0, "Z", 1)], "seq_id long, ch string, n long")
    assert [tuple(r) for r in alphabets.alphabet(letters, "n").orderBy("code").collect()] == [(0, "A", 0, 3), (0, "C", 1, 5), (0, "Z", 2, 1)]
    many = spark.range(256).select(F.lit(0).cast("long").alias("seq_id"), F.col("id").cast("string").alias("ch"))
    with pytest.raises(ValueError):
        alphabets.alphabet(many)
    bases = spark.createDataFrame([(0, c) for c in "AcGtN"], "seq_id long, ch string")
    code = scalars.nucleotide_code(F.col("ch"))
    assert [r[0] for r in alphabets.check_nucleotides(bases).select(scalars.nucleotide_symbol(code)).collect()] == list("ACGTN")
    assert [r[0] for r in bases.select(scalars.complement(F.col("ch"))).collect()] == list("TGCAN")
    with pytest.raises(ValueError):
        alphabets.check_nucleotides(spark.createDataFrame([(0, "x")], "seq_id long, ch string"))
    widths = spark.createDataFrame([(v,) for v in (0, 1, 2, 255, 256)], "v long").select(scalars.bit_width(F.col("v")))
    assert [r[0] for r in widths.collect()] == [1, 1, 2, 8, 9]


def test_payload_and_widths(spark):
    rows = runs.encode(runs.decompose(perm_of(spark, P16))).withColumns({"a": F.col("interval") * 10, "b": F.col("interval") * 5})
    move = movetable.move_table(rows)
    assert movetable.widths(move).select("w_length", "w_start", "w_pointer", "w_off", "w_a", "w_b").first() == (2, 4, 4, 2, 7, 6)
    payload = rows.select("seq_id", "interval", "a")
    assert movetable.attach_payload(move.drop("a", "b"), payload).count() == 9
    with pytest.raises(ValueError):
        movetable.attach_payload(move.drop("a", "b"), payload.where("interval > 0"))


def test_store_and_files(spark, tmp_path):
    move = movetable.move_table(runs.decompose(perm_of(spark, P16)), UNSPLIT)
    path = store.save(move, str(tmp_path / "p16"), SplitParams(8.0, 16))
    again, params = store.load(spark, path)
    assert sorted(again.collect()) == sorted(move.collect()) and params == SplitParams(8.0, 16)
    spark.read.parquet(f"{path}/about").withColumn("version", F.lit(99)).write.parquet(str(tmp_path / "new.move/about"))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "new"))
    (tmp_path / "sa").mkdir()
    (tmp_path / "sa/x.sa").write_bytes(struct.pack("<4I", 3, 1, 0, 2))
    assert [r.sa for r in files.read_suffix_array(spark, str(tmp_path / "sa")).orderBy("i").collect()] == [3, 1, 0, 2]
    assert [r.ch for r in files.read_symbols(spark, str(tmp_path / "sa")).orderBy("i").limit(1).collect()] == [chr(3)]


def test_several_cycles(spark):
    perm = perm_of(spark, [1, 0, 3, 2], [0, 1], [2, 0, 1])
    found = {(r.seq_id, r.step): r.i for r in navigate.cycle_order(perm).collect()}
    assert found == {(0, 0): 0, (0, 1): 1, (0, 2): 0, (0, 3): 1, (1, 0): 0, (1, 1): 0, (2, 0): 0, (2, 1): 2, (2, 2): 1}
    assert [r.ok for r in navigate.is_single_cycle(perm).orderBy("seq_id").collect()] == [False, False, True]
    with pytest.raises(ValueError, match="more than one cycle"):
        navigate.distances(perm)


def test_power_of_a_thousand(spark):
    whole = [(i * 7 + 3) % 11 for i in range(11)]
    at = list(range(11))
    for _ in range(1000):
        at = [whole[i] for i in at]
    assert [r.pi for r in powers.permutation_power(perm_of(spark, whole), 1000).orderBy("i").collect()] == at


def test_scalars_of_64_bits(spark):
    large = F.lit((1 << 60) + 1)
    row = spark.range(1).select(
        scalars.div_up(large, F.lit(1)), scalars.div_up(F.lit(7), F.lit(2)), scalars.bits_to_bytes(F.lit((1 << 60) + 8)), scalars.all_ones(F.lit(64)), scalars.all_ones(F.lit(63)), scalars.all_ones(F.lit(0)), scalars.mask(F.lit(3), F.lit(2)), scalars.pow2(F.lit(62))
    ).first()
    assert list(row) == [(1 << 60) + 1, 4, (1 << 57) + 1, -1, (1 << 63) - 1, 0, 28, 1 << 62]


def test_payload_rows_once(spark):
    move = movetable.move_table(runs.decompose(perm_of(spark, [2, 3, 0, 1])), UNSPLIT)
    given = move.select("seq_id", "interval", F.lit(5).alias("v"))
    assert movetable.attach_payload(move, given).count() == 2
    with pytest.raises(ValueError, match="one row"):
        movetable.attach_payload(move, given.unionByName(given))
