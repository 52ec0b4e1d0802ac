"""Operators that stay in run space, lookups, stored tables and files, against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runframe.model import UNSPLIT
from runframe.operators import contract, movetable, navigate, phi, powers, recover, rlbwt, runs, scan, split
from runframe.scratch import written
from runframe.sources import files, store


def perm_of(spark, *perms):
    return spark.createDataFrame([(s, i, p) for s, perm in enumerate(perms) for i, p in enumerate(perm)], "seq_id long, i long, pi long")


def of_blocks(rnd, n, r):
    """A permutation of n with at most r runs."""
    cuts = [0, *sorted(rnd.sample(range(1, n), r - 1)), n]
    blocks = [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rnd.shuffle(blocks)
    out = [0] * n
    for image, i in enumerate(i for block in blocks for i in block):
        out[i] = image
    return out


def run_rows(perm):
    heads = [i for i in range(len(perm)) if i == 0 or perm[i] != perm[i - 1] + 1]
    return [(k, a, b - a, perm[a]) for k, (a, b) in enumerate(zip(heads, [*heads[1:], len(perm)], strict=True))]


PERMS = [of_blocks(random.Random(1), 200, 9), of_blocks(random.Random(2), 50, 12), list(range(7)), [0]]


@pytest.mark.parametrize("block", [16, scan.BLOCK])
def test_runs_over_block_edges(spark, block):
    new = F.col("_before").isNull() | (F.col("pi") != F.col("_before.pi") + 1)
    found = scan.islands(perm_of(spark, *PERMS), "i", ["pi"], new, "interval", {"length": F.lit(1)}, {"start": "i", "image": "pi"}, block)
    rows = sorted(map(tuple, found.select("seq_id", "interval", "start", "length", "image").collect()))
    assert rows == [(s, *row) for s, perm in enumerate(PERMS) for row in run_rows(perm)]


@pytest.mark.parametrize("block", [16, scan.BLOCK])
def test_powers_stay_interval_tables(spark, block, monkeypatch):
    table = written(runs.decompose(perm_of(spark, *PERMS)))
    for k in (0, 1, 6):
        power = written(powers.power(table, k, block))
        at = [list(range(len(p))) for p in PERMS]
        for _ in range(k):
            at = [[p[x] for x in own] for p, own in zip(PERMS, at, strict=True)]
        assert sorted(map(tuple, runs.expand(power).collect())) == [(s, i, x) for s, own in enumerate(at) for i, x in enumerate(own)]
        least = [run_rows(own) for own in at]
        edges = sum(len(p) // block + 1 for p in PERMS)
        assert sum(map(len, least)) <= power.count() <= sum(map(len, least)) + edges  # no more than runs and block edges
    monkeypatch.setattr(runs, "expand", None)
    monkeypatch.setattr(powers, "expand", None)
    move = written(movetable.move_table(runs.decompose(perm_of(spark, *PERMS)), UNSPLIT))
    cursors = move.select("seq_id", "interval", F.lit(0).cast("long").alias("off"), F.col("start").alias("i"))
    found = {(r.seq_id, r.i): r.idx for r in navigate.step_k(cursors, move, 1000).collect()}
    for (s, i), idx in found.items():
        for _ in range(1000):
            i = PERMS[s][i]
        assert i == idx


def test_lookups_agree(spark):
    move = written(movetable.move_table(runs.decompose(perm_of(spark, *PERMS)), UNSPLIT))
    points = spark.createDataFrame([(s, i, "x") for s in range(len(PERMS) + 1) for i in (-1, *range(len(PERMS[s % len(PERMS)]) + 2))], "seq_id long, idx long, note string")
    rows = [sorted(map(repr, navigate.locate(points, move, strategy=how).select("seq_id", "idx", "note", "interval", "off").collect())) for how in ("scan", "search", None)]
    assert rows[0] == rows[1] == rows[2]
    from runframe.operators import lookup

    assert lookup.fits(move) and not lookup.fits(move, 32)


def test_distances_in_run_space(spark):
    """Texts with many times more symbols than runs, one of them of a single letter, so that LF drifts by one."""
    texts, block = ["abcab" * 20, "a" * 80, "", "mississippi", "ab" * 20 + "ba" * 20], 8
    bwt = written(recover.suffix_sort(spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string")))
    coded = written(rlbwt.run_length_encode(bwt))
    lf = written(rlbwt.lf_runs(coded).select("seq_id", "interval", "start", "length", "image"))
    suffix = {(r.seq_id, r.i): r.sa for r in bwt.collect()}
    found = contract.end_distances(lf, block, 3).collect()
    assert {(r.seq_id, r.i): r.dist for r in found} == {(r.seq_id, i): suffix[r.seq_id, i] for r in lf.collect() for i in (r.start, r.start + r.length - 1)}
    sizes = {r.seq_id: (r.n, r.k) for r in contract.contracted(lf, block, 3).groupBy("seq_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()}
    runs_of = {r.seq_id: r.n for r in lf.groupBy("seq_id").agg(F.count("*").alias("n")).collect()}
    assert all(n <= 3 * runs_of[s] for s, (n, _) in sizes.items())
    for a, b in ((phi.phi_runs(bwt), phi.phi_runs_of(coded)), (phi.phi_inv_runs(bwt), phi.phi_inv_runs_of(coded))):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError, match="end mark"):
        phi.check_runs(coded.withColumn("ch", F.lit("a")))


def test_chunks(spark):
    texts = ["banana bandana", "x", "", "abcde" * 3]
    bwt = written(recover.suffix_sort(spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string")).select("seq_id", "i", "ch"))
    wanted = [(s, k // 5, t[k : k + 5]) for s, t in enumerate(texts) for k in range(0, len(t), 5)]
    for found in (recover.chunks_by_lf(bwt, 5), recover.chunks_by_fl(bwt, 5)):
        assert sorted(map(tuple, found.collect())) == wanted


def test_long_texts_are_cut_before_they_are_exploded(spark):
    text = "".join(random.Random(7).choice("abcdé") for _ in range(3000))
    found = recover.symbols_of(spark.createDataFrame([(0, text), (1, None)], "seq_id long, text string"), part=100, after=2)
    assert [r.ch for r in found.where("seq_id = 0").orderBy("sa").collect()] == [*text, chr(1)]
    marked = text + chr(1) + "\0\0"
    assert all((r.code, r.code1, r.code2) == tuple(map(ord, marked[r.sa : r.sa + 3])) for r in found.where("seq_id = 0").collect())
    assert found.where("seq_id = 1").count() == 1


def test_violations(spark):
    move = written(movetable.move_table(runs.decompose(perm_of(spark, *PERMS[:2])), UNSPLIT))
    whole = move.count()
    assert movetable.violations(move).count() == 0
    for column in ("pointer", "off", "start", "image", "length", "interval", "seq_id"):
        broken = move.withColumn(column, F.when(F.col("interval") == 3, F.lit(None)).otherwise(F.col(column)))
        assert movetable.violations(broken).count() >= 2, column
        assert movetable.violations(move.withColumn(column, F.lit(None).cast("long"))).count() == whole, column
    assert movetable.violations(move.unionByName(move.where("interval = 2"))).count() >= 4
    assert movetable.violations(move.where("interval != 2")).count() > 0
    assert movetable.violations(move.withColumn("interval", F.col("interval") + 1)).count() > 0
    with pytest.raises(ValueError):
        movetable.checked(move.withColumn("pointer", F.lit(None).cast("long")))


def test_longest_is_checked(spark):
    rows = runs.decompose(perm_of(spark, *PERMS))
    given = runs.domain_and_longest(rows).select("seq_id", "max_length")
    assert runs.encode(rows, longest=given).count() == rows.count()
    with pytest.raises(ValueError, match="longest"):
        runs.encode(rows, longest=given.withColumn("max_length", F.col("max_length") + 1))
    with pytest.raises(ValueError, match="longest"):
        runs.encode(rows, longest=given.where("seq_id > 0"))


def test_payload_in_python(spark):
    import pyarrow.compute as pc

    rows = runs.encode(runs.decompose(perm_of(spark, *PERMS)), ranks=False).withColumn("kept", F.col("interval") * 2)
    native = split.cut_longer(rows, 4, lambda run, whole, at, size: {"v": run + at, "w": whole - size})
    given = split.Vectorised(lambda run, whole, at, size: [pc.add(run, at), pc.subtract(whole, size)], "v long, w long")
    found = split.cut_longer(rows, 4, given)
    assert found.columns == native.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, native.collect()))


def test_codes(spark):
    bwt = spark.createDataFrame([(s, i, ch) for s, text in enumerate(["banana", "xyyx"]) for i, ch in enumerate(text)], "seq_id long, i long, ch string")
    move = rlbwt.lf_move(rlbwt.run_length_encode(bwt), codes=True)
    assert {(r.seq_id, r.ch, r.code) for r in move.collect()} == {(0, "a", 0), (0, "b", 1), (0, "n", 2), (1, "x", 0), (1, "y", 1)}


def test_stored_tables_are_read_in_part(spark, tmp_path):
    rows = runs.encode(runs.decompose(perm_of(spark, *PERMS)), ranks=False)
    move = written(movetable.move_table(split.cut_longer(rows, 3), UNSPLIT))
    path = store.save(move, str(tmp_path / "cut"), UNSPLIT, rows, file_rows=5)
    about = store.about(spark, path).first()
    assert (about.rows, about.runs, about.domain) == (move.count(), rows.count(), sum(map(len, PERMS)))
    cursors = move.where("seq_id = 0 and interval in (3, 4) or seq_id = 2").select("seq_id", "interval")
    found = store.load_at(spark, path, cursors)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, move.where("seq_id = 0 and interval in (3, 4) or seq_id = 2").select(*found.columns).collect()))
    assert len(found.inputFiles()) < len(store.load(spark, path)[0].inputFiles()) // 2
    assert store.load_at(spark, path, cursors.limit(0)).count() == 0


def test_files_in_byte_ranges(spark, tmp_path):
    rnd = random.Random(3)
    data = {"a.bin": rnd.randbytes(4 * 5000), "b.bin": b"", "sub/c.bin": b"\x01\x00\x00\x80"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.read_numbers(spark, f"file://{tmp_path}", 4, size=1001)
    assert found.rdd.getNumPartitions() == 21
    assert {(r.path.removeprefix(f"{tmp_path}/"), r.i): r.value for r in found.collect()} == {(n, i // 4): int.from_bytes(c[i : i + 4], "little") for n, c in data.items() for i in range(0, len(c), 4)}
    assert bytes(r.value for r in files.read_numbers(spark, str(tmp_path / "a.bin"), 1, 999).orderBy("i").collect()) == data["a.bin"]
    (tmp_path / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="no multiple"):
        files.read_numbers(spark, str(tmp_path), 4).count()
