"""The text operators against brute force, on small tables with the cases that break things."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runframe.llm import components, fingerprint, jaccard, langid, lines, media, mixing, packing, sharding, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, node long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (40, 60, 120)]
    found = [None, "", " \n\t ", "One", "one two three", "ONE two three", "123 !!", "x" * 5000, prose(rng, 3000), "you idiot, you trash scum!!", "tail \U0001f600 end"]
    for text in base:
        words = text.split()
        for k in range(6):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(99))
            found.append(" ".join(copy))
    line = "a line that many of these documents share, word for word"
    found += [f"{prose(rng, 12)}\n{line}\n{prose(rng, 9)}", f"{line}\n\n{prose(rng, 8)}", f"{line.replace('many', 'mane')}\n{prose(rng, 7)}\n{line}"]
    return found + found[-2:] + [base[0]] * 3


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "é")[i % 4], len(t) if t else None, 0.5, "clash", 7) for i, t in enumerate(texts())] + [(None, "no id", None, None, None, None, None, None), (3, "One", "en", "a", 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    assert langid.predict(empty, *langid.train(empty)).count() == 0
    assert toxicity.score(empty, *toxicity.train(empty.withColumn("toxic", F.lit(1)))).count() == 0
    for make in (tokencount.token_counts, media.encode_texts, jaccard.jaccard_groups, lines.dedup_lines, fingerprint.compare_with_next, sharding.shard, packing.pack_documents):
        assert make(empty).count() == 0, make
    taken, pieces, sources = mixing.mix(empty)
    assert (taken.count(), pieces.count(), sources.count()) == (0, 0, 0)


def test_language(spark, docs, rows, monkeypatch):
    rng = random.Random(9)
    found = langid.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.95 and 0 <= held[1] and held[2] <= 1
    guess = langid.predict(docs, *langid.train(docs), keep=("doc_id", "text")).collect()
    assert len(guess) == len(rows)
    for r in guess:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in langid.predict(docs, [], np.zeros((0, 2), np.float32)).collect()} == {"und"}
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    junk = ["".join(rng.choice("qxzjkvwbfy") for _ in range(300)), "zzzz " * 80, "\u041f\u0440\u0438\u0432\u0435\u0442 " * 40]
    assert all(r.score < langid.MIN_SCORE for r in langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string"), *model).collect())
    scores = langid.predict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), *model).select("score").toPandas()["score"]
    assert (scores >= langid.MIN_SCORE).mean() >= 0.99 and scores.min() < 0.999
    long = [prose(rng, 900) for _ in range(3)]
    sliced = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    whole = langid.predict(sliced, *model).collect()
    monkeypatch.setattr(langid, "SLICE", 501)
    assert np.allclose([r.score for r in whole], [r.score for r in langid.predict(sliced, *model).collect()])
    kept = langid.reject(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.where("text is null or text = '123 !!'").count() == 0


def test_toxicity(spark, docs):
    found = toxicity.op2_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").select("held_out", "score", "predicted", "toxic").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.toxic is not None]  # never learnt from
    ones, zeros = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    print("held out", len(ones), len(zeros), area, right)
    assert area >= 0.85 and right >= 0.85
    marked = docs.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    assert toxicity.score(docs, *toxicity.train(marked)).count() == docs.count()
    assert toxicity.features(None, {}) == [0.0] * len(toxicity.FEATURES)
    hit = toxicity.features("you 1d10t and idi0t, idiot", {"idiot": 2.0})
    assert hit[2] == 1.0 and hit[5] == 1.0 and hit[11] >= 1.0


def test_toxic_words_of_one_family(spark):
    rng = random.Random(8)

    def text(i, family):
        words = prose(rng, 40).split()
        if family:  # each has an end of its own
            words[rng.randrange(40)] = "grolk" + "".join(rng.choice("mnoprstu") for _ in range(5))
        return " ".join(words + ["blorf"] * (i % 20 == 0))

    marked = spark.createDataFrame([(i, text(i, i % 5 == 0), int(i % 5 == 0)) for i in range(600)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(marked)
    assert {"blorf", " grolk"} <= set(lexicon) and toxicity.features("abc Grolkxyz!!", lexicon)[-1] >= toxicity.LEAST_ODDS
    assert toxicity.features("grol", {" gro": 3.0, "rol ": 4.0, "gro": 5.0}, memo := {})[-1] == 4.0 and memo == {"grol": 4.0}
    assert not any(toxicity.features("abgrolk decab", lexicon)[-5:])
    given = spark.createDataFrame([(i, text(1, i % 2)) for i in range(200)], "doc_id long, text string")
    assert sum(r.predicted == r.doc_id % 2 for r in toxicity.score(given, *toxicity.train(marked)).collect()) >= 196


def test_token_counts(docs, rows):
    trie = tokencount.PrefixTrie({"▁a": -1.0, "▁": -3.0, "ab": -2.0, "b": -2.5, "bb": -2.2, "c": -4.0}, -9.0)

    def brute(word):
        best = None
        marked = "▁" + word

        def go(i, score, n):
            nonlocal best
            if i == len(marked):
                best = max(best, (score, -n)) if best else (score, -n)
                return
            size = len(marked[i].encode())
            go(i + 1, score + size * -9.0, n + size)
            for j in range(i + 1, len(marked) + 1):
                if marked[i:j] in trie.scores:
                    go(j, score + trie.scores[marked[i:j]], n + 1)

        go(0, 0.0, 0)
        return -best[1], best[0]

    rng = random.Random(1)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(200)} | {"a" * 60}
    trie.insert(words)
    for word in words - {"a" * 60}:
        assert trie.counts[word][0] == brute(word)[0] and abs(trie.counts[word][1] - brute(word)[1]) < 1e-9
        assert trie.single(word) == trie.counts[word]
    found = {r.doc_id: r for r in tokencount.token_counts(docs).collect()}
    for r in rows:
        assert found[r[0]].n_words == len(WORDS.findall(r[1] or ""))
        assert found[r[0]].n_tokens >= found[r[0]].n_words


def test_media(docs, rows):
    for form in ("pgm", "bmp"):
        stored = media.encode_texts(docs, keep=("doc_id", "text"), form=form)
        for r in media.media_features(stored, keep=("text", "n_bytes")).collect():
            raw = (r.text or "").encode()
            assert r.n_bytes == len(raw) and bytes(r.payload).rstrip(b"\0") == raw.rstrip(b"\0") and len(r.payload) % 64 == 0 and len(r.payload) >= max(64, len(raw))
            assert np.load(__import__("io").BytesIO(bytes(r.tile))).shape == (64, 64)
    assert (media.decode(b"P3\n# note\n2 1 255\n1 2 3 4 5 6") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.decode(b"P2 2 1 9 8 7") == [[8, 7]]).all() and (media.decode(b"P6 1 1 255\nabc") == [[[97, 98, 99]]]).all()
    pixels = np.arange(35.0).reshape(5, 7)
    tall = np.repeat(np.repeat(pixels, 3, 0), 4, 1)
    assert np.allclose(media.area_resize(pixels, 3, 4), tall.reshape(3, 5, 4, 7).mean(axis=(1, 3)))
    header = media.encode_bmp(bytes(64))
    broken = [b"", b"GIF89a", b"BM", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 2 1 255 3", b"P5 0 4 255 ", b"P5 4 4 255 ab", b"P2 1 1 255 x", b"P2 1 1 0 0", b"P2 #", b"P2", header[:60], header[:1060], header[:18] + bytes(4) + header[22:]]
    for raw in broken:
        with pytest.raises(ValueError):
            media.decode(raw)
    frame = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate([*broken, None])], "doc_id long, media binary")
    assert all(r.payload is None and r.tile is None and r.feature is None for r in media.media_features(frame).collect())


def test_media_query_makes_tiles(spark):
    found = media.op4_media_columns(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "doc_id").limit(20).collect()
    assert found
    for r in found:
        raw = (r.text or "").encode()
        pixels = np.frombuffer(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), np.uint8).reshape(-1, 64)
        tile = media.npy_tile(pixels)
        assert (r.tile_bytes, r.tile_sha256) == (len(tile), hashlib.sha256(tile).hexdigest())


def brute_groups(found, k, percent):
    sets = {}
    for i, (text) in found.items():
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORDS.findall(text or "")]
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 256), (5, 80, 4)])
def test_jaccard(docs, rows, k, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks take the way of large families
    want = brute_groups({r[0]: r[1] for r in rows if r[0] is not None}, k, percent)
    found = jaccard.jaccard_groups(docs, k, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_open_pairs_count_ngrams_of_either_main(spark):
    """Nodes 1 and 2 share ten n-grams: in five node 1's component is the main one, in five node 2's."""
    met = [(key, node, 100, key) for key in range(10) for node in (1, 2, 3 if key < 5 else 4)]
    joined = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 2)], "node long, component long")
    found = jaccard._open_pairs(spark.createDataFrame(met, "key long, node long, n long, place long"), joined, 85)
    assert [tuple(sorted(r)) for r in found.collect()] == [(1, 2)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    group = {i: i for pair in links for i in pair}
    for a, b in links * 40:
        group[a] = group[b] = min(group[a], group[b])
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(group[i] == g for i, g in found.items())


@pytest.mark.parametrize("shard_blocks", [1024, 16])
def test_mixing(docs, rows, shard_blocks):
    taken, pieces, sources = mixing.mix(docs, block=8, shard_blocks=shard_blocks)
    size = lambda t: len(WORDS.findall(t or ""))
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in order]
    weights, target = [(5, 2, 1)[i % 3] for i in range(len(order))], [0.0] * len(order)
    stopped, left = set(), float(sum(sizes))
    while True:
        free = [i for i in range(len(order)) if i not in stopped]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            break
        stopped |= set(over)
        left = sum(sizes) - sum(3 * sizes[i] for i in stopped)
    target = [3 * sizes[i] if i in stopped else share[i] for i in range(len(order))]
    got = {r.source: r for r in sources.collect()}
    for s, n, t in zip(order, sizes, target, strict=True):
        assert got[s].source_size == n and abs(got[s].target - t) < 1e-6
    sums = {r["rank"]: r.n for r in pieces.groupBy("rank").agg(F.sum(F.col("words") * F.col("uses")).alias("n")).collect()}
    for r in got.values():
        assert abs(sums.get(r["rank"], 0) - r.target) <= 16 + 0.02 * r.target
    assert pieces.agg(F.max("uses")).first()[0] <= mixing.MOST
    assert taken.count() == len(rows)
    again = mixing.mix(docs, block=8, shard_blocks=shard_blocks)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces.collect()))


@pytest.mark.parametrize("shard_blocks", [4096, 500, 50])
def test_shards_are_drawn(spark, shard_blocks):
    """Each source's slots are dealt once and whole, and counts of every shard, of one, three or 31, are near a multinomial's."""
    given = [(f"s{i}", n, i, float(t)) for i, (n, t) in enumerate([(9000, 6400), (5000, 4000), (400, 1100), (0, 0), (30, 8)])]
    sources = spark.createDataFrame(given, "source string, source_size long, rank int, target double")
    slots = mixing.shard_slots(sources, 8, shard_blocks).collect()
    want = {i: round(t * -(-n // 8) / n) for _, n, i, t in given if n}
    total = sum(want.values())
    for rank, n in want.items():
        assert sorted(k for r in slots if r["rank"] == rank for k in range(r.base, r.base + r.n)) == list(range(n))
    spread = 0.0
    for shard in range(-(-total // shard_blocks)):
        size = min(shard_blocks, total - shard * shard_blocks)
        assert sum(r.n for r in slots if r.shard == shard) == size
        for rank, n in want.items():
            p, found = n / total, sum(r.n for r in slots if r["rank"] == rank and r.shard == shard)
            assert abs(found - size * p) <= 5 * (size * p * (1 - p)) ** 0.5 + 2
            spread += abs(found - size * p)
    assert spread > 0 or shard_blocks > total


def test_mixing_query(spark):
    """The query's own columns, on the given table: sizes by brute force, and targets met."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()}
    found = mixing.op6_mixing(spark, DATA).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    size = {i: len(WORDS.findall(r.text or "")) for i, r in docs.items()}
    whole, taken = {}, {}
    for i, r in docs.items():
        whole[r.source] = whole.get(r.source, 0) + size[i]
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == whole[docs[r.doc_id].source] and 0 <= r.taken <= mixing.MOST * r.size
        taken.setdefault(docs[r.doc_id].source, [0, r.target])[0] += r.taken
    for source, (n, target) in taken.items():
        assert abs(n - target) <= 2 * mixing.BLOCK + 0.02 * target, source


def test_mix_stage(spark, docs):
    found = mixing.mix_stage(spark, docs, DATA)
    assert found.columns == docs.columns and found.count() > 0


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = fingerprint.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, hashlib.sha256(fingerprint.edited(r[1] or "", order[(i + 1) % len(order)][1] or "").encode()).hexdigest()) for i, r in enumerate(order))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.edited_sha256) for r in found) == want
    alone = fingerprint.fingerprints(docs, keep=("text",)).collect()
    by_text = {}
    for r in alone:
        assert by_text.setdefault(r.text or "", bytes(r.print).hex()) == bytes(r.print).hex()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    for r in found:  # each text alone gives what it gives among others
        if r.doc_id is not None and r.doc_id != 3:
            assert r.fingerprint == by_text[rows[r.doc_id][1] or ""]
    rng = random.Random(4)
    text = prose(rng, 600)
    near = text[:900] + "X" + text[900:]
    a, b, c = fingerprint.sketch([text, near, prose(rng, 600)])
    assert a == fingerprint.sketch([text])[0] and fingerprint.likeness([(a, a), (b"", b""), (a, b"")]) == [1.0, 1.0, 0.0]
    (same,), (other,) = fingerprint.likeness([(a, b)]), fingerprint.likeness([(a, c)])
    assert same > 0.8 and other < 0.2


def test_ranges(spark, monkeypatch):
    """Ids with gaps and one far outlier are parted evenly; each row is told apart by the bounds."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    ids = [None, -(2**62), *range(-50, 50), *range(10**6, 10**6 + 300, 3), 2**62]
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, _text string")
    bounds = fingerprint._bounds(rows)
    assert bounds == sorted(set(bounds)) and len(bounds) >= 40
    found = rows.select("doc_id", fingerprint._range_of("doc_id", bounds).alias("r")).collect()
    assert all(r.r == (-1 if r.doc_id is None else sum(b <= r.doc_id for b in bounds)) for r in found)
    sizes = [sum(r.r == k for r in found) for k in range(len(bounds) + 1)]
    assert max(sizes) <= 8 and fingerprint._bounds(rows.limit(0)) == []
    for some in (bounds[:1], bounds[:7], bounds[:8], []):
        got = rows.select("doc_id", fingerprint._range_of("doc_id", some).alias("r")).collect()
        assert all(r.r == (-1 if r.doc_id is None else sum(b <= r.doc_id for b in some)) for r in got)


def test_next_over_many_ranges(spark, docs, rows, monkeypatch):
    whole = sorted(map(tuple, ((r.doc_id or -1, r.edited_sha256, r.near_next) for r in fingerprint.compare_with_next(docs).collect())))
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    assert sorted(map(tuple, ((r.doc_id or -1, r.edited_sha256, r.near_next) for r in fingerprint.compare_with_next(docs).collect()))) == whole


def walked(text):
    """What the walk over a text emits, step by step."""
    codes = [(ord(c) * 2654435761 % 2**32 >> 20) % 255 + 1 for c in text] + [0]
    at, out = 0, []
    for step in range(int(fingerprint.walk_steps(len(text)))):
        out.append(codes[at])
        at += int(fingerprint._BITS[0][step % 4093][codes[at]] ^ fingerprint._BITS[1][step % 4099][codes[at]])
    assert at == len(text)
    return out


def test_walk(rows):
    for text in [t for t in texts() if t and len(t) < 4000]:
        steps = walked(text)
        want = []
        for place in fingerprint.places(len(steps))[0].tolist():
            total = 0
            for symbol in steps[place : place + fingerprint.RUN]:
                total = (total * 0x01000193 + symbol) % 2**32
            want.append(total * 2654435761 % 2**32 >> 24)
        assert fingerprint.sketch([text])[0] == bytes(want).rstrip(b"\0")


def walked_near(text, level, walk):
    """The coordinates of one independent walk over a text, step by step."""
    codes = [(ord(c) * 2654435761 % 2**32 >> 20) % 255 + 1 for c in (text if walk % 2 == 0 else text[::-1])] + [0]
    first, run = fingerprint.spots(level)
    at, out = 0, []
    for step in range(int(first[-1]) + run):
        out.append(codes[at])
        at += int(fingerprint._MOVES[0][step % 4093][walk][codes[at]] ^ fingerprint._MOVES[1][step % 4099][walk][codes[at]])
    found = []
    for place in first.tolist():
        total = 0
        for symbol in out[place : place + run]:
            total = (total * 0x01000193 + symbol) % 2**32
        found.append((total * 2654435761 % 2**32) >> 24)
    return found


def test_near_walks():
    """Every walk of every level by itself, though all go in lockstep; texts of nearly equal length have a level in common."""
    given = [t for t in texts() if t and len(t) < 4000] + ["a", "ab", "é\U0001f600x", "abc " * 90]
    found = {}
    for level, places, prints in fingerprint.walk_prints(["", *given]):
        for place, own in zip(places.tolist(), prints, strict=True):
            found[place, level] = own
    for i, text in enumerate(given, 1):
        least = [level for place, level in found if place == i]
        assert max(least) == max(k for k in range(60) if fingerprint._LEAST[k] <= len(text))
        for level in least:
            assert found[i, level].tolist() == [walked_near(text, level, walk) for walk in range(fingerprint.WALKS)]
    levels = [set() for _ in range(1500)]
    for level, places, _ in fingerprint.walk_prints(["x" * n for n in range(1, 1501)]):
        for place in places.tolist():
            levels[place].add(level)
    assert all(levels[n - 1] & levels[n + n // 12 - 1] for n in range(1, 1380)) and fingerprint.walk_prints(["", ""]) == fingerprint.walk_prints([]) == []


def test_components_go_on_from_known_ones(spark, docs, monkeypatch):
    """The same components in fewer rounds, and near_ids never starts them anew."""
    tables, seen, write, whole = [], [], components.written, components.components
    monkeypatch.setattr(components, "written", lambda df: tables.append(0) or write(df))
    chain = [(i, i + 1) for i in range(100)] + [(i, i + 1) for i in range(200, 300)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    found = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    known = components.components(frame(chain))
    first, more = len(tables), [(50, 250), (400, 300), (7, 7)]
    assert found(components.components(frame(more), known)) == found(components.components(frame(chain + more)))
    tables.clear()
    components.components(frame(more), known)
    assert len(tables) < first and found(components.components(frame([]), known)) == found(known) and found(components.components(frame([]))) == []
    monkeypatch.setattr(fingerprint, "components", lambda *given: seen.append(given) or whole(*given))
    fingerprint.near_ids(docs, 0.05)  # many are unlike their first pivot
    assert len(seen) > 1 and all(len(given) == 2 and given[1] is not None for given in seen[1:])


def test_near_links(docs):
    """All texts that share a band of a walk that is near are joined, and no others."""
    given = {r.node: r.text for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text")).collect()}
    nodes, prints, keys = list(given), {}, {}
    for level, places, found in fingerprint.walk_prints([given[n] for n in nodes]):
        for place, own, row in zip(places.tolist(), found, fingerprint.band_keys(np.full(len(places), level), found), strict=True):
            prints[nodes[place], level] = own
            keys.setdefault(nodes[place], set()).update(row.tolist())
    want = []
    for a in keys:
        for b in keys:
            spots = {divmod(k % 1024, fingerprint.WALKS) for k in keys[a] & keys[b]} if a < b else ()
            if any((prints[a, level][walk] != prints[b, level][walk]).sum() <= fingerprint.UNLIKE * fingerprint.COORDS for level, walk in spots):
                want.append((a, b))
    got = [(r.a, r.b) for r in fingerprint.near_links(docs).collect()]
    assert want and joined(got) == joined(want) and {tuple(sorted(x)) for x in got} <= set(want)


def test_near_ids_of_odd_rows(spark):
    """Nulls, empty and repeated texts, a null id, clashing extra columns, one very long text, and no rows at all."""
    long = "".join(chr(97 + i * i * 7 % 26) for i in range(300_000))
    given = [(1, None), (2, ""), (3, "the same text"), (4, "the same text"), (None, "the same text"), (5, long), (6, long[:150_000] + "?" + long[150_000:])]
    frame = spark.createDataFrame(given, "doc_id long, text string").select("*", F.lit(0).alias("node"), F.lit("").alias("_text"), F.lit(1).alias("level"), F.lit(1).alias("a.b"))
    found = {r.doc_id: r.near_id for r in fingerprint.near_ids(frame).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, None: 3, 5: 5, 6: 5}
    assert fingerprint.near_ids(frame.limit(0)).count() == 0


def test_near_recall(spark, docs):
    """Texts of 200 characters or more within 30 edits, by brute force, and the share of them that have one near_id."""
    near = {r.doc_id: r.near_id for r in fingerprint.near_ids(docs.where("doc_id != 3")).collect()}
    rows = docs.where("doc_id != 3 and length(text) between 200 and 4000").select("doc_id", "text")
    true = rows.alias("a").join(rows.alias("b"), F.expr("a.doc_id < b.doc_id and levenshtein(a.text, b.text, 30) >= 0")).select("a.doc_id", F.col("b.doc_id").alias("other")).collect()
    recall = sum(near[r.doc_id] == near[r.other] for r in true) / len(true)
    print("recall", recall, "of", len(true))
    assert recall >= 0.9


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def joined(links):
    """The smallest line reachable from each line of the links."""
    group = {x: x for pair in links for x in pair}
    for a, b in links:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        if old != new:
            group = {x: new if g == old else g for x, g in group.items()}
    return group


@pytest.mark.parametrize(("bands", "hot"), [(((24, 1),), 16), (((20, 1), (28, 2)), 2), (((8, 3),), 4)])
def test_near_lines(spark, bands, hot, monkeypatch):
    """All lines share a segment with many others; with a small HOT, keys are narrowed to the end."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(hot)
    found = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(7, 32))) for _ in range(12)}
    for line in list(found):
        for _ in range(8):
            s = list(line)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            found.add("".join(s))
    found |= {f"the same beginning of all, {rng.randrange(400):03d}" for _ in range(60)} | {f"one more letter in all of them: {c}{d}" for c in "abcdefg" for d in ["", *"abcdefg"]}
    found = sorted(found)
    frame = spark.createDataFrame([(x,) for x in found], "line string")
    name = {r.id: r.line for r in frame.select(F.xxhash64("line").alias("id"), "line").collect()}
    got = [(name[r.a], name[r.b]) for r in lines.near_lines(frame, bands).collect()]
    most = lambda a, b: max((e for low, e in bands if min(len(a), len(b)) >= low), default=-1)
    want = [(a, b) for a in found for b in found if a < b and abs(len(a) - len(b)) <= most(a, b) and levenshtein(a, b) <= most(a, b)]
    assert want and all(levenshtein(a, b) <= most(a, b) for a, b in got) and joined(got) == joined(want)


def test_within(spark):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, most)))
    found = [(word(7), word(7)) for _ in range(200)]
    for _ in range(200):
        same, behind = word(80), word(50)
        found += [(same + word(3) + behind, same + word(3) + behind), (same, same), (same + "a", same)]
    frame = spark.createDataFrame(found, "a string, b string")
    frame = packing.written(frame.withColumns({"x": lines.coded(F.col("a")), "y": lines.coded(F.col("b"))}))
    for r in frame.select("a", "b", *(lines.within(F.col("x"), F.col("y"), e).alias(f"e{e}") for e in (1, 2, 3))).collect():
        assert [r.e1, r.e2, r.e3] == [levenshtein(r.a, r.b) <= e for e in (1, 2, 3)]


def test_line_dedup(spark, docs, rows, tmp_path):
    found = lines.dedup_lines(docs)
    assert [c for c in found.columns if c not in ("n_lines", "n_removed")] == docs.columns and found.count() == len(rows)
    whole = spark.createDataFrame([r for i, r in enumerate(rows) if r[0] is not None and i < len(rows) - 1], SCHEMA)
    whole.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    mine = sorted(map(tuple, lines.dedup_lines(whole).select("doc_id", "n_lines", "n_removed", "text").collect()))
    assert mine == sorted(con.sql(lines.SQL).fetchall())


def test_sharding(docs, rows):
    found = sharding.shard(docs.withColumn("kept", F.lit(1)), shards=5).collect()
    assert len(found) == len(rows)
    for r in range(5):
        slots = sorted(x.slot for x in found if x.shard == r)
        assert slots == list(range(len(slots)))
    by_text = {}
    for r in rows:
        raw = (r[1] or "").encode()
        at = {x.shard for x in found if x.doc_id == r[0] and x.text_crc32 == zlib.crc32(raw)}
        assert len(at) == 1 and by_text.setdefault(raw, at) == at
    rng = random.Random(6)
    for _ in range(60):
        sizes, k = np.array([rng.randint(1, 30) ** 2 for _ in range(rng.randint(1, 12))]), rng.randint(1, 5)

        def least(i, left):
            if left == 1 or i == len(sizes):
                return int(sizes[i:].sum())
            return min(max(int(sizes[i:j].sum()), least(j, left - 1)) for j in range(i, len(sizes) + 1))

        capacity = sharding.smallest_capacity(sizes, k)
        assert capacity == least(0, k)
        shard = sharding.cuts(sizes, k)
        assert (np.diff(shard) >= 0).all() and shard.max() < k and max(sizes[shard == s].sum() for s in range(k)) <= capacity


def test_packing(docs, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing.encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext", " " * 3000 + "x", "I'll  don't\n\n\tx\u00a0y"):
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    for r in rows:
        assert encode(r[1] or "").tolist() == whole.encode(r[1] or "", add_special_tokens=False).ids
    cut = packing.written(packing.pieces(docs, with_ids=True))
    found = packing.pack(cut).collect()
    assert sum(r.length for r in found) == sum(len(encode(r[1] or "")) + 1 for r in rows)
    sequences = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= packing.WINDOW
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    rng = random.Random(8)
    for _ in range(80):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        chosen = packing.fullest(counts, 50)
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {max(counts)}
        items.remove(max(counts))
        for n in items:
            sums |= {s + n for s in sums if s + n <= 50}
        assert sum(n * c for n, c in chosen) == max(sums) and all(c <= counts[n] for n, c in chosen)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = packing.written(stage(spark, docs, DATA))
        assert kept.columns == docs.columns and kept.count() > 0
        docs = kept
    found = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    texts = [r.text for r in docs.collect()]
    encode = packing.encoder()
    assert found.agg(F.sum("length")).first()[0] == sum(len(encode(t)) + 1 for t in texts)
