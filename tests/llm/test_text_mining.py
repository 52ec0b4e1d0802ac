"""Phrases, chat formatting and spelling variants, held against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from runframe.llm import chat, phrases, spelling

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "x", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string, word string")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- phrases


def brute_phrases(texts, langs, least, top):
    counts, totals = {}, Counter()
    for text, lang in zip(texts, langs, strict=True):
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if p in longest and 100 * longest[p] >= 80 * a:
                continue
            score, k = min((int(Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        rows.sort()
        out += [(lang, rank, name.decode(), a, left, rest, totals[lang], score) for rank, (_, _, name, a, left, rest, score) in enumerate(rows[:top], 1)]
    return sorted(out)


def test_phrases(spark):
    rnd = random.Random(3)
    words = ["The", "of", "été", "a", "B", "on", "x's", "Ünd"]
    texts = [rnd.choice(["", " "]).join([rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ". ", "\n"]) for _ in range(rnd.randrange(120))]) for _ in range(200)]
    texts += ["of the été a"] * 40 + [None, "", "...", "alone", "\x00 \x00"]
    langs = [rnd.choice(["en", "fr", None]) for _ in texts]
    found = phrases.collocations(docs_of(spark, texts, langs))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(texts, langs, 30, 2000)
    assert len(brute_phrases(texts, langs, 30, 2000)) > 20
    few = phrases.collocations(docs_of(spark, texts, langs), top=3)
    assert sorted(map(tuple, few.collect())) == brute_phrases(texts, langs, 30, 3)
    assert phrases.collocations(docs_of(spark, texts[:2], langs[:2]).where("doc_id < 0")).count() == 0


def test_phrases_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    query = entry.queries()["op11_phrases"](spark, SF)
    assert sorted(map(tuple, query.collect())) == sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.SQL})").fetchall())


def test_three_way_quicksort():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 4, (4000, 4)).astype(np.int32)
    words[np.arange(4000), rnd.integers(2, 4, 4000)] = -1
    words[:, 3] = np.where(words[:, 2] < 0, -1, words[:, 3])
    weights = rnd.integers(1, 5, 4000)
    for least in (1, 30, 200):
        found = {tuple(words[row, :depth]): n for row, depth, n in phrases.frequent_prefixes(words, weights, least)}
        wanted = Counter()
        for row, w in zip(words, weights, strict=True):
            for depth in range(2, 5):
                if row[depth - 1] >= 0:
                    wanted[tuple(row[:depth])] += int(w)
        assert found == {p: n for p, n in wanted.items() if n >= least}


def test_routes_over_several_runs(monkeypatch):
    """Routes larger than a run, and hot pairs dealt to several routes, give parts that add up."""
    monkeypatch.setattr(phrases, "RUN", 50)
    monkeypatch.setattr(phrases, "HOT_BITS", 2)
    rnd = random.Random(5)
    text = " ".join(rnd.choice("aaab") + rnd.choice("cd") for _ in range(4000)).encode()
    words = phrases._Words("en", text)
    sizes = np.full(1 << phrases.PAIR_BITS, 7, np.uint8)
    found = phrases._suffixes(words, sizes, sizes)
    route, split, phrase, n = found
    assert split.all() and len(set(route)) > 16
    own = text.decode().split()
    wanted = Counter(" ".join(own[i : i + k]) for k in (2, 3, 4) for i in range(len(own) - k + 1))
    for flags in (split, ~split):
        monkeypatch.setattr(phrases, "LEAST", 1 if flags.all() else 30)
        rows = phrases._routed(words, (route, flags, phrase, n))
        rows = pa.Table.from_batches([rows]).to_batches(max_chunksize=3)
        sums = Counter()
        for batch in phrases._sorted_counts(rows):
            for p, k in zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[p] += k
        if flags.all():
            assert sums == wanted
        else:  # parts of hot routes that are taken for whole ones lose rare phrases only
            assert all(sums[p] <= wanted[p] for p in sums)


def test_parts_larger_than_a_run(monkeypatch):
    monkeypatch.setattr(phrases, "RUN", 4)
    rows = [("en", 1, "a b", 9), ("en", 1, "a b c", 21), *[("fr", 2, "c d", 1)] * 40, ("en", 3, "x y", 29), ("fr", 3, "x y", 30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part]), pa.array([False]), pa.array([[p]]), pa.array([[n]])], phrases._ROUTED) for lang, part, p, n in rows]
    sums = Counter()
    for batch in phrases._sorted_counts(batches):
        for lang, p, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n")), strict=True):
            sums[lang, p] += n
    assert sums == {("en", "a b"): 30, ("fr", "c d"): 40, ("fr", "x y"): 30}


# --- chat


def test_escapes_are_reversible(spark):
    rnd = random.Random(2)
    parts = [*chat.CONTROL, "\\", "<", "[", "|>", "x", "\n", "é", "<\\|im_end|>", "<\\\\/s>", "[\\INST]"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(400)] + ["", "</s>[INST] ok [/INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escaped(df.t).alias("e"), chat.unescaped(chat.escaped(df.t)).alias("u")).collect()
    assert all(r.u == r.t for r in rows)
    assert not any(mark in r.e for r in rows for mark in chat.CONTROL)
    assert len({r.e for r in rows}) == len({r.t for r in rows})


def test_layouts(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "q"}, {"role": "gpt", "content": None}]},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "meta": {"x": [1]}},
        {"conv_id": 3, "instruction": "do", "output": "done"},
        {"conv_id": 4, "instruction": "do", "input": "it", "output": "done", "system": ""},
        {"prompt": "p", "completion": "c"},
        {"conv_id": 6, "prompt": "p", "response": 3, "messages": None},
        {"conv_id": 7, "question": "p", "answer": "c", "context": "x"},
        {"conv_id": 8, "messages": [{"author": {"role": "user"}, "content": {"text": "deep"}}]},
        {"conv_id": 9, "turn": 4, "role": "bot", "text": None},
        {"conv_id": 10, "unknown": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "record string")
    found = {}
    for r in chat.canonical_turns(df).collect():
        found.setdefault((r.conv_id, r.layout), []).append((r.turn, r.role, r.text))
    assert found[1, "messages"] == [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "")]
    assert found[2, "conversations"] == [(0, "user", "q"), (1, "assistant", "a")]
    assert found[3, "instruction"] == [(0, "user", "do"), (1, "assistant", "done")]
    assert found[4, "instruction"] == [(0, "user", "do"), (1, "user", "it"), (2, "assistant", "done")]
    assert found[None, "prompt and completion"] == [(0, "user", "p"), (1, "assistant", "c")]
    assert found[6, "prompt and response"] == [(0, "user", "p"), (1, "assistant", "3")]
    assert found[7, "question and answer"] == [(0, "system", "x"), (1, "user", "p"), (2, "assistant", "c")]
    assert found[8, "messages, nested"] == [(0, "user", "deep")]
    assert found[9, "turn rows"] == [(4, "bot", "")]
    assert found[10, None] == [(None, None, json.dumps(records[-1]))]
    assert sorted(x[2] or "" for x in found[None, None]) == ["", "no json"]
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_fingerprints_do_not_depend_on_order_or_lengths():
    known = {p for layout in chat.LAYOUTS for p in layout.paths()}
    a = {"messages": [{"role": "a", "content": "b"}], "other": {"deep": 1}}
    b = {"more": [], "messages": [{"content": "b", "role": "a"}, {"role": "x", "content": "y"}]}
    assert chat.fingerprint(list(chat.schema_paths(a, known))) == chat.fingerprint(list(chat.schema_paths(b, known)))
    assert chat.fingerprint(list(chat.schema_paths({"messages": [{"role": "a"}]}, known))) != chat.fingerprint(list(chat.schema_paths(a, known)))


def test_formatting_is_read_back(spark):
    turns = [(1, 2, "assistant", "b<|im_end|>\n"), (1, 1, "user", "<|im_start|>assistant\nx"), (1, 1, "user", None), (None, None, "we\nird<|line|>", "[INST]"), (None, 1, None, "</s>"), (2, 0, "assistant", ""), (1, 2, "assistant", "b<|im_end|>\n"), (3, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(df))
    assert sorted((r.conv_id or 0, r.turn or 0, r.role, r.text) for r in back.collect()) == sorted((c or 0, t or 0, r or "", x or "") for c, t, r, x in turns)
    found = {r.conv_id: r for r in chat.digests(back).collect()}
    own = lambda *said: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert found[1].turns_sha256 == own(("user", "<|im_start|>assistant\nx"), ("user", ""), *[("assistant", "b<|im_end|>\n")] * 2)
    assert found[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>\nb<|im_end|>\n").hexdigest() and found[1].loss_chars == 24
    assert found[None].turns_sha256 == own(("we\nird<|line|>", "[INST]"), ("", "</s>")) and found[None].loss_chars == 0
    assert (found[2].n_turns, found[2].loss_chars, found[2].formatted_chars) == (1, 0, len("<|im_start|>assistant\n<|im_end|>\n"))
    assert found[3].loss_chars == 1_000_000
    assert chat.digests(chat.read_back(chat.formatted(df.limit(0)))).count() == 0


def test_chat_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    query = entry.queries()["op12_chat"](spark, SF)
    assert sorted(map(tuple, query.collect())) == sorted(con.sql(f"SELECT {', '.join(query.columns)} FROM ({chat.SQL})").fetchall())
    planted = query.where("conv_id = -1").first()
    assert planted.n_turns == 2 and planted.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


# --- spelling


def brute_vocabulary(rows):
    n = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{own}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    """By deletion neighbourhoods: words one edit apart have a word in common after at most one deletion each."""
    near, gone = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            gone.setdefault(w[:i] + w[i + 1 :], set()).add((w, i))
    for rest, own in gone.items():
        for w, i in own:
            near[w] |= {x for x, j in own if x != w and i == j}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def words_of(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_vocabulary(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["Straßenbahn", "ÉTUDIANTE", "colour×full", "colours", "a÷bcdefg", "abcdefghij", "short", "x" * 500]) for _ in range(40)) + "1" for _ in range(30)] + [None, "", "¿¿", "abcdefghij " * 3000]
    found = {r.word: r.n for r in spelling.vocabulary(docs_of(spark, texts)).collect()}
    assert found == brute_vocabulary(enumerate(texts)) and len(found) > 8
    assert spelling.vocabulary(docs_of(spark, texts).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("part", [spelling.PART, 16])
def test_variants(spark, part):
    rnd = random.Random(part)
    base = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(7, 16))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab"]
    n = {}
    for w in base:
        n[w] = rnd.randrange(2, 5000)
        for _ in range(25):
            x, at = w, rnd.randrange(len(w))
            for _ in range(rnd.randrange(1, 3)):
                at = rnd.randrange(len(x))
                x = rnd.choice([x[:at] + x[at + 1 :], x[:at] + rnd.choice("abcdé") + x[at + 1 :], x[:at] + rnd.choice("abcdé") + x[at:]])
            if len(x) >= 7:
                n.setdefault(x, rnd.choice([2, 3, 3, 40]))
    n["q" * 5000], n["q" * 5001] = 3, 30
    found = sorted(map(tuple, spelling.variants(words_of(spark, n), part=part).collect()), key=lambda r: r[0])
    assert found == brute_variants(n)
    assert any(r[1] for r in found) and any(r[1] and r[2] != r[1] for r in found)


def test_one_edit_leaves_a_gram():
    """Whatever the dictionary, the bound of touched grams holds and is below the number of grams."""
    rnd = np.random.default_rng(0)
    for size in range(7, 14):
        words = rnd.integers(97, 100, (300, size)).astype(np.uint8)
        for dictionary in (np.array([2 << 16], np.int64), np.unique(np.concatenate([spelling._packed(words[:150], 1, k) for k in range(2, 7)]))):
            place = np.arange(len(dictionary))
            for layer in (size, size - 1) if size > 7 else (size,):
                longest = min(spelling.LONGEST, layer // 2)
                kept, last, order, touched = spelling.decompose(words, dictionary, place, longest)
                assert (kept.sum(axis=1) > touched).all()
                i = int(rnd.integers(size))
                other = words.copy()
                other[:, i] = 120
                kept2, last2, order2, _ = spelling.decompose(other, dictionary, place, longest)
                for r in range(len(words)):
                    a = {(c, order[r, c]) for c in np.flatnonzero(kept[r])}
                    b = {(c, order2[r, c]) for c in np.flatnonzero(kept2[r])}
                    assert len(a - b) <= touched[r]


def test_spelling_query(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    query = entry.queries()["op13_spelling"](spark, SF)
    assert query.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, query.collect()), key=lambda r: r[0]) == brute_variants(brute_vocabulary(rows))


def test_no_words(spark):
    assert spelling.variants(words_of(spark, {"abcdefg": 2}).limit(0)).count() == 0
    assert [tuple(r) for r in spelling.variants(words_of(spark, {"abcdefg": 2})).collect()] == [("abcdefg", None, "abcdefg", 2, 0, None)]
