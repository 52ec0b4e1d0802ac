"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..model import USUAL
from .inputs import STRIDE
from .queries import FACTOR, LF_STEPS, LONGEST, REPEATS, STEPS

#: Named parts; each is used with those that it names itself.
PARTS = {
    "perm": ("", """SELECT 0::BIGINT AS seq_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS pi FROM orders"""),
    "runs": ("perm", """SELECT seq_id, (run - 1)::BIGINT AS "interval", min(i) AS "start", count(*) AS length, min(pi) AS image FROM (
        SELECT *, sum(brk) OVER (ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(pi) OVER (ORDER BY i) = pi - 1 THEN 0 ELSE 1 END AS brk FROM perm)) GROUP BY seq_id, run"""),
    "ranked": ("runs", """SELECT *, row_number() OVER (ORDER BY image) - 1 AS image_rank FROM runs"""),
    "move": ("runs", """SELECT a.*, b."interval" AS pointer, a.image - b."start" AS off FROM runs a ASOF JOIN runs b ON a.seq_id = b.seq_id AND a.image >= b."start" """),
    "sym": ("", """SELECT 0::BIGINT AS seq_id, event_id AS i, event_type AS ch FROM events"""),
    "blocks": ("sym", f"""SELECT a.seq_id, a.i, b.ch FROM sym a JOIN sym b ON b.i = a.i // {STRIDE} * {STRIDE}"""),
    "rle": ("sym", """SELECT seq_id, (run - 1)::BIGINT AS run, min(ch) AS ch, count(*) AS length, min(i) AS "start" FROM (
        SELECT *, sum(brk) OVER (ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(ch) OVER (ORDER BY i) = ch THEN 0 ELSE 1 END AS brk FROM sym)) GROUP BY seq_id, run"""),
    "brle": ("blocks", """SELECT seq_id, (run - 1)::BIGINT AS run, min(ch) AS ch, count(*) AS length, min(i) AS "start" FROM (
        SELECT *, sum(brk) OVER (ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(ch) OVER (ORDER BY i) = ch THEN 0 ELSE 1 END AS brk FROM blocks)) GROUP BY seq_id, run"""),
    "lfr": ("rle", """SELECT seq_id, run AS "interval", ch, "start", length, (sum(length) OVER (ORDER BY ch, run) - length)::BIGINT AS image, row_number() OVER (ORDER BY ch, run) - 1 AS image_rank,
        (sum(length) OVER (PARTITION BY ch ORDER BY run) - length)::BIGINT AS head_rank FROM rle"""),
    "lfm": ("lfr", """SELECT a.seq_id, a."interval", a.ch, a."start", a.length, a.image, b."interval" AS pointer, a.image - b."start" AS off FROM lfr a ASOF JOIN lfr b ON a.seq_id = b.seq_id AND a.image >= b."start" """),
    "flr": ("lfr", """SELECT seq_id, image_rank AS "interval", ch, image AS "start", length, "start" AS image, "interval" AS image_rank FROM lfr"""),
    "blf": ("brle", """SELECT seq_id, run AS "interval", ch, "start", length, (sum(length) OVER (ORDER BY ch, run) - length)::BIGINT AS image FROM brle"""),
    "cap": ("blf", f"""SELECT (2 ** length(ltrim(bin(ceil(sum(length) / count(*) * {FACTOR})::BIGINT), '0')) - 1)::BIGINT AS m FROM blf"""),
    "cut": ("blf cap", """SELECT seq_id, row_number() OVER (ORDER BY run, k) - 1 AS "interval", ch, "start" + k * m AS "start", least(length - k * m, m) AS length, image + k * m AS image
        FROM (SELECT b.*, b."interval" AS run, m, unnest(range(0, (length - 1) // m + 1)) AS k FROM blf b, cap)"""),
    "cut_max": ("blf", f"""SELECT seq_id, row_number() OVER (ORDER BY run, k) - 1 AS "interval", run, whole, k * {LONGEST} AS spot, "start" + k * {LONGEST} AS "start", least(whole - k * {LONGEST}, {LONGEST}) AS length, image + k * {LONGEST} AS image, ch
        FROM (SELECT b.*, b."interval" AS run, length AS whole, unnest(range(0, (length - 1) // {LONGEST} + 1)) AS k FROM blf b)"""),
    "cap_default": ("blf", f"""SELECT (2 ** length(ltrim(bin(ceil(sum(length) / count(*) * {USUAL.length_capping})::BIGINT), '0')) - 1)::BIGINT AS m FROM blf"""),
    "cut_default": ("blf cap_default", """SELECT seq_id, row_number() OVER (ORDER BY run, k) - 1 AS "interval", "start" + k * m AS "start", least(length - k * m, m) AS length, image + k * m AS image
        FROM (SELECT b.*, b."interval" AS run, m, unnest(range(0, (length - 1) // m + 1)) AS k FROM blf b, cap_default)"""),
    "d5s": ("cut_max bpay", """SELECT c.*, p.val1, p.val2 FROM cut_max c JOIN bpay p USING (run)"""),
    "letters": ("", """SELECT seq_id, i, row_number() OVER (PARTITION BY seq_id ORDER BY ch, i) - 1 AS pi, count(*) OVER (PARTITION BY seq_id) AS n FROM (
        SELECT p_partkey AS seq_id, i, substring(p_name, i + 1, 1) AS ch FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM part))"""),
    "pay": ("rle", """SELECT r.run AS "interval", min(e.user_id) AS val1, max(e.user_id) AS val2 FROM rle r JOIN events e ON e.event_id >= r."start" AND e.event_id < r."start" + r.length GROUP BY r.run"""),
    "bpay": ("brle", """SELECT r.run AS run, min(e.user_id) AS val1, max(e.user_id) AS val2 FROM brle r JOIN events e ON e.event_id >= r."start" AND e.event_id < r."start" + r.length GROUP BY r.run"""),
    "d5": ("lfm pay", """SELECT m.*, p.val1, p.val2 FROM lfm m JOIN pay p USING ("interval")"""),
    "lf": ("sym", """SELECT seq_id, i, row_number() OVER (ORDER BY ch, i) - 1 AS pi, ch FROM sym"""),
    "suffixes": ("", """SELECT p_partkey AS seq_id, p_name || chr(1) AS text, unnest(range(0, length(p_name) + 1)) AS sa FROM part"""),
    "bwt": ("suffixes", """SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY substring(text, sa + 1)) - 1 AS i, substring(text, CASE WHEN sa = 0 THEN length(text) ELSE sa END, 1) AS ch, sa FROM suffixes"""),
    "more_suffixes": ("", f"""SELECT p_partkey AS seq_id, repeat(p_name, {REPEATS}) || chr(1) AS text, unnest(range(0, length(p_name) * {REPEATS} + 1)) AS sa FROM part"""),
    "more_bwt": ("more_suffixes", """SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY substring(text, sa + 1)) - 1 AS i, substring(text, CASE WHEN sa = 0 THEN length(text) ELSE sa END, 1) AS ch, sa FROM more_suffixes"""),
    "phi": ("bwt", """SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY sa) - 1 AS "interval", sa AS "start", coalesce(lead(sa) OVER (PARTITION BY seq_id ORDER BY sa), n) - sa AS length, image FROM (
        SELECT seq_id, i, sa, ch, count(*) OVER (PARTITION BY seq_id) AS n, lag(ch) OVER w AS other, coalesce(lag(sa) OVER w, last_value(sa) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS image
        FROM bwt WINDOW w AS (PARTITION BY seq_id ORDER BY i)) WHERE ch IS DISTINCT FROM other"""),
    "phi_inv": ("bwt", """SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY sa) - 1 AS "interval", sa AS "start", coalesce(lead(sa) OVER (PARTITION BY seq_id ORDER BY sa), n) - sa AS length, image FROM (
        SELECT seq_id, i, sa, ch, count(*) OVER (PARTITION BY seq_id) AS n, lead(ch) OVER w AS other, coalesce(lead(sa) OVER w, first_value(sa) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS image
        FROM bwt WINDOW w AS (PARTITION BY seq_id ORDER BY i)) WHERE ch IS DISTINCT FROM other"""),
    "bench": ("", """SELECT item_id AS seq_id, text || chr(1) AS text, unnest(range(0, length(text) + 1)) AS sa FROM benchmark"""),
    "bench_bwt": ("bench", """SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY substring(text, sa + 1)) - 1 AS i, substring(text, CASE WHEN sa = 0 THEN length(text) ELSE sa END, 1) AS ch, sa FROM bench"""),
}

PARTS |= {f"more_{name}": ("more_bwt", PARTS[name][1].replace("FROM bwt", "FROM more_bwt")) for name in ("phi", "phi_inv")}


def _needs(name: str, seen: list[str]) -> None:
    for part in PARTS[name][0].split():
        _needs(part, seen)
    if name not in seen:
        seen.append(name)


def _sql(parts: str, select: str, recursive: str = "") -> str:
    seen: list[str] = []
    for part in parts.split():
        _needs(part, seen)
    own = [f"{name} AS ({PARTS[name][1]})" for name in seen] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(own)} {select}"


def _walk(perm: str, k: int) -> str:
    return f"walk AS (SELECT i AS origin, i AS spot, 0 AS k FROM {perm} UNION ALL SELECT w.origin, p.pi, w.k + 1 FROM walk w JOIN {perm} p ON w.spot = p.i WHERE w.k < {k})"


_INTERVAL = 'seq_id, "interval", "start", length, image'
_MOVE = f"{_INTERVAL}, pointer, off"


def _width(value: str) -> str:
    return f"greatest(1, length(ltrim(bin(({value})::BIGINT), '0')))::BIGINT"


def _point(move: str) -> str:
    return f'SELECT x.*, b."interval" AS "interval", x.idx - b."start" AS off FROM x ASOF JOIN {move} b ON x.seq_id = b.seq_id AND x.idx >= b."start"'


def _find(column: str, value: str, ahead: bool, table: str = "d5") -> str:
    agg, compare, off = ("min", ">=", "0") if ahead else ("max", "<=", "b.length - 1")
    return f"""SELECT a."interval", a.found AS found_interval, CASE WHEN a.found IS NULL THEN NULL WHEN a.found = a."interval" THEN 0 ELSE {off} END::BIGINT AS found_off
        FROM (SELECT c."interval", (SELECT {agg}(m."interval") FROM {table} m WHERE m.{column} = c.value AND m."interval" {compare} c."interval") AS found FROM (SELECT "interval", {value} AS value FROM {table}) c) a
        LEFT JOIN {table} b ON b."interval" = a.found"""


def _placed(found: str) -> str:
    return f"""SELECT f."interval" AS "from", f.found_interval, f.found_off AS off, b."start" + f.found_off AS idx FROM ({found}) f JOIN d5s b ON b."interval" = f.found_interval"""


_CHUNKS = "SELECT p_partkey AS seq_id, part, substring(p_name, part * 5 + 1, 5) AS text FROM (SELECT *, unnest(range(0, (length(p_name) + 4) // 5)) AS part FROM part)"
_LETTERS_WALK = "walk AS (SELECT seq_id, 0::BIGINT AS step, 0::BIGINT AS i FROM letters WHERE i = 0 UNION ALL SELECT w.seq_id, w.step + 1, l.pi FROM walk w JOIN letters l ON w.seq_id = l.seq_id AND w.i = l.i WHERE w.step + 1 < l.n)"
_PHI_MOVE = """SELECT a.seq_id, a."interval", a."start", a.length, a.image, b."interval" AS pointer, a.image - b."start" AS off FROM {0} a ASOF JOIN {0} b ON a.seq_id = b.seq_id AND a.image >= b."start" """

ORACLE_SQL = {
    "q_runs": _sql("runs", f"SELECT {_INTERVAL} FROM runs"),
    "q_sum_and_max": _sql("runs", "SELECT seq_id, sum(length)::BIGINT AS domain, max(length) AS max_length FROM runs GROUP BY seq_id"),
    "q_inverse": _sql("perm", "SELECT seq_id, pi AS i, i AS pi FROM perm"),
    "q_is_permutation": _sql("perm", "SELECT seq_id, count(DISTINCT pi) = count(*) AND min(pi) = 0 AND max(pi) = count(*) - 1 AS ok FROM perm GROUP BY seq_id"),
    "q_starts_lengths": _sql("rle", 'SELECT seq_id, run AS "interval", "start", length FROM rle'),
    "q_image_rank": _sql("ranked", 'SELECT seq_id, "interval", image_rank FROM ranked'),
    "q_image_rank_inverse": _sql("ranked", 'SELECT seq_id, image_rank AS rank, "interval" AS visited FROM ranked'),
    "q_encodings": _sql("ranked", f"SELECT {_INTERVAL}, image_rank FROM ranked"),
    "q_move_table": _sql("move", f"SELECT {_MOVE} FROM move"),
    "q_store_roundtrip": _sql("move", f"SELECT {_MOVE} FROM move"),
    "q_violations": "SELECT 0::BIGINT AS broken",
    "q_widths": _sql("d5", f"""SELECT seq_id, {_width('max(length)')} AS w_length, {_width('sum(length) - 1')} AS w_start, {_width('max("interval")')} AS w_pointer, {_width('max(length)')} AS w_off, {_width('count(DISTINCT ch) - 1')} AS w_ch,
        {_width('max(val1)')} AS w_val1, {_width('max(val2)')} AS w_val2 FROM d5 GROUP BY seq_id"""),
    "q_bits_needed": _sql("d5", f"""SELECT seq_id, bits, (bits + 7) // 8 AS bytes FROM (SELECT seq_id, ({_width('max(length)')} * 2 + {_width('max("interval")')} + {_width('count(DISTINCT ch) - 1')} + {_width('max(val1)')} + {_width('max(val2)')}) * count(*) AS bits FROM d5 GROUP BY seq_id)"""),
    "q_stats": _sql("blf cut", 'SELECT 0::BIGINT AS seq_id, (SELECT count(*) FROM blf) AS runs, count(*) AS intervals, sum(length)::BIGINT AS domain, max(length) AS max_length, sum(length) / (SELECT count(*) FROM blf) AS n_over_r FROM cut'),
    "q_split_cap": _sql("cut", f"SELECT {_INTERVAL} FROM cut"),
    "q_split_max": _sql("cut_max", f"SELECT {_INTERVAL} FROM cut_max"),
    "q_split_balancing": _sql("blf", f"SELECT {_INTERVAL} FROM blf"),
    "q_split_move": _sql("cut", 'SELECT a.seq_id, a."interval", a."start", a.length, a.image, b."interval" AS pointer, a.image - b."start" AS off, a.ch FROM cut a ASOF JOIN cut b ON a.seq_id = b.seq_id AND a.image >= b."start"'),
    "q_split_payload": _sql("cut_max bpay", 'SELECT c.seq_id, c."interval", c."start", c.length, c.ch, p.val1, p.val2 FROM cut_max c JOIN bpay p USING (run)'),
    "q_split_callback": _sql("cut_max", 'SELECT seq_id, "interval", "start", length, run AS origin, spot * 1000 + length AS part, whole - spot - length AS rest FROM cut_max'),
    "q_split_same": _sql("blf", 'SELECT seq_id, "start" + k AS i, image + k AS pi FROM (SELECT *, unnest(range(0, length)) AS k FROM blf)'),
    "q_next": _sql("perm runs", f"""SELECT i, idx AS next_i, "interval", off FROM ({_point("runs")})""", "x AS (SELECT seq_id, i, pi AS idx FROM perm)"),
    "q_next_k": _sql("perm runs", f'SELECT r."interval" AS "from", w.spot AS "to" FROM walk w JOIN runs r ON w.origin = r."start" WHERE k = {STEPS}', _walk("perm", STEPS)),
    "q_power": _sql("perm", f"SELECT 0::BIGINT AS seq_id, origin AS i, spot AS pi FROM walk WHERE k = {LF_STEPS}", _walk("perm", LF_STEPS)),
    "q_lf_k": _sql("lf", f"SELECT 0::BIGINT AS seq_id, origin AS i, spot AS pi FROM walk WHERE k = {LF_STEPS}", _walk("lf", LF_STEPS)),
    "q_up": _sql("runs", """SELECT a."interval" AS "from", b."interval", b.length - 1 AS off FROM runs a JOIN runs b ON b."interval" = CASE WHEN a."interval" = 0 THEN (SELECT max("interval") FROM runs) ELSE a."interval" - 1 END"""),
    "q_down": _sql("runs", """SELECT "interval" AS "from", CASE WHEN "interval" = (SELECT max("interval") FROM runs) THEN 0 ELSE "interval" + 1 END AS "interval", 0::BIGINT AS off FROM runs"""),
    "q_first_last": _sql("runs", """SELECT seq_id, 0::BIGINT AS "interval", 0::BIGINT AS off, 0::BIGINT AS idx, 'first' AS which FROM runs WHERE "interval" = 0
        UNION ALL SELECT seq_id, "interval", length - 1, "start" + length - 1, 'last' FROM runs WHERE "interval" = (SELECT max("interval") FROM runs)"""),
    "q_position": _sql("sym lfr", f"""SELECT idx, "interval", off FROM ({_point("lfr")})""", "x AS (SELECT seq_id, i AS idx FROM sym)"),
    "q_position_idx": _sql("lfr", 'SELECT "interval", "start" + length - 1 AS idx FROM lfr'),
    "q_intervals": _sql("d5", 'SELECT "interval", "start", length, ch, val1, val2 FROM d5'),
    "q_pred": _sql("d5", _find("val1", "val2", False)),
    "q_succ": _sql("d5", _find("val1", "val2", True)),
    "q_pred_char": _sql("d5", _find("ch", "'click'", False)),
    "q_succ_char": _sql("d5", _find("ch", "'click'", True)),
    "q_alphabet": _sql("sym", "SELECT seq_id, ch, row_number() OVER (ORDER BY ch) - 1 AS code, cnt FROM (SELECT seq_id, ch, count(*) AS cnt FROM sym GROUP BY seq_id, ch)"),
    "q_map": _sql("sym", "SELECT i, dense_rank() OVER (ORDER BY ch) - 1 AS code, ch FROM sym"),
    "q_complement": _sql("sym", "SELECT i, strpos('ACGTN', b)::BIGINT + 1 AS code, b AS base, translate(b, 'ACGT', 'TGCA') AS complement FROM (SELECT i, upper(substring('acGTN', length(ch) % 5 + 1, 1)) AS b FROM sym)"),
    "q_bit_functions": f"""SELECT v, w AS width, (v + 6) // 7 AS sevenths, (2 ** w)::BIGINT AS power, (2 ** w)::BIGINT - 1 AS top, ((2 ** w)::BIGINT - 1) * 8 AS mask, v * 8 AS bits, (v + 7) // 8 AS bytes
        FROM (SELECT o_orderkey AS v, {_width('o_orderkey')} AS w FROM orders)""",
    "q_rle": _sql("rle", "SELECT seq_id, run, ch, length FROM rle"),
    "q_char_counts": _sql("rle", """SELECT seq_id, ch, heads, cnt, max_length, coalesce(sum(cnt) OVER w, 0)::BIGINT AS before, coalesce(sum(heads) OVER w, 0)::BIGINT AS heads_before
        FROM (SELECT seq_id, ch, count(*) AS heads, sum(length)::BIGINT AS cnt, max(length) AS max_length FROM rle GROUP BY seq_id, ch) WINDOW w AS (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "q_lf_images": _sql("lfr", 'SELECT seq_id, "interval", ch, "start", length, image, image_rank, head_rank FROM lfr'),
    "q_lf": _sql("lf", "SELECT seq_id, i, pi, ch FROM lf"),
    "q_lf_move": _sql("lfm", f"SELECT {_MOVE}, ch, dense_rank() OVER (ORDER BY ch) - 1 AS code FROM lfm"),
    "q_fl_runs": _sql("flr", f"SELECT {_INTERVAL}, image_rank, ch FROM flr"),
    "q_fl": _sql("lf", "SELECT seq_id, pi AS i, i AS pi, ch FROM lf"),
    "q_fl_move": _sql("flr", 'SELECT a.seq_id, a."interval", a."start", a.length, a.image, b."interval" AS pointer, a.image - b."start" AS off, a.ch FROM flr a ASOF JOIN flr b ON a.seq_id = b.seq_id AND a.image >= b."start"'),
    "q_bwt": _sql("bwt", "SELECT seq_id, i, ch, sa FROM bwt"),
    "q_suffix_array": _sql("bench_bwt", "SELECT seq_id, i, sa FROM bench_bwt"),
    "q_bwt_long": _sql("bench_bwt", "SELECT seq_id, i, ch, sa FROM bench_bwt"),
    "q_phi": _sql("phi", f"SELECT {_INTERVAL} FROM phi"),
    "q_phi_inv": _sql("phi_inv", f"SELECT {_INTERVAL} FROM phi_inv"),
    "q_phi_rank": _sql("phi", 'SELECT seq_id, "interval", length, row_number() OVER (PARTITION BY seq_id ORDER BY image) - 1 AS image_rank FROM phi'),
    "q_phi_inv_rank": _sql("phi_inv", 'SELECT seq_id, "interval", length, row_number() OVER (PARTITION BY seq_id ORDER BY image) - 1 AS image_rank FROM phi_inv'),
    "q_phi_move": _sql("phi", _PHI_MOVE.format("phi")),
    "q_phi_inv_move": _sql("phi_inv", _PHI_MOVE.format("phi_inv")),
    "q_phi_move_repeats": _sql("more_phi", _PHI_MOVE.format("more_phi")),
    "q_phi_inv_move_repeats": _sql("more_phi_inv", _PHI_MOVE.format("more_phi_inv")),
    "q_chunks_lf": _CHUNKS,
    "q_chunks_fl": _CHUNKS,
    "doc_text_lf": "SELECT doc_id AS seq_id, text FROM documents WHERE text != ''",
    "doc_text_fl": "SELECT doc_id AS seq_id, text FROM documents WHERE text != ''",
    "doc_single_cycle": "SELECT doc_id AS seq_id, true AS ok FROM documents",
    "q_violations_null": _sql("runs", 'SELECT count(*) AS broken FROM runs WHERE "interval" % 5 IN (2, 3)'),
    "q_power_table": _sql("perm", """SELECT 0::BIGINT AS seq_id, min(i) AS "start", count(*) AS length, min(pi) AS image FROM (
        SELECT *, sum(brk) OVER (ORDER BY i) AS run FROM (SELECT origin AS i, spot AS pi, CASE WHEN lag(spot) OVER (ORDER BY origin) = spot - 1 THEN 0 ELSE 1 END AS brk FROM walk WHERE k = """ + str(LF_STEPS) + """)) GROUP BY run""", _walk("perm", LF_STEPS)),
    "q_split_callback_python": _sql("cut_max", 'SELECT seq_id, "interval", "start", length, run AS origin, spot * 1000 + length AS part, whole - spot - length AS rest FROM cut_max'),
    "q_position_search": _sql("sym lfr", f"""SELECT idx, "interval", off FROM ({_point("lfr")})""", "x AS (SELECT seq_id, i AS idx FROM sym)"),
    "q_store_points": _sql("move", f'SELECT {_MOVE} FROM move WHERE "interval" % 97 = 0'),
    "q_store_about": _sql("blf cut", f"SELECT (SELECT count(*) FROM cut) AS rows, (SELECT count(*) FROM blf) AS runs, (SELECT sum(length)::BIGINT FROM cut) AS domain, {FACTOR}::DOUBLE AS length_capping, NULL::BIGINT AS balancing"),
    "q_file_bytes": _sql("sym", "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(ch || chr(10), '')) AS ch FROM sym) GROUP BY ch"),
    "q_text_lf": "SELECT p_partkey AS seq_id, p_name AS text FROM part WHERE p_name != ''",
    "q_text_fl": "SELECT p_partkey AS seq_id, p_name AS text FROM part WHERE p_name != ''",
    "q_sa_phi": _sql("bwt", "SELECT seq_id, i, sa FROM bwt"),
    "q_sa_phi_inv": _sql("bwt", "SELECT seq_id, i, sa FROM bwt"),
    "q_violations_broken": _sql("runs", 'SELECT count(*) AS broken FROM runs WHERE "interval" % 7 = 3'),
    "q_split_default": _sql("cut_default", 'SELECT a.seq_id, a."interval", a."start", a.length, a.image, b."interval" AS pointer, a.image - b."start" AS off FROM cut_default a ASOF JOIN cut_default b ON a.seq_id = b.seq_id AND a.image >= b."start"'),
    "q_same_position": _sql("move", 'SELECT "interval" AS "from", pointer = "interval" AND off = 0 AS same FROM move'),
    "q_pred_split": _sql("d5s", _placed(_find("ch", "'click'", False, "d5s"))),
    "q_succ_split": _sql("d5s", _placed(_find("ch", "'click'", True, "d5s"))),
    "q_phi_next": _sql("phi", """SELECT x.seq_id, x.origin AS "from", b."interval", x.idx - b."start" AS off, x.idx FROM x ASOF JOIN phi b ON x.seq_id = b.seq_id AND x.idx >= b."start" """, 'x AS (SELECT seq_id, "interval" AS origin, image AS idx FROM phi)'),
    "q_cycle_order_any": _sql("letters", "SELECT seq_id, step, i FROM walk", _LETTERS_WALK),
    "q_single_cycle_any": _sql("letters", "SELECT l.seq_id, count(DISTINCT w.i) = max(l.n) AS ok FROM letters l LEFT JOIN walk w ON l.seq_id = w.seq_id AND l.i = w.i GROUP BY l.seq_id", _LETTERS_WALK),
    "q_cycle_order": _sql("bwt", "SELECT seq_id, count(*) OVER (PARTITION BY seq_id) - 1 - sa AS step, i FROM bwt"),
    "q_single_cycle": "SELECT p_partkey AS seq_id, true AS ok FROM part",
    "q_payload": _sql("d5", """SELECT y.origin AS "from", y."interval", y.off, y.idx, t.ch, t.val1, t.val2 FROM (SELECT x.*, b."interval" AS "interval", x.idx - b."start" AS off FROM x ASOF JOIN d5 b ON x.seq_id = b.seq_id AND x.idx >= b."start") y JOIN d5 t USING ("interval")""", 'x AS (SELECT seq_id, "interval" AS origin, image AS idx FROM d5)'),
    "q_separate_payload": _sql("d5", 'SELECT "interval", pointer, off, ch, val1, val2 FROM d5'),
}
