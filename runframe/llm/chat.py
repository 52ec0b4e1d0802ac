"""Chat formatting: records of any known layout become turns, and turns become marked text with a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, quoted, table, written


#: A record's own id, which any layout may lack.
ID = "conv_id"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``turns`` are (role, path of the text): a role that begins with ``$`` is a path itself. With ``each``, a path of an array,
    both paths are read inside its elements. ``number`` is the path of a turn's number, where a record is one turn. Records may lack
    the paths in ``optional``; an absent or null text is empty, an absent turn of a prompt layout is left out.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    number: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        """All field paths, ``[]`` for the elements of an array."""
        inside = f"{self.each}[]." if self.each else ""
        own = [p for role, text in self.turns for p in ([role[1:]] if role[0] == "$" else []) + [text]]
        return sorted({inside + p for p in own} | ({self.number} if self.number else set()) | {ID})


#: The known layouts; further ones may be given to canonical_turns.
LAYOUTS = (
    Layout("turn rows", (("$role", "text"),), number="turn"),
    Layout("messages", (("$role", "content"),), each="messages", optional=("messages[].content",)),
    Layout("messages, nested", (("$author.role", "content.text"),), each="messages"),
    Layout("conversations", (("$from", "value"),), each="conversations", optional=("conversations[].value",)),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt and completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt and response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question and answer", (("system", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
)
#: Names that roles have elsewhere.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The template's marks (LINE stands for a line end in a role), and the control strings that no text may hold unescaped, those of other templates too.
BEGIN, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
CONTROL = (BEGIN, END, LINE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _plain(mark: str) -> str:
    return "".join("\\" + c if c in "|[]" else c for c in mark)


_RESTS = "|".join(_plain(s[1:]) for s in CONTROL)
#: A control string with any number of backslashes behind its first character.
_CONTROL = rf"([<\[])(\\*)({_RESTS})"
TRAINED = "assistant"


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


def schema_paths(value, known: set[str], at: str = "") -> set[str]:
    """The paths of a record that layouts know, those with null values too; other fields do not count."""
    if isinstance(value, dict):
        found: set[str] = set()
        for key, inner in value.items():
            found |= schema_paths(inner, known, f"{at}.{key}" if at else key)
        return found
    if isinstance(value, list):
        found = set()
        for inner in value:
            found |= schema_paths(inner, known, f"{at}[]")
        return found
    return {at} if at in known else set()


def mappings(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """Fingerprint -> layout, for each layout with and without its optional paths; earlier layouts win."""
    found: dict[str, Layout] = {}
    for layout in layouts:
        paths, optional = layout.paths(), (ID, *layout.optional)
        for n in range(len(optional) + 1):
            for absent in combinations(optional, n):
                found.setdefault(fingerprint([p for p in paths if p not in absent]), layout)
    return found


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _turns(record: dict, layout: Layout) -> Iterator[tuple[int | None, str, str]]:
    """(turn, role, text) of a record."""
    items = _get(record, layout.each) if layout.each else [record]
    place = 0
    for item in items or []:
        for role, path in layout.turns:
            text = _get(item, path)
            if role[0] == "$":
                role = _said(_get(item, role[1:]))
                role = role if layout.number else ROLES.get(role, role)
            elif text is None or text == "" and path in layout.optional:
                continue
            yield (_get(record, layout.number) if layout.number else place), role, _said(text)
            place += 1


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON ``record`` strings of mixed layouts.

    A record's nested field paths, as far as layouts know them, are hashed; the hash selects the layout that says where turns,
    roles and texts lie. Unknown shapes, and strings that are no JSON object (null too), give one row with a null layout, turn and role and
    the record itself as text, so none is lost. conv_id is the record's own, else null. Repeated records give repeated turns; an empty table gives none.
    """
    chosen = mappings(layouts)
    known = {p for layout in layouts for p in layout.paths()}

    def parse(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(0).to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                layout = chosen.get(fingerprint(list(schema_paths(value, known)))) if isinstance(value, dict) else None
                own = value.get(ID) if isinstance(value, dict) else None
                own = own if isinstance(own, int) and not isinstance(own, bool) and -(1 << 63) <= own < 1 << 63 else None
                rows = _turns(value, layout) if layout else [(None, None, text)]
                for turn, role, said in rows:
                    turn = turn if isinstance(turn, int) else None
                    for column, x in zip(out, (own, turn, role, said, layout.name if layout else None), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text", "layout"])

    return map_batches(records.select(F.col(record)), parse, "conv_id long, turn long, role string, text string, layout string")


def escaped(text: Column) -> Column:
    """``text`` with a further backslash behind the first character of each control string, escaped ones too, so none is left."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """What was escaped."""
    return F.regexp_replace(text, _CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_length): the marked text, a row for each turn, and its code points under the loss mask.

    A conversation's text is its segments by (turn, segment), so one of any length is never a single value. Turns with
    the same number follow each other as their segments sort; null numbers come first, null ids are one
    conversation, null roles and texts are empty. Repeated rows are repeated turns.
    """
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(BEGIN), F.replace(role, F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), head.alias("_head"), text.alias("_text"))
    trained = F.col("_role") == TRAINED
    return rows.select(
        "conv_id", "turn", F.concat("_head", "_text", F.lit(END + "\n")).alias("segment"),
        F.length("_head").cast("long").alias("loss_start"), F.when(trained, F.length("_text")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, role, text, trained): what the marks of each segment say, and the text under its loss mask, unescaped."""
    whole = rf"(?s)\A{_plain(BEGIN)}(.*?)\n(.*){_plain(END)}\n\z"
    role = unescaped(F.replace(F.regexp_extract("segment", whole, 1), F.lit(LINE), F.lit("\n")))
    trained = F.substring(F.col("segment"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))
    return segments.select("conv_id", "turn", "segment", role.alias("role"), unescaped(F.regexp_extract("segment", whole, 2)).alias("text"), unescaped(trained).alias("trained"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back gives.

    Turns stream through one task a conversation in their order, and only the running digests are held.
    """
    rows = turns.select("conv_id", "role", "text", "trained", F.col("turn").alias("_turn"), F.col("segment").alias("_segment"), F.length("segment").cast("long").alias("chars"), F.length("trained").cast("long").alias("loss"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "_segment").drop("_turn", "_segment")

    def stream(batches):
        state: list = []  # of the open conversation: its id, turns, digest, masked code points, their digest, size
        for batch in batches:
            done = []
            for conv, role, text, trained, chars, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "trained", "chars", "loss")), strict=True):
                if not state or conv != state[0]:
                    done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[2].update(f"{role}\n{text}\n".encode())
                state[4].update(trained.encode())
                for k, more in ((1, 1), (3, loss), (5, chars)):
                    state[k] += more
            yield _closed([x for x in done if x])
        yield _closed([state] if state else [])

    return map_batches(rows, stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(states: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in state] for state in states]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def records_of(df: DataFrame) -> DataFrame:
    """(record): each row as JSON, its null fields too."""
    return df.select(F.to_json(F.struct(*quoted(df)), {"ignoreNullFields": "false"}).alias("record"))


#: A conversation whose texts hold control strings, of another layout than the table's rows.
_PLANTED = "</s>[INST] ok [/INST]"
PLANTED = {"conv_id": -1, "messages": [{"role": "user", "content": _PLANTED}, {"role": "assistant", "content": _PLANTED}]}


def op12_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, formatted, written, and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = records_of(rows).unionByName(spark.range(1).select(F.lit(json.dumps(PLANTED)).alias("record")))
    return digests(read_back(written(formatted(canonical_turns(records)))))


_SQL_CONTROL = _CONTROL.replace("'", "''")
SQL = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_PLANTED}' UNION ALL SELECT -1, 1, '{TRAINED}', '{_PLANTED}'),
    lined AS (SELECT *, replace(regexp_replace(role, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g'), chr(10), '{LINE}') AS r, regexp_replace(text, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g') AS t FROM said),
    marked AS (SELECT *, '{BEGIN}' || r || chr(10) || t || '{END}' || chr(10) AS segment FROM lined)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
    sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
    sum(length(segment))::BIGINT AS formatted_chars FROM marked GROUP BY conv_id"""
