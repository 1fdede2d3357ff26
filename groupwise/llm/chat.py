"""Chat formatting by schema fingerprints.

Records come as JSON in many layouts: prompt and response, instruction with optional input and system text, lists of messages, turn
rows. The fingerprint of a record is a hash of its nested field paths (list positions left out, sorted), of those that tell layouts
apart: paths that no mapping needs (ids, names, dates) and optional ones (input, system, the answer) are left out of it. It selects a declarative mapping, a
list of ``(path, role)`` steps, that turns the record into canonical turns. Missing and null fields are empty; texts that come as lists of
parts are joined, other values are written as JSON. A record that matches no mapping, or is no JSON object, becomes one turn of the role
``unknown`` that holds it as it is, so nothing is dropped.

The template writes a turn as ``### role: text</turn>`` and a line end. In texts the escape character, the turn mark and the end
mark get a backslash in front, so the output can be read back exactly; in roles the colon does too. The loss mask is the escaped text of assistant turns.

Null texts and null roles are empty. Rows of a conversation go by turn, then role and text (null turns first); rows that repeat
are turns of their own; a null id is one conversation of its own. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TURN, STOP, ESCAPE = "### ", "</turn>", "\\"
CONTROL = re.compile(r"\\|###|</turn>")
SCAN = re.compile(r"\\(\\|###|</turn>|:)|(</turn>)")
LOSS_ROLE = "assistant"

# A mapping lists where turns come from: (path of the list or None, paths of the text, role or path of the role).
# A role that starts with "$" is read from the record. The key holds the paths that tell the layout apart.
MAPPINGS: dict[tuple[str, ...], tuple[tuple, ...]] = {
    ("prompt",): ((None, ("system",), "system"), (None, ("prompt",), "user"), (None, ("response", "completion"), "assistant")),
    ("question",): ((None, ("system",), "system"), (None, ("question",), "user"), (None, ("answer",), "assistant")),
    ("instruction",): ((None, ("system",), "system"), (None, ("instruction", "input"), "user"), (None, ("output",), "assistant")),
    ("messages", "messages[].content"): (("messages", ("content",), "$role"),),
    ("conversations", "conversations[].value"): (("conversations", ("value",), "$from"),),
    ("turns", "turns[].text"): (("turns", ("text",), "$role"),),
    ("messages",): (("messages", ("content",), "$role"),),
    ("conversations",): (("conversations", ("value",), "$from"),),
    ("turns",): (("turns", ("text",), "$role"),),
}
TELLING = frozenset(p for paths in MAPPINGS for p in paths)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
UNKNOWN = "unknown"


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths; elements of a list share ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in {at and f"{at}.{k}" or k} | paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in {f"{at}[]"} | paths_of(v, f"{at}[]")}
    return set()


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def mapping_table() -> dict[str, tuple[tuple, ...]]:
    return {fingerprint(paths): steps for paths, steps in MAPPINGS.items()}


def layout_of(record) -> str:
    """The fingerprint of a record."""
    return fingerprint(paths_of(record) & TELLING)


def said(value) -> str:
    """A text field, however it is written: lists of parts are joined by line ends."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "\n".join(t for v in value if (t := said(v["text"] if isinstance(v, dict) and "text" in v else v)))
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record, table: dict[str, tuple[tuple, ...]]) -> list[tuple[str, str]]:
    """Canonical ``(role, text)`` turns of a record by the mapping of its fingerprint."""
    steps = table.get(layout_of(record)) if isinstance(record, dict) else None
    if steps is None:
        return [(UNKNOWN, said(record))]
    turns = []
    for where, texts, role in steps:
        items = [record] if where is None else record.get(where)
        for item in items if isinstance(items, list) else [] if items is None else [items]:
            fields = item if isinstance(item, dict) else {texts[0]: item}
            parts = [said(fields.get(p)) for p in texts]
            named = said(fields.get(role[1:])) if role.startswith("$") else role
            if where is None and role == "system" and not any(parts):
                continue
            turns.append((ROLES.get(named, named) if role == "$from" else named, "\n".join(p for p in parts if p)))
    return turns


def parsed(record: str | None):
    """A record as JSON; what is no JSON stays text, a null record has no turns."""
    if record is None:
        return {"turns": []}
    try:
        return json.loads(record)
    except ValueError:
        return record


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it under the loss mask (code points, ends exclusive)."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(':', ESCAPE + ':')}: ", escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{STOP}\n")
        at += len(out[-1])
    return "".join(out), mask


def unescape(text: str) -> str:
    return SCAN.sub(lambda m: m[1] if m[1] is not None else m[0], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        colon = re.compile(r"(?:[^\\:]|\\(?:\\|###|</turn>|:))*").match(formatted, at + len(TURN)).end()
        end = next(m for m in SCAN.finditer(formatted, colon + 2) if m[2])
        turns.append((unescape(formatted[at + len(TURN) : colon]), unescape(formatted[colon + 2 : end.start()])))
        at = end.end() + 1
    return turns


def records_of(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mixed: bool = False) -> DataFrame:
    """``id_col, record``: turn rows as one JSON record per conversation, ordered; what is moved is each row once.

    With ``mixed`` they are written in different layouts: single exchanges as prompt and response, the others by their id as messages, as
    conversations of human and gpt (where only the usual roles occur), or as turns.
    """
    item = F.struct(
        F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    grouped = rows.select(F.col(id_col), item.alias("i")).groupBy(id_col).agg(F.array_sort(F.collect_list("i")).alias("i"))

    def listed(name: str, role_name: str, text_name: str, written=lambda r: r):
        return F.to_json(F.struct(F.transform("i", lambda x: F.struct(written(x["role"]).alias(role_name), x["text"].alias(text_name))).alias(name)))

    record = listed("turns", "role", "text")
    if mixed:
        roles = F.transform("i", lambda x: x["role"])
        exchange = (F.size("i") == 2) & (F.get(roles, 0) == "user") & (F.get(roles, 1) == "assistant")
        pair = F.to_json(F.struct(F.get("i", 0)["text"].alias("prompt"), F.get("i", 1)["text"].alias("response"), F.col(id_col).alias("id")))
        usual = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
        written = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
        kind = F.pmod(F.xxhash64(id_col), F.lit(3))
        record = F.when(exchange, pair).when(kind == 0, listed("messages", "role", "content")).when((kind == 1) & usual, listed("conversations", "from", "value", written)).otherwise(record)
    return grouped.select(id_col, record.alias("record"))


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """``id_col, layout, formatted, loss_mask`` of every record. A null record has no turns and an empty output."""
    kind = records.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = mapping_table()
        for key, record in rows:
            data = parsed(record)
            formatted, mask = format_turns(turns_of(data, table))
            yield key, layout_of(data), formatted, [{"start": a, "end": b} for a, b in mask]

    schema = f"`{id_col}` {kind}, layout string, formatted string, loss_mask array<struct<start: int, end: int>>"
    return map_rows(records.select(F.col(id_col), F.col(record_col)), run, schema)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What :func:`read_back` finds in the output: turns, and the text under the mask."""
    kind = formatted.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text, mask in rows:
            turns = read_back(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
            yield key, len(turns), sha[0], len(loss), sha[1], len(text)

    schema = f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_rows(formatted.select(F.col(id_col), "formatted", "loss_mask"), run, schema)
