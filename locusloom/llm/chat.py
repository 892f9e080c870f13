"""Chat formatting: records of many layouts become canonical turns, turns become text of one template.

A record's schema fingerprint is the hash of its sorted nested field paths (lists count as ``[]``; what a value is
doesn't matter). The fingerprint selects a declarative mapping from ``MAPPINGS``: which fields hold the conversation's
name, a turn's number, its role and its text, or which fields follow each other as turns. Further layouts are further
entries. Fields that no mapping reads are set aside before the hash is taken, so further fields of a record don't
make its layout unknown.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break for each turn. Control strings of this
and of other common templates are escaped inside roles and texts by a backslash after their first character, and
backslashes are doubled, so every text comes back exactly. The loss mask covers the escaped texts of assistant turns.

Turns are formatted row by row; a conversation's parts are its rows in order of turn, so a long conversation never
has to fit into one value, and a reader folds them one after another.

Defined results: null texts and roles are empty. Turns that share a number go by role, then text; turns without a
number come first. A record without a name for its conversation is a conversation of its own, named by its hash and its
place among the records (so equal ones stay apart); only single turns (rows) without a name belong together, to the name null. Records that
are no JSON, no object, nested beyond reading, or of an unknown layout, or whose turns are no objects, come out with the mapping ``unknown`` and no
turns (``rejected``). A conversation's digest is folded by one task in the order of its turns, as a running hash can't be cut; its texts pass through one by
one. Very long texts are one turn each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import partitions, small_batches

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The beginnings of control strings, here and in other common templates.
_CONTROL = re.compile(r"\\|<(?=\||/?s>|/?SYS>|<SYS>|</SYS>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")

#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``turns`` lists (role, field) of a record, or ``each`` names a list of turns
    (empty: the record is a turn itself) whose ``role`` and ``text`` fields are read. ``optional`` fields may be missing."""

    name: str
    key: str = "conv_id"
    each: str | None = None
    number: str = "turn"
    role: str = "role"
    text: str = "text"
    turns: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    keep_roles: bool = False

    def layouts(self) -> Iterator[frozenset[str]]:
        """The sets of field paths that this mapping reads."""
        if self.turns:
            fields = [self.key, *[f for _, f in self.turns]]
        elif self.each:
            fields = [self.key, *[f"{self.each}[].{f}" for f in (self.role, self.text)]]
        else:
            fields = [self.key, self.number, self.role, self.text]
        for drop in range(1 << len(self.optional)):
            gone = {f for i, f in enumerate(self.optional) if drop >> i & 1}
            yield frozenset(f for f in fields if f not in gone)


MAPPINGS = (
    Mapping("turn rows", keep_roles=True),
    Mapping("messages", each="messages", text="content", optional=("conv_id",)),
    Mapping("shared conversations", each="conversations", role="from", text="value", key="id", optional=("id",)),
    Mapping("prompt and completion", turns=(("user", "prompt"), ("assistant", "completion")), optional=("conv_id",)),
    Mapping("prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("conv_id", "system")),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
            optional=("conv_id", "system", "input")),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def schema_fingerprint(fields: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


#: All paths that mappings read; others don't count.
KNOWN = frozenset().union(*(layout for m in MAPPINGS for layout in m.layouts()))
BY_FINGERPRINT = {schema_fingerprint(layout): m for m in reversed(MAPPINGS) for layout in m.layouts()}


def _text(value) -> str:
    """A value as text; halves of surrogate pairs, which UTF-8 has no form for, become U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _number(value) -> int | None:
    """A turn's number; None where it is no whole number of 64 bits."""
    try:
        n = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if (n == value or isinstance(value, str)) and -2**63 <= n < 2**63 else None


def mapping_of(raw: str | None) -> tuple[dict, Mapping | None]:
    """A record and the mapping that its fingerprint selects; None for what can't be read."""
    try:
        record = json.loads(raw) if raw else None
        known = paths(record) & KNOWN if isinstance(record, dict) else set()
    except (ValueError, RecursionError):
        return {}, None
    mapping = BY_FINGERPRINT.get(schema_fingerprint(known))
    if mapping and mapping.each and not all(isinstance(row, dict) for row in record[mapping.each]):
        return record, None
    return record if isinstance(record, dict) else {}, mapping


def canonical(record: dict, mapping: Mapping) -> list[tuple[object, int | None, str, str]]:
    """(key, number, role, text) of each turn of a record."""
    key = record.get(mapping.key)
    if mapping.turns:
        present = [(role, record[field]) for role, field in mapping.turns if field in record]
        merged: list[list[str]] = []
        for role, value in present:  # instruction and input are one turn
            if merged and merged[-1][0] == role:
                merged[-1][1] += "\n\n" + _text(value) if value else ""
            else:
                merged.append([role, _text(value)])
        return [(key, i, role, text) for i, (role, text) in enumerate(merged)]
    rows = record[mapping.each] if mapping.each else [record]
    out = []
    for i, row in enumerate(rows):
        role = _text(row.get(mapping.role))
        out.append((key, i if mapping.each else _number(row.get(mapping.number)), role if mapping.keep_roles else ROLES.get(role, role), _text(row.get(mapping.text))))
    return out


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text and the span of its loss mask (empty for other roles than assistant)."""
    head = f"{START}{escape(role)}{SEPARATOR}"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *span


_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted turns."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def _map_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["mapping", "conv_id", "turn", "role", "text"]
    for batch in batches:
        out = []
        for raw, place in zip(batch["record"], batch["place"]):
            record, mapping = mapping_of(raw)
            if mapping is None:
                out.append(("unknown", None, None, None, None))
                continue
            own = None
            if mapping.turns or mapping.each:
                own = f"{hashlib.sha256(raw.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}-{place}"
            out += [(mapping.name, own if k is None else _text(k), n, role, text) for k, n, role, text in canonical(record, mapping)]
        yield pd.DataFrame(out, columns=columns).astype({"turn": "Int64"})


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """JSON records -> mapping, conv_id (text), turn, role, text; unknown layouts give one row with mapping ``unknown``."""
    small_batches(records.sparkSession)
    rows = records.select(F.col(record).alias("record"), F.monotonically_increasing_id().alias("place"))
    return rows.mapInPandas(_map_records, "mapping string, conv_id string, turn bigint, role string, text string")


def rejected(turns: DataFrame) -> DataFrame:
    return turns.filter("mapping = 'unknown'")


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [format_turn(r or "", t or "") for r, t in zip(batch["role"], batch["text"])]
        yield batch[["conv_id", "turn"]].assign(formatted=[m[0] for m in made], loss_start=[m[1] for m in made], loss_end=[m[2] for m in made])


def formatted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (code points of ``formatted``), in order within a conversation."""
    known = turns.filter("mapping <> 'unknown'")
    dealt = known.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "turn", "role", "text").mapInPandas(
        _format, "conv_id string, turn bigint, formatted string, loss_start int, loss_end int")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row():
        return key, n, turns.hexdigest(), loss, lost.hexdigest(), chars

    key = object()
    n = loss = chars = 0
    turns = lost = None
    for batch in batches:
        out = []
        for conv, text, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"]):
            if conv != key:
                if turns is not None:
                    out.append(row())
                key, n, loss, chars, turns, lost = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, said in read_turns(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(text[start:end])
            loss += len(masked)
            chars += len(text)
            lost.update(masked.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=columns)
    if turns is not None:
        yield pd.DataFrame([row()], columns=columns)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read back what ``formatted_turns`` made (in its order and partitions): counts and digests per conversation."""
    return formatted.mapInPandas(_digests, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records of the layout "turn rows"; other columns are left out."""
    own = F.struct("conv_id", "turn", "role", "text")
    return conversations.select(F.to_json(own, {"ignoreNullFields": "false"}).alias("record"))
