"""Chat formatting by schema fingerprints.

A record is a JSON object.  The set of its nested field paths, hashed, selects
a declarative mapping that names where its turns are; records of different
layouts so become the same canonical turns.  The template marks turns with
control strings, escapes these inside texts so that formatting can be undone,
and reports the character spans that a loss is taken over.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, session_for

BOS, OPEN, CLOSE, EOS, ESCAPE = "<s>", "[INST] ", " [/INST]", "</s>", "\\"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; array elements share the step ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}") for k, v in value.items())) if value else {prefix + ".{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(found: set[str]) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Declarative mappings: required field paths -> how to read turns.
#: "list" names the array of turns with its role and text fields; "fields" lists (role, path) in order.
LAYOUTS = [
    {"paths": {".messages[].role", ".messages[].content"}, "list": ("messages", "role", "content")},
    {"paths": {".messages[].role", ".messages[].text", ".messages[].turn"}, "list": ("messages", "role", "text"), "order": "turn"},
    {"paths": {".conversations[].from", ".conversations[].value"}, "list": ("conversations", "from", "value")},
    {"paths": {".instruction", ".input", ".output"}, "fields": [("user", ("instruction", "input")), ("assistant", ("output",))]},
    {"paths": {".instruction", ".output"}, "fields": [("user", ("instruction",)), ("assistant", ("output",))]},
    {"paths": {".prompt", ".response"}, "fields": [("user", ("prompt",)), ("assistant", ("response",))]},
    {"paths": {".system", ".prompt", ".response"}, "fields": [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))]},
    {"paths": {".prompt", ".completion"}, "fields": [("user", ("prompt",)), ("assistant", ("completion",))]},
    {"paths": {".question", ".answer"}, "fields": [("user", ("question",)), ("assistant", ("answer",))]},
]
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}


def canonical_turns(record) -> tuple[str, list[tuple[str, str]] | None]:
    """Fingerprint and (role, text) turns of a record; None where no mapping knows its layout.

    Fields that no mapping names are ignored: a record without its own mapping
    takes the one with the most paths that it has.  Null roles and texts are
    empty, other values that are no text stand as JSON; turns are ordered by
    number, then by text, then other values, nulls last.
    """
    found = paths(record)
    print_ = fingerprint(found)
    layout = MAPPINGS.get(print_) or max((x for x in LAYOUTS if x["paths"] <= found), key=lambda x: len(x["paths"]), default=None)
    if layout is None:
        return print_, None
    if "list" in layout:
        name, role, text = layout["list"]
        if not isinstance(record.get(name), list):  # a field whose name looks like a path
            return print_, None
        turns = [x for x in record[name] if isinstance(x, dict)]
        if "order" in layout:
            turns.sort(key=lambda x: (*_rank(x.get(layout["order"])), _text(x.get(role)), _text(x.get(text))))
        rename = ROLE_NAMES if name == "conversations" else {}
        return print_, [(rename.get(r := _text(x.get(role)), r), _text(x.get(text))) for x in turns]
    out = []
    for role, names in layout["fields"]:
        text = "\n".join(_text(record[n]) for n in names if record.get(n) is not None)
        out.append((role, text))
    return print_, out


def _rank(value) -> tuple:
    """Sort key of a turn's place: numbers, then texts, then other values by their JSON, then nulls."""
    if isinstance(value, (int, float)) and value == value:
        return (0, value, "")
    return (1, 0, value) if isinstance(value, str) else (3, 0, "") if value is None else (2, 0, _text(value))


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    """No control string remains; :func:`unescape` undoes it."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        if c in text:
            text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, i = [], 0
    while (j := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:j])
        if text[j + 1 : j + 2] == ESCAPE:
            out.append(ESCAPE)
            i = j + 2
        else:
            i = j + 1
    return "".join([*out, text[i:]])


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "n")


def unescape_role(role: str) -> str:
    out, i = [], 0
    while i < len(role):
        if role[i] == ESCAPE and role[i + 1 : i + 2] in (ESCAPE, "n"):
            out.append("\n" if role[i + 1] == "n" else ESCAPE)
            i += 2
        elif role[i] == ESCAPE:
            i += 1
        else:
            out.append(role[i])
            i += 1
    return "".join(out)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans of assistant texts in it (code points, end exclusive)."""
    parts, at, spans = [BOS], len(BOS), []
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((at, at + len(body)))
            part = body + EOS
        else:
            part = f"{OPEN}{escape_role(role)}\n{body}{CLOSE}"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    if not formatted.startswith(BOS):
        raise ValueError("no start mark")
    at, turns = len(BOS), []
    while at < len(formatted):
        if formatted.startswith(OPEN, at):
            end = formatted.index(CLOSE, at + len(OPEN))
            role, _, text = formatted[at + len(OPEN) : end].partition("\n")
            turns.append((unescape_role(role), unescape(text)))
            at = end + len(CLOSE)
        else:
            end = formatted.index(EOS, at)
            turns.append(("assistant", unescape(formatted[at:end])))
            at = end + len(EOS)
    return turns


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, loss_spans) of a table (conv_id, record JSON).

    ``layout`` is the schema fingerprint; a record that is null, no JSON
    object, nested too deeply to be read (layout null too), or of an unknown
    layout keeps its row with null formatted text.
    Repeated rows and null ids are kept, empty texts are turns of their own,
    fields that no mapping names are ignored, an empty table gives an empty
    result.  One pass without a shuffle.
    """
    session_for(records.sparkSession)

    def over(batch):
        prints, texts, masks = [], [], []
        for raw in batch.column(1).to_pylist():
            try:
                record = json.loads(raw) if raw is not None else None
                print_, turns = canonical_turns(record) if isinstance(record, dict) else (None, None)
            except (ValueError, RecursionError):
                print_, turns = None, None
            text, spans = render(turns) if turns is not None else (None, None)
            prints.append(print_), texts.append(text), masks.append(spans and [{"begin": a, "end": b} for a, b in spans])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield {"conv_id": batch.column(0), "layout": pa.array(prints, pa.string()), "formatted": pa.array(texts, pa.string()), "loss_spans": pa.array(masks, kind)}

    return arrow_map(records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")), over, "conv_id long, layout string, formatted string, loss_spans array<struct<begin:long,end:long>>")


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): the rows (conv_id, turn, role, text) of each conversation as one JSON record.

    Ties of ``turn`` are ordered by role and text.  A conversation is one
    output row, so its turns meet in one task.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.to_json(F.struct(F.collect_list(row).alias("messages")), {"ignoreNullFields": "false"}).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, computed from the formatted text and its loss spans alone."""

    def over(batch):
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None:
                rows.append((0, None, 0, None, 0))
                continue
            turns = parse(text)
            loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans or [])
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        yield {"conv_id": batch.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)}

    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), over, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
