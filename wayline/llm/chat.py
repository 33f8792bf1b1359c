"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Rendering successive prefixes of a conversation and comparing
consecutive outputs locates each turn's span without knowing the template; an output that doesn't begin with the one
before shows a template that rewrites history. Within a span, two renderings with other texts show where the text stands.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of usual templates (fixed values); inside texts they are escaped.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile("|".join(f"(?:{re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in CONTROL))
#: Columns of places in the output of format_conversations.
PLACES = ["span_starts", "span_ends", "loss_starts", "loss_ends", "rewrites"]
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: str) -> str:
    """A backslash more between the first sign of each control string and its rest; strings that have backslashes there get one more, so this can be undone."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)


def escape_role(role: str) -> str:
    """As escape, and in one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def marked_turns(turns: list[Turn]) -> str:
    """The template of op4: each turn between marks, its role on the first line."""
    return "".join(f"{_OPEN}{role}\n{text}{_CLOSE}" for role, text in turns)


def parse_marked(formatted: str) -> list[Turn]:
    """The turns that marked_turns has rendered, unescaped."""
    out = []
    for part in formatted.split(_OPEN)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: -len(_CLOSE)])))
    return out


@dataclass
class Rendered:
    text: str
    #: of each turn: start and end of its span, and start and end of its text (equal to the span's end if the template leaves it out)
    spans: list[tuple[int, int, int, int]]
    #: turns whose rendering changed what stood before
    rewrites: list[int]


def _agree(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    return len(os.path.commonprefix((a, b)))


def render_incrementally(turns: list[Turn], template: Template) -> Rendered:
    """Render every prefix and locate its last turn in it. A template that rewrites history gets spans in the output of the
    whole conversation only for turns rendered since its last rewrite; those before are located by their last prefix."""
    before, spans, rewrites = "", [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites.append(k - 1)
            start = _agree(before, now)
        role, text = turns[k - 1]
        other = [template([*turns[: k - 1], (role, mark)]) for mark in ("\ue000x\ue001", "\ue002y\ue003")]
        head = _agree(*other)
        tail = _agree(other[0][::-1], other[1][::-1])
        at, to = head, len(now) - tail
        if other[0] == other[1] or to < at or now[at:to] != text:
            at = now.find(text, start) if text else start
            at, to = (at, at + len(text)) if at >= 0 else (len(now), len(now))
        spans.append((start, len(now), at, to))
        before = now
    return Rendered(before, spans, rewrites)


def _row(conv: object, turns: list[Turn], template: Template, learn: str) -> dict:
    safe = [(escape_role(r), escape(t)) for r, t in turns]
    out = render_incrementally(safe, template)
    loss = [(a, b) for (r, _), (_, _, a, b) in zip(turns, out.spans, strict=True) if r == learn]
    return {"conv_id": conv, "n_turns": len(turns), "formatted": out.text, "span_starts": [s[0] for s in out.spans], "span_ends": [s[1] for s in out.spans], "loss_starts": [a for a, _ in loss], "loss_ends": [b for _, b in loss], "rewrites": out.rewrites}


def format_conversations(df: DataFrame, template: Template = marked_turns, learn: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, span_starts, span_ends (of turns), loss_starts, loss_ends (of the texts of role learn), rewrites (turns at which the template changed earlier output).

    Turns are in turn order, null first; rows of one turn by role, then text, null first, repeated rows all kept. Null
    texts and roles are empty; rows of a null conversation are one conversation with a null id; ids keep their exact values. Positions count code
    points. Other columns aren't read. An empty table gives no rows. A conversation is rendered in one task, whose memory
    holds it and no other; rendering all prefixes takes time in proportion to its turns times its length.
    """
    common.ship(df.sparkSession)
    kind = df.schema[conv_col].dataType.simpleString()
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), df[role_col].alias("role"), df[text_col].alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, turns = False, None, []
        done: list[dict] = []
        held = 0
        for b in batches:
            out = pa.schema([("conv_id", b.schema.field(0).type), ("n_turns", pa.int64()), ("formatted", pa.string()), *((c, pa.list_(pa.int64())) for c in PLACES)])
            for c, r, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if began and c != conv:
                    done.append(_row(conv, turns, template, learn))
                    held += len(done[-1]["formatted"])
                    turns = []
                began, conv = True, c
                turns.append((r or "", t or ""))
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(done, out)
                    done, held = [], 0
        if began:
            done.append(_row(conv, turns, template, learn))
            yield pa.RecordBatch.from_pylist(done, out)

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, n_turns long, formatted string, {', '.join(c + ' array<bigint>' for c in PLACES)}")


def digests(formatted: DataFrame) -> DataFrame:
    """What op4 returns, read back from the output of format_conversations with marked_turns."""
    common.ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, ends in zip(*(x.to_pylist() for x in b.columns[1:]), strict=True):
                turns = parse_marked(text)
                all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss = "".join(unescape(text[a:z]) for a, z in zip(starts, ends, strict=True))
                out.append((len(turns), all_turns, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array([x[j] for x in out], t) for j, t in enumerate(kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
