"""Chat formatting: turns rendered by a template that is only called, with spans found by comparing its outputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
HEAD, FOOT = "### ", "\n</turn>\n"


def escape(text: str) -> str:
    """A text in which neither ``#`` runs nor closing tags of the template can occur, from which it can be read back."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_template(turns: Sequence[Turn]) -> str:
    """``### role:``, the escaped text and ``</turn>``, each on lines of its own."""
    return "".join(f"{HEAD}{_role(role)}:\n{escape(text)}{FOOT}" for role, text in turns)


def _role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\\n")


_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\])*?)\n</turn>\n", re.DOTALL)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text made by ``turn_template``."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def locate(turns: Sequence[Turn], template: Template) -> tuple[str, list[dict], bool]:
    """(formatted text, spans, whether the template rewrites history) of one conversation.

    The prefixes of one turn, two turns and so on are rendered in turn. What an output adds to the one before is the
    turn's span; the place of the text inside comes from rendering the same prefix with a character that
    occurs nowhere in place of the turn's text. If an output does not go on from the one before, the template
    rewrites history: then every turn is located in the final output alone.
    """
    used = {c for role, text in turns for c in role + text}
    mark = next(chr(c) for c in range(0xE000, 0x10FFFF) if chr(c) not in used)
    before, spans = template([]), []
    rewrites = False
    for k, (role, _) in enumerate(turns, 1):
        now = template(turns[:k])
        if not now.startswith(before):
            rewrites = True
            break
        found = _inside(now, template([*turns[: k - 1], (role, mark)]), mark)
        spans.append({"role": role, "start": len(before), "end": len(now), **found})
        before = now
    if not rewrites:
        return before, spans, False
    final, spans = template(turns), []
    for i, (role, _) in enumerate(turns):
        found = _inside(final, template([*turns[:i], (role, mark), *turns[i + 1 :]]), mark)
        spans.append({"role": role, "start": found["text_start"], "end": found["text_end"], **found})
    return final, spans, True


def _inside(output: str, probe: str, mark: str) -> dict:
    """Where the text lies in the output, given the output for the mark; none if the template shows it not just once."""
    at = probe.find(mark)
    if at < 0 or probe.count(mark) > 1:
        return {"text_start": None, "text_end": None}
    tail = probe[at + 1 :]
    end = len(output) - len(tail)
    if end < at or output[:at] != probe[:at] or output[end:] != tail:
        return {"text_start": None, "text_end": None}
    return {"text_start": at, "text_end": end}


SPANS = "array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>"


def format_conversations(
    rows: DataFrame,
    template: Template = turn_template,
    loss_roles: Sequence[str] = ("assistant",),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, spans, rewrites).

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty ones, and rows without a conversation id form one conversation with a null id.
    ``spans`` says for each turn where it and its text lie in ``formatted`` (in code points) and whether it is
    under the loss mask; the text span is null if the template drops or repeats the text. ``rewrites`` marks
    conversations in which the template changed what it had rendered for fewer turns. Extra columns are not
    read. A conversation is one output row and is rendered in one task; the work grows with the square of its turns.
    """
    order = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(order)).alias("turns"))
    columns = f"conv_id long, n_turns long, formatted string, spans {SPANS}, rewrites boolean"
    masked = set(loss_roles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())]))
        for b in batches:
            out = []
            for turns in b.column("turns").to_pylist():
                said = [(t["role"], t["text"]) for t in turns]
                text, spans, rewrites = locate(said, template)
                for s in spans:
                    s["loss"] = s["role"] in masked
                out.append((len(said), text, spans, rewrites))
            n, text, spans, rewrites = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(spans, kind), pa.array(rewrites, pa.bool_())],
                ["conv_id", "n_turns", "formatted", "spans", "rewrites"],
            )

    return grouped.mapInArrow(run, columns)


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from formatted conversations: turns, and the text under the loss mask, as counts and SHA-256."""
    columns = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                out.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *arrays, b.column("rewrites")], [c.split()[0] for c in columns.split(", ")])

    return formatted.mapInArrow(run, columns)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
