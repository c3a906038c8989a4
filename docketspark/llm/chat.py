"""Chat formatting: a finite-state machine over roles and a declarative template.

The rows are dealt by conversation and sorted by turn; the machine then streams them. It holds the state of one
conversation at a time - the last role - so a conversation of any length needs no more memory than a turn. Escaping and
formatting are per turn. Every turn becomes segments (text, loss): the turn's opening, its escaped text, its closing.

The machine's transition says whether a turn's order is valid; from the first that is not, all turns of the conversation
are invalid. The template declares which roles are learned from, and with ``learn_from_invalid`` whether also in invalid turns.

Escaping: the control strings all begin with ``<|``. A backslash is put between the two signs, one more if some are
there already; ``unescape`` takes one away. A line end in a role, which would end the opening, becomes ``<|lf|>``, which no
escaped text holds. Nothing else changes.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), null turns first; repeated rows are
turns of their own; roles unknown to the template are formatted without loss and put the machine into its error state; a
text of any length is one segment; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import lean

ERROR = "error"
LINE_END = "<|lf|>"


@dataclass(frozen=True)
class Template:
    """What a chat format declares: turn marks, roles with loss and the machine's transitions."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    transitions: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})
    learn_from_invalid: bool = True

    def next_state(self, state: str, role: str) -> str:
        return role if role in self.transitions.get(state, ()) else ERROR

    def segments(self, state: str, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's segments, after the machine has moved to ``state`` by its role."""
        learned = role in self.loss_roles and (state != ERROR or self.learn_from_invalid)
        return [(self.opening.replace("{role}", escape(role).replace("\n", LINE_END)), False), (escape(text), learned), (self.closing, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        head, tail = self.opening.split("{role}")
        end = formatted.index(tail, len(head))
        return unescape(formatted[len(head) : end].replace(LINE_END, "\n")), unescape(formatted[end + len(tail) : len(formatted) - len(self.closing)])


_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def format_turns(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn, ordered within its partition: conv, segments array<struct<text, loss>>, state, valid (so far), place (in its conversation)."""
    template = template or Template()
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    conv_type = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no conversation
        state, place = "start", 0
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            segments, states, places = [], [], []
            convs = batch.column("conv").to_pylist()
            for conv, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != current:
                    current, state, place = conv, "start", 0
                state = template.next_state(state, role)
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(state, role, text)])
                states.append(state)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(segments, kind), pa.array(states, pa.string()), pa.array([s != ERROR for s in states], pa.bool_()), pa.array(places, pa.int64())],
                names=["conv", "segments", "state", "valid", "place"],
            )

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(lean(run), f"conv {conv_type}, segments array<struct<text: string, loss: boolean>>, state string, valid boolean, place long")


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """From ``format_turns``' segments alone: one row per conversation with counts and digests of what they hold.

    Reads the formatted turns in their order and checks it by their places, so turns that were dealt anew or filtered are an
    error and not a wrong answer. SHA-256 is a chain: one task digests a conversation, as a stream. ``valid``: all turns are and the last may end it.
    """
    template = template or Template()
    conv_type = turns.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(conv_type)
        open_conv: list | None = None

        def closed(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            values = [cols[0], cols[1], [h.hexdigest() for h in cols[2]], cols[3], [h.hexdigest() for h in cols[4]], cols[5], cols[6]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            done = []
            for conv, segments, state, valid, place in zip(*(batch.column(n).to_pylist() for n in ("conv", "segments", "state", "valid", "place")), strict=True):
                if place != (open_conv[1] if open_conv is not None and place else 0) or (place and conv != open_conv[0]):
                    raise ValueError("formatted turns are not in their order")
                if not place:
                    if open_conv is not None:
                        done.append(open_conv)
                    open_conv = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                formatted = "".join(s["text"] for s in segments)
                role, text = template.read(formatted)
                learned = unescape("".join(s["text"] for s in segments if s["loss"]))
                open_conv[1] += 1
                open_conv[2].update(f"{role}\n{text}\n".encode())
                open_conv[3] += len(learned)
                open_conv[4].update(learned.encode())
                open_conv[5] += len(formatted)
                open_conv[6] = valid and state in template.final
            if done:
                yield closed(done)
        if open_conv is not None:
            yield closed([open_conv])

    return turns.mapInArrow(lean(run), f"conv {conv_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
