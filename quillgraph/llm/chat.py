"""Chat formatting: typed content parts, a reversible template and a loss mask.

A turn's content is a list of typed parts. A visitor flattens them in order: text parts are
escaped, every other part becomes one numbered placeholder, its reference is recorded and the
tokens it stands for are counted. Formatting is a map over turns, so a conversation of any
length needs no memory of its own; reading back streams over turns sorted by conversation.

Defined results: null text is empty, null role is an empty role, a null conv_id is a
conversation of its own, null turns come first, repeated (conv_id, turn) rows are all kept,
ordered by role and text. Columns other than conv_id, turn, role, text and parts are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import map_with_ids

OPEN, ROLE, END = "<turn>", "### ", "</turn>\n"
LOSS_ROLE = "assistant"
#: What a text may not hold as it stands: the escape sign, markers of turns and parts, and a heading sign.
_CONTROL = re.compile(r"\\|<(?=/?turn>|(?:image|audio|document):)|#(?=## )")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h"}
_BACK = {"\\": "\\", "l": "<", "h": "#", "n": "\n"}
_SEGMENT = re.compile(r"<turn>### ([^\n]*)\n(.*)</turn>\n\Z", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\lhn])", lambda m: _BACK[m[1]], text)


@dataclass
class Flattener:
    """Visits parts in order. Sizes follow common encoders and are parameters."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 800
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown part type {kind!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"index": n, "type": kind, "ref": part.get("ref") or "", "tokens": tokens})
        self.pieces.append(f"<{kind}:{n}>")
        self.expanded += tokens

    def visit_image(self, part: dict) -> None:
        w, h = int(part.get("width") or self.patch), int(part.get("height") or self.patch)
        self._attach("image", part, math.ceil(w / self.patch) * math.ceil(h / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(float(part.get("seconds") or 0) * self.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(part.get("pages") or 1) * self.tokens_per_page)


def format_turn(role: str | None, text: str | None, parts: str | None = None) -> dict:
    """One turn's segment of the formatted conversation, with the loss mask's place in it (code points)."""
    visitor = Flattener()
    for part in json.loads(parts) if parts else [{"type": "text", "text": text or ""}]:
        visitor.visit(part)
    head = f"{OPEN}{ROLE}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    body = "".join(visitor.pieces)
    masked = (role or "") == LOSS_ROLE
    return {
        "segment": head + body + END,
        "loss_start": len(head) if masked else 0,
        "loss_end": len(head) + len(body) if masked else 0,
        "attachments": json.dumps(visitor.attachments),
        "expanded_tokens": visitor.expanded,
    }


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; placeholders stay as they are."""
    m = _SEGMENT.match(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


FORMATTED = "conv_id long, turn long, segment string, loss_start long, loss_end long, attachments string, expanded_tokens long"


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn, sorted by conversation and turn within a partition.

    Takes conv_id, turn, role, text and, if there, parts: a JSON list of
    {"type": text|image|audio|document, "text" or "ref", "width", "height", "seconds", "pages"}.
    """
    parts = F.col("parts").cast("string") if "parts" in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", parts.alias("parts"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([format_turn(*x) for x in zip(b["role"], b["text"], b["parts"])], columns=["segment", "loss_start", "loss_end", "attachments", "expanded_tokens"])
            out.insert(0, "turn", b["turn"].array)
            out.insert(0, "conv_id", b["conv_id"].array)
            yield out

    return map_with_ids(rows, work, FORMATTED, "conv_id", "turn")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back, a conversation at a time in a stream; needs format_conversations' order."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = None
        state: list | None = None

        def close() -> tuple:
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6])

        for b in batches:
            out = []
            for conv, segment, start, end, attached, tokens in zip(b["conv_id"], b["segment"], b["loss_start"], b["loss_end"], b["attachments"], b["expanded_tokens"]):
                if state is None or conv != key:
                    if state is not None:
                        out.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = read_segment(segment)
                loss = unescape(segment[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
                state[5] += len(json.loads(attached))
                state[6] += int(tokens)
            yield _digests(out)
        if state is not None:
            yield _digests([close()])

    return map_with_ids(formatted, work, DIGEST, "conv_id")


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
