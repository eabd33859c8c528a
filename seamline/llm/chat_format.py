"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans
of its assistant texts are intersected with the token spans by binary search.

The template of a turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and
texts each control string is escaped by a backslash after its first character
(``<\\|im_end|>``); a backslash in that place gets one more, so the escape is
reversible. Line feeds in a role are escaped as well, so the first line feed ends
the role.

Turns are ordered by turn, then role, then text, nulls first; a repeated row is a
turn of its own. Null texts and roles are empty. Rows without a conversation id
form one conversation. Further columns are never read; an empty table gives an
empty result. A token that holds characters of the text and of the template
belongs to the mask only for the characters that lie in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)(?=\|im_(?:start|end)\|>)")
_UNESCAPE = re.compile(r"<\\(\\*)(?=\|im_(?:start|end)\|>)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans of its assistant texts, in characters."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += head, body, END, "\n"
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return out


def aligned(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of tokens that lie in spans: token number and (start, end) in characters.

    ``tokens`` and ``spans`` are sorted (start, end). For each span the first
    token that ends after its start and the last that starts before its end are
    found by binary search.
    """
    if not len(tokens) or not len(spans):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    first = np.searchsorted(tokens[:, 1], spans[:, 0], "right")
    last = np.searchsorted(tokens[:, 0], spans[:, 1], "left")
    size = np.maximum(0, last - first)
    which, of = C.ranges(first, size), np.repeat(np.arange(len(spans)), size)
    return which, np.column_stack([np.maximum(tokens[which, 0], spans[of, 0]), np.minimum(tokens[which, 1], spans[of, 1])])


def covered(parts: np.ndarray) -> list[tuple[int, int]]:
    """Characters under the mask, each once: tokens of one character share its span."""
    out: list[list[int]] = []
    for a, b in parts.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [tuple(x) for x in out]


SCHEMA = "n_turns long, formatted string, ids array<int>, mask array<boolean>, spans array<struct<start:int,end:int>>"


def _formatted(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True

        def close(ready: list[tuple]):
            shown = [render(t) for _, t in ready]
            cols = [[], [], [], [], [], []]
            for (conv, turns), (text, spans), code in zip(ready, shown, model.encode_batch([s for s, _ in shown], add_special_tokens=False)):
                which, parts = aligned(np.array(code.offsets, np.int64).reshape(-1, 2), np.array(spans, np.int64).reshape(-1, 2))
                mask = np.zeros(len(code.ids), bool)
                mask[which] = True
                for c, v in zip(cols, (conv, len(turns), text, code.ids, mask.tolist(), [{"start": a, "end": b} for a, b in covered(parts)])):
                    c.append(v)
            kinds = [id_type, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "formatted", "ids", "mask", "spans"])

        some, now, turns, ready, size = False, None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if some and conv != now:
                    ready.append((now, turns))
                    turns = []
                    if size > 1_000_000 or len(ready) >= 500:
                        yield close(ready)
                        ready, size = [], 0
                some, now = True, conv
                turns.append((role or "", text or ""))
                size += len(text or "")
        if some:
            yield close([*ready, (now, turns)])

    return run


def format_chats(turns: DataFrame, path: str) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, ids, mask (of each token), spans (characters under the mask)."""
    id_kind = turns.schema["conv_id"].dataType.simpleString()
    id_type = pa.string() if id_kind == "string" else pa.int32() if id_kind == "int" else pa.int64()
    dealt = turns.select("conv_id", "turn", "role", "text").repartition(C.partitions(turns.sparkSession), "conv_id")
    ordered = dealt.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(path, id_type), f"conv_id {id_kind}, {SCHEMA}")


def digest(formatted: DataFrame) -> DataFrame:
    """Read back from the output: turns, the text under the mask, and their digests."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns = "".join(f"{r}\n{t}\n" for r, t in read_back(text))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch(
                [batch.column("conv_id"), batch.column("n_turns"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    columns = formatted.select("conv_id", "n_turns", "formatted", "spans")
    return columns.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
