"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text. Segment lengths, cumulative offsets and scatter indices are computed in
numpy for many conversations at once, and headers, contents and closings are copied into one preallocated buffer that
becomes the Arrow column. The loss mask is a list of spans, in code points, over the contents of assistant turns.

Control strings inside roles and texts get a backslash after their first character, and those that already have
backslashes there get one more; `unescape` takes exactly one away, so reading back gives the texts as they were.

Cases: null role and text read as empty, a null turn comes first, equal turns are ordered by role, then text, and
rows that repeat are formatted each. A row without a conversation id is a conversation of its own, so such rows spread
over all tasks. An empty table gives no rows. Columns other than the four are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that chat templates give a meaning.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
LEARNED = "assistant"

_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)({TAILS})"), re.compile(rf"([<\[])\\(\\*)({TAILS})")
_BOUND = re.compile(r"<\|im_start\|>|<\|im_end\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """Roles stand on one line, so their line ends are escaped as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) if "\\" in role or "\n" in role or "<" in role or "[" in role else role


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def assemble(conv: np.ndarray, roles: list[str], texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer for all conversations. conv: the number of each row's conversation, ascending from 0.

    Returns each conversation's byte offsets, the buffer, and for learned rows the conversation, start and length in
    code points.
    """
    seg = [x.encode() for role, text in zip(roles, texts) for x in (START + escape_role(role) + BREAK, escape(text), END)]
    length = np.fromiter(map(len, seg), dtype=np.int64, count=len(seg))
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    out = np.empty(total, dtype=np.uint8)
    # Kinds of segments are copied one after another: every byte knows its place from its segment's offset.
    for kind in range(3):
        own = length[kind::3]
        source = np.frombuffer(b"".join(seg[kind::3]), dtype=np.uint8)
        # Indices take four bytes for each byte of text wherever they can.
        narrow = np.int32 if total < 1 << 31 else np.int64
        place = np.repeat((stop[kind::3] - own - (np.cumsum(own) - own)).astype(narrow), own)
        place += np.arange(len(source), dtype=narrow)
        out[place] = source
    rows = np.bincount(conv, minlength=int(conv[-1]) + 1 if len(conv) else 0)
    row_stop = np.concatenate([[0], stop[2::3]])
    offsets = row_stop[np.concatenate([[0], np.cumsum(rows)])]
    points = np.concatenate([np.zeros(1, narrow), np.cumsum((out & 0xC0) != 0x80, dtype=narrow)])
    learned = np.flatnonzero(np.fromiter((r == LEARNED for r in roles), dtype=bool, count=len(roles)))
    first = points[offsets[:-1]] if len(conv) else np.zeros(0, dtype=np.int64)
    start, end = points[stop[0::3][learned]], points[stop[1::3][learned]]
    own = conv[learned]
    return offsets, out.tobytes(), own, start - first[own], end - start


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start,length>>), a row for each conversation."""
    slim = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), F.coalesce(df[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["conv_id"].dataType.simpleString()
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = slim.repartition("conv_id", apart).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def emit(ids: list, roles: list, texts: list, schema: pa.Schema) -> pa.RecordBatch:
        new = [k == 0 or ids[k] is None or ids[k] != ids[k - 1] for k in range(len(ids))]
        conv = np.cumsum(new) - 1
        offsets, data, own, start, length = assemble(conv, roles, texts)
        formatted = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64))], ["start", "length"])
        at = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(offsets) - 1))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([i for i, n in zip(ids, new) if n], schema.field("conv_id").type), formatted, pa.ListArray.from_arrays(pa.array(at), spans)], ["conv_id", "formatted", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        roles: list = []
        texts: list = []
        schema, held = None, 0
        for b in batches:
            schema = b.schema
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                # A conversation is complete when the next one begins, in whichever batch that is.
                if held > 1_000_000 and (i is None or i != ids[-1]):
                    yield emit(ids, roles, texts, schema)
                    ids, roles, texts, held = [], [], [], 0
                ids.append(i)
                roles.append(r)
                texts.append(t)
                held += len(t) + 64
        if ids:
            yield emit(ids, roles, texts, schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<start:bigint,length:bigint>>")


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) of a formatted text, and the texts under its loss mask."""
    turns, at = [], 0
    bounds = iter(_BOUND.finditer(formatted))
    for opening in bounds:
        closing = next(bounds, None)
        if opening[0] != START or closing is None or closing[0] == START or opening.start() != at:
            raise ValueError("a turn is not closed")
        role, _, text = formatted[opening.end() : closing.start()].partition(BREAK)
        turns.append((unescape_role(role), unescape(text)))
        at = closing.start() + len(END)
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns, [unescape(formatted[a : a + n]) for a, n in spans]


def read(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, learned array<string>, formatted_chars) of formatted conversations."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    struct = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                texts = b.column(1).to_pylist()
                got = [read_back(t, [(s["start"], s["length"]) for s in spans]) for t, spans in zip(texts, b.column(2).to_pylist())]
                turns = pa.array([[{"role": r, "text": t} for r, t in x[0]] for x in got], pa.list_(struct))
                yield pa.RecordBatch.from_arrays([b.column(0), turns, pa.array([x[1] for x in got], pa.list_(pa.string())), pa.array([len(t) for t in texts], pa.int64())], ["conv_id", "turns", "learned", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, turns array<struct<role:string,text:string>>, learned array<string>, formatted_chars long")
