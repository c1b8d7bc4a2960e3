r"""Chat formatting with a grammar round trip.

The template, a string of marks and texts, read strictly from left to right:

    conversation = <s> turn*
    system turn  = [SYS] text [/SYS]         user turn = [INST] text [/INST]         assistant turn = text </s>
    other turn   = [ROLE]role[/ROLE] text [END]

with a space on either side of a text inside marks and before an assistant's text.  A control string is a mark; the parser takes every
mark where the grammar does not expect it for an error, so a text that holds one cannot pass for structure.  Escaping is reversible: a
backslash goes behind the first character of a mark, and marks that already have k backslashes there get one more (`[INST]`, `[\INST]`,
`[\\INST]`); reading takes one away.

Each turn is rendered as it is, parsed again and compared with its source; a turn that comes back different, or not at all, is escaped and
tried again until it is identical.  That is done row by row before the exchange, so a conversation with a large share of all rows is
rendered by many tasks.  Turns are then dealt out by conversation and streamed in order into pieces of whole turns; `read_back` parses the
pieces and streams the recovered turns and the text under the loss mask into digests.  A digest is one chain over its conversation, so
that last reading is one task for each conversation, in bounded memory.
"""
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

BEGIN, END_OF_ANSWER = "<s>", "</s>"
#: Marks around the text of a turn, by role.
AROUND = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", END_OF_ANSWER)}
OTHER, OTHER_NAME_END, OTHER_END = "[ROLE]", "[/ROLE]", "[END]"
CONTROL = [BEGIN, END_OF_ANSWER, "[SYS]", "[/SYS]", "[INST]", "[/INST]", OTHER, OTHER_NAME_END, OTHER_END]
MARK = re.compile("|".join(re.escape(c) for c in CONTROL))
ESCAPABLE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
PIECE_CHARS = 1 << 20


class Malformed(ValueError):
    """The string is not a sentence of the grammar."""


def escape(text: str) -> str:
    return ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _written(role: str, text: str) -> str:
    if role == "assistant":
        return f" {text}{END_OF_ANSWER}"
    if role in AROUND:
        return f"{AROUND[role][0]} {text} {AROUND[role][1]}"
    return f"{OTHER}{role}{OTHER_NAME_END} {text} {OTHER_END}"


def parse(formatted: str, begun: bool = False) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of the turns; begin and end bound the escaped text in the string.  begun: the opening mark came earlier."""
    at, out = 0, []
    if not begun:
        if not formatted.startswith(BEGIN):
            raise Malformed("no opening mark")
        at = len(BEGIN)
    starts = {AROUND[r][0]: r for r in ("system", "user")}

    def text_until(begin: int, mark: str, pad: str) -> int:
        """End of the text that begins at begin; the next mark must be the expected one."""
        m = MARK.search(formatted, begin)
        if m is None or m[0] != mark or not formatted.endswith(pad, begin, m.start()):
            raise Malformed(f"expected {mark} after {begin}")
        return m.start() - len(pad)

    def after(mark_end: int) -> int:
        if not formatted.startswith(" ", mark_end):
            raise Malformed(f"no space at {mark_end}")
        return mark_end + 1
    while at < len(formatted):
        m = MARK.match(formatted, at)
        if m is None:                                   # an answer has no opening mark
            begin = after(at)
            end = text_until(begin, END_OF_ANSWER, "")
            out.append(("assistant", unescape(formatted[begin:end]), begin, end))
            at = end + len(END_OF_ANSWER)
        elif m[0] in starts:
            begin, close = after(m.end()), AROUND[starts[m[0]]][1]
            end = text_until(begin, close, " ")
            out.append((starts[m[0]], unescape(formatted[begin:end]), begin, end))
            at = end + 1 + len(close)
        elif m[0] == OTHER:
            name_end = text_until(m.end(), OTHER_NAME_END, "")
            begin = after(name_end + len(OTHER_NAME_END))
            end = text_until(begin, OTHER_END, " ")
            out.append((unescape(formatted[m.end():name_end]), unescape(formatted[begin:end]), begin, end))
            at = end + 1 + len(OTHER_END)
        else:
            raise Malformed(f"unexpected {m[0]} at {at}")
    return out


def render(role: str, text: str) -> tuple[str, int]:
    """(rendered turn, rounds): escaped only as far as the round trip asks for it: not at all, the text, the role's name too."""
    for rounds, (r, t) in enumerate(((role, text), (role, escape(text)), (escape(role), escape(text)))):
        shown = _written(r, t)
        try:
            found = parse(shown, begun=True)
        except Malformed:
            continue
        if [x[:2] for x in found] == [(role, text)]:
            return shown, rounds
    raise Malformed(f"no rendering of a turn of role {role!r} comes back")


def turn_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{role}\n{text}".encode("utf-8", "replace")).digest()[:16]


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, formatted, loss, sources): each conversation in pieces of whole turns, in order within a partition.

    loss lists the (begin, end) of the answers' text in the piece, in code points; sources holds a 128-bit digest of each source turn.
    Turns are ordered by turn (null last), ties by role and digest of the text; repeated rows are turns of their own.  A null text is empty, a null role
    the empty role; rows without conversation id form one conversation.  A conversation is mostly one piece; a longer one than about a
    million characters goes on in the next.  Other columns of rows are not read.
    """
    body = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = StructType([body.schema["conv"], body.schema["turn"], *StructType.fromDDL("role string, shown string, begin int, source binary").fields])
    result = StructType([body.schema["conv"], *StructType.fromDDL("part long, formatted string, loss array<struct<begin:long,end:long>>, sources array<binary>").fields])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, said = batch["role"].to_pylist(), batch["text"].to_pylist()
            shown = [render(r, t)[0] for r, t in zip(roles, said)]
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["turn"], batch["role"], pa.array(shown, pa.string()), pa.array([1 if r == "assistant" else 0 for r in roles], pa.int32()),
                                              pa.array([turn_digest(r, t) for r, t in zip(roles, said)], pa.binary())], schema=to_arrow_schema(ordered))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size = to_arrow_schema(result), [], 0
        key, part, whole, loss, sources, length = None, 0, [], [], [], 0

        def piece() -> tuple:
            return key, part, "".join(whole), loss, sources
        for batch in batches:
            for c, r, shown, source in zip(*(batch[n].to_pylist() for n in ("conv", "role", "shown", "source"))):
                fresh = not whole or c != key
                if whole and (fresh or length > PIECE_CHARS):
                    out.append(piece())
                    size += length
                    part, whole, loss, sources, length = (0 if fresh else part + 1), [], [], [], 0
                    if len(out) >= 2048 or size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
                if fresh:
                    key, whole, length = c, [BEGIN], len(BEGIN)
                if r == "assistant":
                    loss.append({"begin": length + 1, "end": length + len(shown) - len(END_OF_ANSWER)})
                whole.append(shown)
                sources.append(source)
                length += len(shown)
        if whole:
            out.append(piece())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    rendered = body.mapInArrow(turns, ordered)
    placed = rendered.withColumn("late", F.col("turn").isNull()).repartition("conv").sortWithinPartitions("conv", "late", "turn", "role", "source").drop("late")
    return placed.mapInArrow(join, result).withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id", arranged: bool = True) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, exact) of each conversation, from the formatted pieces.

    Turns come from the parser, the loss from the mask; exact says whether every recovered turn has the digest of its source.
    arranged: the pieces are in the order of `format_conversations`; else, as when they come from files, they are dealt and sorted again.
    """
    source = formatted.withColumnRenamed(conv, "conv")
    if not arranged:
        source = source.repartition("conv").sortWithinPartitions("conv", "part")
    result = StructType([StructField("conv", source.schema["conv"].dataType), *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, exact boolean").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, state, key = to_arrow_schema(result), [], None, None

        def done() -> tuple:
            return key, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["exact"]
        for batch in batches:
            for c, part, text, loss, sources in zip(*(batch[n].to_pylist() for n in ("conv", "part", "formatted", "loss", "sources"))):
                if state is None or c != key or part == 0:
                    if state is not None:
                        out.append(done())
                    key, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "exact": True}
                found = parse(text, begun=part > 0)
                state["n"] += len(found)
                state["formatted"] += len(text)
                state["exact"] &= [turn_digest(r, t) for r, t, _, _ in found] == sources
                for r, t, _, _ in found:
                    state["turns"].update(f"{r}\n{t}\n".encode("utf-8", "replace"))
                for span in loss:
                    said = unescape(text[span["begin"]:span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode("utf-8", "replace"))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if state is not None:
            out.append(done())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    return source.mapInArrow(read, result).withColumnRenamed("conv", conv)
