"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A deterministic parser reads rendered text back. Every turn is rendered plainly first and parsed; where that does not give the
same role and text, the offending field is escaped and the turn parsed again until it does. Escaping puts one backslash more
between the "<" and "|" of anything that looks like a control string, and takes one out when parsing, so it is reversible.
Each rendered turn parses alone and completely, hence any concatenation parses into the same turns: rendering needs no grouping.

Defined results: a null role or text is an empty one; a null conversation id is an id of its own; turns are ordered by their number
(nulls first), ties by what they render to; repeated rows are repeated turns. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.llm.common import map_columns, texts
from sitefold.runtime import ship_package

START, END = "<|im_start|>", "<|im_end|>"
_LOOKALIKE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape_text(s: str) -> str:
    return _LOOKALIKE.sub(r"<\1\\|", s)


def _plain_text(s: str) -> str:
    return _ESCAPED.sub(r"<\1|", s)


def escape_role(s: str) -> str:
    return escape_text(s.replace("%", "%25").replace("\n", "%0A"))


def _plain_role(s: str) -> str:
    return _plain_text(s).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the text in `rendered`) of each turn. ValueError where the grammar does not hold."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END + "\n", line)
        if line < 0 or end < 0:
            raise ValueError(f"the turn at {at} does not end")
        role, text = rendered[at + len(START):line], rendered[line + 1:end]
        if any(x in y for x in (START, END) for y in (role, text)):
            raise ValueError(f"a control string inside the turn at {at}")
        yield _plain_role(role), _plain_text(text), line + 1, end
        at = end + len(END) + 1


def render_turn(role: str, text: str) -> str:
    """The first of plain, text escaped, both escaped that parses into exactly this turn."""
    for r, t in ((role, text), (role, escape_text(text)), (escape_role(role), text), (escape_role(role), escape_text(text))):
        out = f"{START}{r}\n{t}{END}\n"
        try:
            turns = [x[:2] for x in parse(out)]
        except ValueError:
            continue
        if turns == [(role, text)]:
            return out
    raise AssertionError("escaping is reversible")


def render(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: id, turn, `rendered`, and the code points of `rendered` under the loss mask, [loss_start, loss_end).

    A conversation's formatted text is its rendered turns in order, one after the other."""
    rows = conversations.select(*[F.col(c).alias(n) for c, n in ((id_col, "conv_id"), (turn_col, "turn"))],
                                F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("rendered"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out, starts, ends = [], [], []
        for role, text in zip(texts(batch, "role"), texts(batch, "rendered")):
            out.append(r := render_turn(role or "", text or ""))
            _, _, a, b = next(parse(r))
            inside = (role or "") in trained
            starts.append(a if inside else 0)
            ends.append(b if inside else 0)
        return {"rendered": pa.array(out, pa.string()), "loss_start": pa.array(starts, pa.int64()), "loss_end": pa.array(ends, pa.int64())}

    made = map_columns(rows, run, [T.StructField("rendered", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    return made.drop("role")


class _Reader:
    """What one conversation's rendered turns say, fed in order."""

    def __init__(self):
        self.n = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, rendered: str, loss_start: int, loss_end: int) -> None:
        for role, text, _, _ in parse(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        under = _plain_text(rendered[loss_start:loss_end])
        self.loss.update(under.encode())
        self.loss_chars += len(under)
        self.chars += len(rendered)


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the rendered turns alone: turns parsed, their digest, the unescaped text under the loss mask, length.

    A digest needs the turns of a conversation in order, so they are sorted within partitions and streamed: a task holds one turn and
    one running digest however long the conversation."""
    spark = rendered.sparkSession
    ship_package(spark)
    kind = rendered.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, reader = None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            types = [arrow_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        def close() -> None:
            done.append((now, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        arrow_id = pa.int64()
        for b in batches:
            arrow_id = b.column("conv_id").type
            for conv, text, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
                if reader is None or conv != now:
                    if reader is not None:
                        close()
                    now, reader = conv, _Reader()
                reader.feed(text, a, z)
            if len(done) >= 1000:
                yield batch()
                done.clear()
        if reader is not None:
            close()
        if done:
            yield batch()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rendered.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.mapInArrow(run, schema)


def format_digest(conversations: DataFrame) -> DataFrame:
    return read_back(render(conversations))
