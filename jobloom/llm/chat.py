"""Chat formatting by token-level assembly.

A turn is BEGIN role MIDDLE TEXT text END, a conversation START turn... STOP. Role and text are encoded apart from one
another by a byte-level model; the marks are ids beyond its vocabulary, so no text can produce them. START and STOP stand
for the first and the last part and are not stored. The loss mask covers the
text of assistant turns: segments add +1 where they start and -1 where they end, and the prefix sums are the mask.
Written out, the marks are control strings; where these, or the escape sign, occur inside a role or a text they are
escaped, so that the written form can be cut again: each escape sign is doubled, and one is put after the first sign of a
control string.

Turns are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over many tasks;
each task writes the turns of its range as parts of at most `PART` ids. To read a conversation, its parts are streamed in
order: no task holds more than a part, whatever a conversation's length. The digests decode the parts where they lie;
a SHA-256 is sequential, so a conversation's text then streams through one task that does nothing but hash it.

Defined cases: a null text is empty; a null role is empty; turns with equal numbers are ordered by role, then text;
repeated rows are turns of their own; a null conv_id is a conversation; a null turn comes first; texts that are not
valid UTF-16 pairs don't occur in Spark's strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import extended, fresh_dir, pick, table
from jobloom.llm.tokenize import encoder, vocabulary

NAME = "op7_chat"
SQL = None
PART = 1 << 18
ESCAPE = "␛"
#: Written form of the marks; their ids follow the vocabulary in this order.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[TEXT]", "[/TEXT]")
START, STOP, BEGIN, MIDDLE, TEXT, END = range(6)
#: Control strings that are escaped inside contents: the marks, and those of other templates.
CONTROLS = (*MARKS, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE})?", lambda m: m[1] or "", text)


class Template:
    """Encodes segments, splices the marks' ids between them, and reads both back."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.base = self.encoder.model.get_vocab_size()

    def turns(self, rows: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn (role, text)."""
        segments = self.encoder.encode([escape(s) for row in rows for s in row])
        out = []
        for k, (role, _) in enumerate(rows):
            name, text = (np.frombuffer(segments[2 * k + j], "<u4") for j in (0, 1))
            mark = lambda m: np.array([self.base + m], "<u4")
            ids = np.concatenate([mark(BEGIN), name, mark(MIDDLE), mark(TEXT), text, mark(END)])
            steps = np.zeros(len(ids) + 1, np.int8)
            if role == "assistant":
                steps[len(name) + 3] += 1
                steps[len(name) + 3 + len(text)] -= 1
            out.append((ids, np.cumsum(steps)[:-1].astype(bool)))
        return out

    def text(self, ids: np.ndarray) -> str:
        """What a segment's ids say, still escaped."""
        return self.encoder.model.decode(ids.tolist(), skip_special_tokens=False)


def format_turns(conversations: DataFrame, path: str, part: int = PART) -> DataFrame:
    """Parts of the formatted conversations (conv_id, turn, role, text), in order of part: conv_id, part, ids, mask.

    ids: little-endian unsigned 32-bit; mask: a byte for each id. A part holds whole turns, or one turn.
    """
    rows = pick(conversations, ["conv_id", "turn", "role", "text"])
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    keys = ["conv_id", "turn", "role", "text"]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = None, 0

        def made() -> pa.RecordBatch:
            nonlocal held, size, number
            ids, mask = (np.concatenate(x) for x in zip(*held))
            number, held, size = number + 1, [], 0
            own = [pa.array([current[0]], kind), pa.array([number], pa.int64()), pa.array([ids.tobytes()]), pa.array([mask.tobytes()])]
            return pa.RecordBatch.from_arrays(own, ["conv_id", "part", "ids", "mask"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for i in range(0, batch.num_rows, 4096):
                conv, _, role, text = (batch.column(k)[i : i + 4096].to_pylist() for k in keys)
                for c, turn in zip(conv, template.turns(list(zip(role, text)))):
                    if held and ((c,) != current or size + len(turn[0]) > part):
                        yield made()
                    current = (c,)
                    held.append(turn)
                    size += len(turn[0])
        if held:
            yield made()

    return spread.mapInArrow(run, extended(rows, ["conv_id"], "part long, ids binary, mask binary"))


def _segments(template: Template, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether the mask covers the text) of each turn in a part; both still escaped."""
    at = {m: np.flatnonzero(ids == template.base + m) for m in (BEGIN, MIDDLE, TEXT, END)}
    if len({len(x) for x in at.values()}) != 1:
        raise ValueError("a part doesn't hold whole turns")
    for a, b, c, d in zip(*(at[m].tolist() for m in (BEGIN, MIDDLE, TEXT, END))):
        covered = mask[c + 1 : d]
        if len(covered) and covered.any() != covered.all() or mask[a : c + 1].any() or mask[d]:
            raise ValueError("the mask cuts a segment")
        yield template.text(ids[a + 1 : b]), template.text(ids[c + 1 : d]), bool(len(covered) and covered.all())


def told(parts: DataFrame, path: str) -> DataFrame:
    """What each part of format_turns says, read where the parts lie: conv_id, part, n_turns, turns and heard (the texts of
    role, newline, text, newline of each turn, and the text under the mask, in UTF-8), loss_chars and chars of the written form."""
    names = ["conv_id", "part", "n_turns", "turns", "heard", "loss_chars", "chars"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        frame = sum(len(MARKS[m]) for m in (BEGIN, MIDDLE, TEXT, END))
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("ids"), batch.column("mask")):
                turns, heard = [], []
                chars = 0
                for role, text, loss in _segments(template, np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(mask.as_py(), bool)):
                    chars += len(role) + len(text) + frame
                    role, text = unescape(role), unescape(text)
                    turns.append(f"{role}\n{text}\n")
                    if loss:
                        heard.append(text)
                rows.append((len(turns), "".join(turns).encode(), "".join(heard).encode(), sum(map(len, heard)), chars))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *columns], names)

    return parts.mapInArrow(run, extended(parts, ["conv_id", "part"], "n_turns long, turns binary, heard binary, loss_chars long, chars long"))


def digest(parts: DataFrame, path: str) -> DataFrame:
    """Counts and hashes of each conversation from its parts. The parts are decoded where they lie; only the hashes, which
    are sequential, take a conversation's texts in order through one task, with one part in memory at a time."""
    spread = told(parts, path).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind = None
        ended: list[list] = []

        def flush() -> pa.RecordBatch:
            nonlocal ended
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ended), types)], names)
            ended = []
            return out

        def end(s: list) -> None:
            ended.append([s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            counts = zip(*(batch.column(k).to_pylist() for k in ("conv_id", "n_turns", "loss_chars", "chars")))
            for (conv, n, loss, chars), turns, heard in zip(counts, batch.column("turns"), batch.column("heard")):
                if state is None or conv != state[0]:
                    if state is not None:
                        end(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(MARKS[START]) + len(MARKS[STOP])]
                state[1] += n
                state[2].update(turns.as_buffer())
                state[3] += loss
                state[4].update(heard.as_buffer())
                state[5] += chars
                if len(ended) >= 1000:
                    yield flush()
        if state is not None:
            end(state)
            yield flush()

    schema = extended(parts, ["conv_id"], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return spread.mapInArrow(run, schema)


def render(parts: list[bytes], path: str) -> str:
    """A conversation's written form from the ids of its parts."""
    template = Template(path)
    out = [MARKS[START]]
    for data in parts:
        ids = np.frombuffer(data, "<u4")
        for role, text, _ in _segments(template, ids, np.zeros(len(ids), bool)):
            out += [MARKS[BEGIN], role, MARKS[MIDDLE], MARKS[TEXT], text, MARKS[END]]
    return "".join([*out, MARKS[STOP]])


def parse(written: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a written form: the inverse of render."""
    turn = "".join(f"{re.escape(MARKS[m])}(.*?)" if m in (BEGIN, TEXT) else re.escape(MARKS[m]) for m in (BEGIN, MIDDLE, TEXT, END))
    body = written.removeprefix(MARKS[START]).removesuffix(MARKS[STOP])
    return [(unescape(a), unescape(b)) for a, b in re.findall(turn, body, re.DOTALL)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pick(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"])
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], own.schema)
    path = vocabulary("byte_bpe_50k.json")
    where = fresh_dir(spark, "chat")
    format_turns(own.unionByName(more), path).write.parquet(where)
    return digest(spark.read.parquet(where), path)
