r"""Chat formatting at token level (operator 1).

Each turn is a role segment and a text segment, encoded apart from each other and spliced
between reserved ids, the three that follow the vocabulary's own: ``TURN role ROLE_END text END``. The same
turn as text reads ``### <role>: <text> </turn>\n``. Control strings inside a role or text are
escaped with a backslash (which is itself escaped), so the text form parses back too.

The loss mask marks assistant texts: +1 where such a segment starts, -1 where it ends, and
the prefix sums of these marks are the mask.

Turns are encoded where their rows lie. Only ids are shuffled, by conversation; they are
streamed in turn order and written in parts of bounded size, so that not even a conversation
that holds most rows has to fit in memory.

Defined results: null text or role is empty; null ``turn`` comes first; rows of one turn are
ordered by role, then by text ids; a null ``conv_id`` is one conversation of its own; repeated
rows are repeated turns; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices, strings
from quern.llm.tokens import encoder, load, tokenizer_path

#: Of a vocabulary with ids 0 to 50256.
RESERVED = (50257, 50258, 50259)
#: Tokens in one part of a conversation, but for its last turn.
PART_TOKENS = 1 << 19
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|#|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)

_TURNS = "conv_id long, turn long, role string, loss boolean, role_ids binary, ids binary"
_PARTS = "conv_id long, part long, n_turns long, ids binary, mask binary"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def render(role: str, text: str) -> str:
    """A turn in text form."""
    return f"### {escape_role(role)}: {escape(text)} </turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of concatenated :func:`render` outputs."""
    turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\#])*?) </turn>\n", re.S)
    return [(unescape(r), unescape(t)) for r, t in turn.findall(formatted)]


def reserved(path: str) -> tuple[int, int, int]:
    """The ids that mark turns, the ends of roles and the ends of turns."""
    first = load(path).get_vocab_size(with_added_tokens=True)
    return first, first + 1, first + 2


def _encode_turns(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaces=True, plain_special=True).encode
        for batch in slices(batches, "text"):
            roles = strings(batch, "role")
            spoken = [escape_role(x) for x in roles]
            named = list(dict.fromkeys(spoken))
            named = dict(zip(named, encode(pa.array(named, pa.string())), strict=True))
            columns = [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array(roles),
                pa.array([x == LOSS_ROLE for x in roles]),
                pa.array([named[x] for x in spoken], pa.binary()),
                pa.array(encode(pa.array(map(escape, strings(batch, "text")), pa.string())), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "loss", "role_ids", "ids"])

    return run


def _splice(rows: list[tuple[bool, bytes, bytes]], reserved_ids: tuple[int, int, int] = RESERVED) -> tuple[bytes, bytes]:
    """Ids and packed loss mask of consecutive turns."""
    (turn, role_end, end), pieces, marks, at = reserved_ids, [], [], 0
    for loss, role_ids, ids in rows:
        role, text = np.frombuffer(role_ids, "<u4"), np.frombuffer(ids, "<u4")
        start = at + len(role) + 2
        pieces += [[turn], role, [role_end], text, [end]]
        at = start + len(text) + 1
        if loss:
            marks.append((start, start + len(text)))
    delta = np.zeros(at + 1, np.int8)
    for a, b in marks:  # an empty text adds both marks at one place
        delta[a] += 1
        delta[b] -= 1
    mask = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    return np.concatenate(pieces).astype("<u4").tobytes(), np.packbits(mask).tobytes()


def _assemble(batches: Iterator[pa.RecordBatch], reserved_ids: tuple[int, int, int] = RESERVED) -> Iterator[pa.RecordBatch]:
    """Parts of conversations from rows that come in order of conversation and turn."""
    done: list[tuple] = []
    key, part, held, tokens = None, 0, [], 0

    def flush():
        nonlocal held, tokens, part
        if held:
            done.append((key, part, len(held), *_splice(held, reserved_ids)))
        held, tokens, part = [], 0, part + 1

    def out():
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["conv_id", "part", "n_turns", "ids", "mask"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    began = False
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "loss", "role_ids", "ids")), strict=True):
            if not began or row[0] != key:
                flush()
                began, key, part = True, row[0], 0
            held.append(row[1:4])
            tokens += len(row[3]) // 4
            if tokens >= PART_TOKENS:
                flush()
            if len(done) >= 1000 or tokens == 0 and done:
                yield out()
    flush()
    if done:
        yield out()


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Parts of formatted conversations: conv_id, part, n_turns, ids and mask (packed bits).

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    turns = rows.mapInArrow(_encode_turns(path), _TURNS)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.mapInArrow(partial(_assemble, reserved_ids=reserved(path)), _PARTS)


def decode_part(tokenizer, ids: bytes, mask: bytes, reserved_ids: tuple[int, int, int] = RESERVED) -> tuple[list[tuple[str, str]], list[str], int]:
    """The turns (role, text) of a part, the texts under its loss mask, unescaped, and the length of its text form."""
    x = np.frombuffer(ids, "<u4")
    starts, middles, ends = (np.flatnonzero(x == mark) for mark in reserved_ids)
    segments = [x[a + 1 : b].tolist() for a, b in zip(starts, middles, strict=True)] + [x[a + 1 : b].tolist() for a, b in zip(middles, ends, strict=True)]
    written = tokenizer.decode_batch(segments, skip_special_tokens=False)
    texts = [unescape(t) for t in written]
    bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(x)).astype(np.int8)
    edges = np.diff(np.concatenate(([0], bits, [0])))
    under = [x[a:b].tolist() for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
    loss = [unescape(t) for t in tokenizer.decode_batch(under, skip_special_tokens=False)]
    size = sum(map(len, written)) + len(starts) * len("### : " + " </turn>\n")
    return list(zip(texts[: len(starts)], texts[len(starts) :], strict=True)), loss, size


def _digest(path: str):
    marks = reserved(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, plain_special=True)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done: list[tuple] = []
        key, state = None, None

        def close():
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, loss, chars = decode_part(tokenizer, ids, mask, marks)
                state[0] += len(turns)
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += chars
            if done:
                yield out()
        close()
        if done:
            yield out()

    return run


def read_back(parts: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation with digests of its turns and of the text under the loss mask."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digest(path), _DIGEST)
