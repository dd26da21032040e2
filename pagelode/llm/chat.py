"""Chat formatting at the level of tokens.

Method. Every segment (a role, a text) is encoded on its own and reserved ids are spliced between the segments:

    TURN role-ids SAYS text-ids END

so no text can make a reserved id, whatever it says. Where the output is shown as characters, the reserved ids read
"### ", ": " after the role's name, and " </turn>\\n". A text that holds one of the template's control strings would
look like a turn there; so in every segment backslashes are doubled and a backslash is put behind the first
character of each control string, which undoes itself from left to right. Masks and offsets of a conversation are
prefix sums over its turns' token counts: the loss is on the text and end of each assistant turn.

Scale. Escaping and encoding run where the rows are read. Turns are then dealt by conversation, sorted, and
assembled in a stream that holds one turn at a time; a digest of a whole conversation can only be taken in order, so
a huge conversation is one task's stream, but never a collected group.

Defined cases. Null role or text: empty. Turns are in the order of turn (nulls first); ties by role, then text.
Repeated rows are turns of their own. A null conversation is one conversation. No rows: no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.tokens import encoder

#: Reserved ids, above the vocabulary's own, and how they read.
TURN, SAYS, END = 50_257, 50_258, 50_259
SHOWN = {TURN: "### ", SAYS: ": ", END: " </turn>\n"}
LOSS_ROLE = "assistant"
#: Strings that a reader of the shown text could take for the template's own.
CONTROL = ("###", "</turn>", "<turn>", "<|endoftext|>")
SLICE_BYTES = 2 << 20

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CONTROL_START = re.compile(f"(?={_CONTROL.pattern}).", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double backslashes, then break each control string, overlapping ones too, behind its first character."""
    return _CONTROL_START.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """What escape() was given: a doubled backslash is one, a single one is dropped."""
    return _ESCAPED.sub(lambda m: m[1], text)


def encode_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """turns (conv_id, turn, role, text) with ids, the turn's tokens, and the loss mask's first and last + 1 token."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                roles = part.column("role").to_pylist()
                role, role_at = bpe.encode(pa.array([escape(x) for x in roles], pa.string()))
                text, text_at = bpe.encode(pa.array([escape(x) for x in part.column("text").to_pylist()], pa.string()))
                ids, first, size = [], [], []
                for n, name in enumerate(roles):
                    r, t = role[role_at[n] : role_at[n + 1]], text[text_at[n] : text_at[n + 1]]
                    ids.append(np.concatenate([[TURN], r, [SAYS], t, [END]]).astype("<u4").tobytes())
                    size.append(len(r) + len(t) + 3)
                    first.append(len(r) + 2 if name == LOSS_ROLE else size[-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(size, pa.int64()), pa.array(first, pa.int64())], names=[*part.schema.names, "ids", "n_tokens", "loss_from"])

    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.mapInArrow(K.frugal(each), "conv_id long, turn long, role string, text string, ids binary, n_tokens long, loss_from long")


class Reader:
    """Reads conversations back from their ids and masks, turn by turn."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)

    def text(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def turn(self, ids: np.ndarray) -> tuple[str, str, str]:
        """The escaped role and text, and the turn as it is shown."""
        cut = np.flatnonzero(ids >= TURN)
        if ids[cut].tolist() != [TURN, SAYS, END] or cut[0] or cut[2] + 1 != len(ids):
            raise ValueError("a turn's reserved ids are out of place")
        role, text = self.text(ids[1 : cut[1]]), self.text(ids[cut[1] + 1 : cut[2]])
        return role, text, SHOWN[TURN] + role + SHOWN[SAYS] + text + SHOWN[END]


def ordered(encoded: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order."""
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def assemble(turns: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, turn, place, ids, token_start, loss_start, loss_end): offsets are the conversation's, by prefix sums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, place, any_yet = None, 0, 0, False
        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            start, order = [], []
            for c, n in zip(conv, batch.column("n_tokens").to_pylist(), strict=True):
                if c != now or not any_yet:
                    now, total, place, any_yet = c, 0, 0, True
                start.append(total)
                order.append(place)
                total, place = total + n, place + 1
            start = np.array(start, np.int64)
            size, first = batch.column("n_tokens").to_numpy(), batch.column("loss_from").to_numpy()
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            edge = np.concatenate([[0], np.cumsum(size)])
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(order, pa.int64()), lists, pa.array(start), pa.array(start + first), pa.array(start + size)], names=["conv_id", "turn", "place", "ids", "token_start", "loss_start", "loss_end"])

    return ordered(encode_turns(turns, vocabulary)).mapInArrow(K.frugal(each), "conv_id long, turn long, place long, ids array<int>, token_start long, loss_start long, loss_end long")


def digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each conversation, read back from the assembled ids and masks."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        state: dict | None = None

        def done() -> pa.RecordBatch:
            row = [state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["shown"], state["tokens"]]
            names = [x.strip().split(" ")[0] for x in schema.split(",")]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=names)

        for batch in batches:
            for conv, start, loss, data in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "token_start", "loss_start", "ids")], strict=True):
                if state is None or start == 0:
                    if state is not None:
                        yield done()
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "shown": 0, "tokens": 0}
                ids = np.array(data, np.int64)
                role, text, shown = reader.turn(ids)
                role, text = unescape(role), unescape(text)
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
                state["shown"] += len(shown)
                state["tokens"] += len(ids)
                under = unescape(reader.text(ids[loss - start : -1]))  # the end id itself has no characters of the text
                state["chars"] += len(under)
                state["loss"].update(under.encode())
        if state is not None:
            yield done()

    return assemble(turns, vocabulary).mapInArrow(K.frugal(each), schema)
