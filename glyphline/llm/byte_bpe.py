"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte has a printable character, as byte-level vocabularies write them, so a token's bytes are a piece
of such characters. The model lists the pieces by rank with the score -rank and leaves text as it is: merging
the pair of the best score, the leftmost of equal ones, is then merging by rank. Texts are cut by a pattern, each
match is encoded by itself, and ids are turned back by the characters of their pieces.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that stand for themselves; the others are the characters from 256 on, in order.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The piece of unknown text has a character that no byte has, so no text meets it.
UNKNOWN = "⁇"
#: Matches that a worker remembers, and the longest of those.
REMEMBERED, LONGEST = 200_000, 64
#: Matches that are looked up at a time, and bytes of an output batch.
AT_ONCE, BATCH_BYTES = 65_536, 8 << 20


def byte_characters() -> str:
    """The character of each byte, 0 to 255."""
    others = [b for b in range(256) if b not in set(SHOWN)]
    return "".join(chr(b) if b in set(SHOWN) else chr(256 + others.index(b)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: pieces in the order of ranks, the unknown piece behind them.

    All 256 bytes must be tokens, ranks must differ and be below 2**24, which a score holds exactly.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    if len(set(ranks.values())) < len(ranks) or not all(0 <= r < 1 << 24 for r in ranks.values()):
        raise ValueError("ranks must differ and lie between 0 and 2**24")
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, token.decode("latin-1").translate(shown).encode()) + _field(2, -float(rank)) + _field(3, normal)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(f, -1) for f in (41, 42, 43)) + _field(45, UNKNOWN.encode())
    normalizer = _field(1, b"identity") + b"".join(_field(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def newer_characters() -> str:
    """Letters and digits of ``regex`` that the older character tables of ``tiktoken`` do not know, and that its patterns take for other signs.

    A match that is a token stays whole there, so a letter or digit is known by a token of two of its kind.
    """
    import regex
    import tiktoken

    late = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn"))
    pairs = [(a + c).encode() for c in late for a in "b1"]
    tokens = {x: i for i, x in enumerate([*(bytes([b]) for b in range(256)), *pairs])}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=tokens, special_tokens={})
    return "".join(c for c in late if all(len(probe.encode_ordinary(a + c)) > 1 for a in "b1"))


class Codec:
    """Ids of texts and bytes of ids; ``model`` as ``model_bytes`` writes it, ``ranks`` of its pieces in order.

    The characters ``others`` count as neither letters nor digits for ``pattern``.
    """

    def __init__(self, model: bytes, ranks: list[int], pattern: str, others: str = ""):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        ends = [i for i in range(len(others)) if i + 1 == len(others) or ord(others[i + 1]) - ord(others[i]) > 1]
        ranges = [f"{re.escape(others[a])}-{re.escape(others[b])}" for a, b in zip([0, *(i + 1 for i in ends)], ends, strict=False)]
        self.others = re.compile(f"[{''.join(ranges)}]") if others else None
        self.about = re.compile(f"[{re.escape(others[0])}-{re.escape(others[-1])}]") if others else None  # a faster look
        self.ranks, self.shown = np.array([*ranks, 0], "<i4"), byte_characters()
        own = {c: b for b, c in enumerate(self.shown)}
        tokens = [bytes(own[c] for c in self.pieces.id_to_piece(i)) for i in range(len(ranks))]
        # a match that is a token is that token, even where no merges lead to it
        self.whole = {token: rank.tobytes() for token, rank in zip(tokens, self.ranks, strict=False)}
        self.known: dict[str, bytes] = {}
        # the bytes of all tokens in a row; where a rank's begin and how many they are, -1 for what is no token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array(list(map(len, tokens)), np.int64)
        self.start, self.size = np.zeros(max(ranks) + 1, np.int64), np.full(max(ranks) + 1, -1, np.int64)
        self.start[ranks], self.size[ranks] = np.cumsum(size) - size, size

    def of_matches(self, matches: list[str]) -> list[bytes]:
        """The ids of each match, as 32-bit integers in bytes."""
        known = self.known
        found = list(map(known.get, matches))
        if None not in found:
            return found
        if len(known) > REMEMBERED:
            known.clear()
        new, made = {}, {}
        for m in set(matches):
            if m not in known:
                data = m.encode()
                if data in self.whole:
                    made[m] = self.whole[data]
                else:
                    new[m] = data.decode("latin-1").translate(self.shown)
        for m, ids in zip(new, self.pieces.encode(list(new.values()), num_threads=1) if new else [], strict=True):
            made[m] = self.ranks[ids].tobytes()
        found = [known.get(m) or made[m] for m in matches]
        known.update((m, ids) for m, ids in made.items() if len(m) <= LONGEST)
        return found

    def matches(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern in order, some at a time."""
        late = self.others is not None and not text.isascii() and self.about.search(text) and self.others.search(text)
        seen = self.others.sub("\uffff", text) if late else text
        if seen is text and len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(seen)
        while some := [text[m.start() : m.end()] for m in islice(found, AT_ONCE)]:
            yield some

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([ids for some in self.matches(text) for ids in self.of_matches(some)]), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in a row, gathered from the pieces' own; an id that is no token is an error."""
        out = []
        for a in range(0, len(ids), AT_ONCE):
            part = ids[a : a + AT_ONCE]
            if part.min() < 0 or part.max() >= len(self.size) or (size := self.size[part]).min() < 0:
                raise ValueError("an id is no token")
            end = np.cumsum(size)
            at = np.arange(end[-1]) + np.repeat(self.start[part] - (end - size), size)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


class Vocabulary:
    """A vocabulary as it travels to tasks: the model is broadcast (some 20 bytes a token) and opened once for each Python worker."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.name = f"{path}\n{pattern}"
        self.data = spark.sparkContext.broadcast((model_bytes(ranks), sorted(ranks.values()), pattern, newer_characters()))

    def __call__(self) -> Codec:
        made = Codec.__dict__.get("_made", {})
        if self.name not in made:
            Codec._made = made = {self.name: Codec(*self.data.value)}
        return made[self.name]


def _mapped(df: DataFrame, run, column: str, name: str, kind: str) -> DataFrame:
    """``df`` with the column ``name`` of ``kind`` that ``run`` makes of ``column``, the last one here; columns of any names travel by numbers."""
    others = [c for c in df.columns if c != column]
    by_number = df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in (*others, column))).toDF(*map(str, range(len(others) + 1)))
    schema = StructType([*by_number.schema.fields[:-1], *by_number.select(F.lit(None).cast(kind).alias(str(len(others)))).schema.fields])
    return by_number.mapInArrow(run, schema).toDF(*others, name)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns of ``docs`` with array<int> ``ids`` of ``text`` in place of that. Null is an empty text; whole texts of any length.

    Rows stay where they are, nothing is shuffled; a column named ``ids`` is an error of the caller.
    """
    if ids in docs.columns and ids != text:
        raise ValueError(f"there is a column {ids} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary()
        for batch in batches:
            *others, last = batch.schema.names
            column, done, made, size = batch.column(last), 0, [], 0
            for i in range(len(column)):
                made.append(codec.encode(column[i].as_py() or ""))
                size += made[-1].nbytes
                if size > BATCH_BYTES or i == len(column) - 1:
                    ends = pa.array([0, *accumulate(map(len, made))], pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(made)) for c in others), lists], batch.schema.names)
                    done, made, size = i + 1, [], 0

    return _mapped(docs, run, text, ids, "array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """The columns of ``tokens`` with the binary ``out`` of array<int> ``ids`` in place of that. Null is an empty list; an id that is no token, or null, is an error."""
    if out in tokens.columns and out != ids:
        raise ValueError(f"there is a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary()
        for batch in batches:
            *others, last = batch.schema.names
            column, done, made, size = batch.column(last), 0, [], 0
            if column.flatten().null_count:
                raise ValueError("an id is null")
            for i in range(len(column)):
                made.append(codec.decode(column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, int)))
                size += len(made[-1])
                if size > BATCH_BYTES or i == len(column) - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(made)) for c in others), pa.array(made, pa.binary())], batch.schema.names)
                    done, made, size = i + 1, [], 0

    return _mapped(tokens, run, ids, out, "binary")
