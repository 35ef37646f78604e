"""Operator 1, byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised as
it is used.  It rests on two facts about BPE: the encoding of a prefix that ends
at a token boundary is the beginning of the encoding, and a sequence of tokens
is an encoding exactly if each neighbouring pair is the encoding of its own
bytes.  So while bytes are read, only those boundaries stay *alive* from which
the bytes since then can still grow into a token.  Tokens that lead up to the last
boundary that all alive ones share, when each is followed back token by token, are
settled and emitted.  An alive boundary is no further back than the longest token, so
what is held stays near that: a few tokens, whatever the length of the piece (tested
on runs of letters).  A state is, for each alive boundary, the bytes since then and
the token that ends there; transitions are worked out on first use.

Decoding runs an incremental UTF-8 state machine over tokens, so that ids can
come in pieces that split characters.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import byte_slices

#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: The letters and the numbers up to U+024F, as in a class of a pattern.
PLAIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"

MOST_STATES = 200_000
MOST_PAIRS = 500_000
#: Bytes read after which it is looked again for what is settled.
SETTLE = 64
NEVER = 1 << 40
MOST_PIECES = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a line ``base64 rank`` for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes to token ids; see the module's text.  Tokens' prefixes are the nodes of a tree, node 0 the empty one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.width = max(ranks.values(), default=0).bit_length() + 1
        numbers = {b"": 0}
        self.child: dict[int, int] = {}
        for token in ranks:
            for k in range(1, len(token) + 1):
                if token[:k] not in numbers:
                    numbers[token[:k]] = len(numbers)
                    self.child[numbers[token[: k - 1]] << 8 | token[k - 1]] = numbers[token[:k]]
        self.depth = [0] * len(numbers)
        for prefix, number in numbers.items():
            self.depth[number] = len(prefix)
        self.most_held = 0
        self.token_at = [0] * len(numbers)  # rank + 1
        for token, rank in ranks.items():
            self.token_at[numbers[token]] = rank + 1
        self.grows = [False] * len(numbers)
        for key in self.child:
            self.grows[key >> 8] = True
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; they come back as they are needed."""
        self.numbers: dict[tuple[int, ...], int] = {}
        self.alive: list[tuple[int, ...]] = []
        self.steps: dict[int, int] = {}
        self._state((0, 0))

    def _state(self, alive: tuple[int, ...]) -> int:
        """The state of these alive boundaries: for each the node of the bytes since then, and the token that ends there (rank + 1; 0: the start)."""
        number = self.numbers.get(alive)
        if number is None:
            number = self.numbers[alive] = len(self.alive)
            self.alive.append(alive)
        return number

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges by definition: again and again the pair of lowest rank, leftmost first."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while costs:
            least = min(costs)
            if least == NEVER:
                break
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts

    def _stands(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` in an encoding."""
        key = before << self.width | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            whole = [self.spelled[before - 1], self.spelled[token - 1]] if before else [self.spelled[token - 1]]
            known = self.pairs[key] = self.merged(b"".join(whole)) == whole
        return known

    def _step(self, state: int, byte: int) -> int:
        """The next state, and the token that ends here: the one that an alive boundary allows."""
        child, token_at, grows = self.child, self.token_at, self.grows
        alive, ends, left = [], 0, self.alive[state]
        for i in range(0, len(left), 2):
            node = child.get(left[i] << 8 | byte)
            if node is not None:
                if not ends and (token := token_at[node]) and self._stands(left[i + 1], token):
                    ends = token
                if grows[node]:
                    alive += (node, left[i + 1])
        alive += (0, ends)
        found = self.steps[state << 8 | byte] = self._state(tuple(alive)) << self.width | ends
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of text; a piece that is itself a token is that token.

        What is read is settled, and emitted, up to the last boundary that all
        alive ones share; within the rest, the end tells which of them stand.
        ``most_held`` is how many bytes were not settled at most.
        """
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.alive) > MOST_STATES:
            self.reset()
        state, ends, out, steps, width = 0, [], [], self.steps, self.width
        mask, due = (1 << width) - 1, SETTLE
        for byte in piece:
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self._step(state, byte)
            state = found >> width
            ends.append(found & mask)
            if len(ends) >= due:
                self.most_held = max(self.most_held, len(ends))
                self._settle(ends, out, self._shared(ends, state))
                due = len(ends) + SETTLE
        self._settle(ends, out, len(ends))
        return out

    def _shared(self, ends: list[int], state: int) -> int:
        """The last boundary among the bytes held to which all alive boundaries lead back."""
        alive = self.alive[state]
        open_at = {len(ends) - self.depth[node] for node in alive[::2]}
        while len(open_at) > 1:
            last = max(open_at)
            open_at.remove(last)
            open_at.add(last - len(self.spelled[ends[last - 1] - 1]))
        return open_at.pop()

    def _settle(self, ends: list[int], out: list[int], upto: int) -> None:
        """Emit the tokens that lead up to a boundary and forget the bytes before it."""
        tokens, at = [], upto
        while at:
            tokens.append(ends[at - 1] - 1)
            at -= len(self.spelled[ends[at - 1] - 1])
        out.extend(reversed(tokens))
        del ends[:upto]


class Encoder:
    """Splits texts by a pattern and encodes each match; ids of pieces seen lately are kept.

    Texts without a character above U+024F are split by the standard library's
    faster matcher, with the classes of the pattern written out for those
    characters.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = regex.compile(_spelled(pattern, r"\p{L}", r"\p{N}")).findall
        self.plain_split = re.compile(_spelled(pattern, PLAIN_LETTERS, PLAIN_NUMBERS)).findall
        self.beyond = re.compile("[^\x00-\u024f]").search
        self.transducer = Transducer(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 values."""
        known = self.known
        if len(known) > MOST_PIECES:
            known.clear()
        pieces = (self.split if self.beyond(text) else self.plain_split)(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            for piece in pieces:
                if piece not in known:
                    known[piece] = array("i", self.transducer.encode(piece.encode("utf-8"))).tobytes()
        return b"".join(map(known.__getitem__, pieces))


def _spelled(pattern: str, letters: str, numbers: str) -> str:
    """The pattern with its classes written out, so that every matcher takes the same characters."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}"):
            chars = letters if part == r"\p{L}" else numbers
            out.append(chars if inside else f"[{chars}]")
        elif part in (r"\s", r"\S"):
            out.append(WHITE_SPACE if inside else f"[{'^' * (part == r'\S')}{WHITE_SPACE}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """One byte of UTF-8.  A state is (bytes still due, least and greatest next byte); none: the byte can't stand here."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return state
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


START = (0, 0x80, 0xBF)


class StreamDecoder:
    """Ids, in any pieces, to the bytes of whole characters.

    Tokens that hold whole characters only leave the state machine where it is;
    the effect of the others is worked out once for each state.  Bytes of a
    character not yet ended are held back; ``valid`` turns false when a byte
    can't stand where it does (from there on bytes pass through), or when the
    end leaves a character open.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        spelled = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.tokens = pa.array(spelled, pa.large_binary())
        self.partial = np.array([token is None or self._after(START, token) != START for token in spelled])
        self.effect: dict[tuple[tuple[int, int, int], int], tuple[int, int, int] | None] = {}
        self.restart()

    def restart(self) -> None:
        self.state, self.held, self.valid = START, b"", True

    @staticmethod
    def _after(state: tuple[int, int, int], token: bytes) -> tuple[int, int, int] | None:
        for byte in token:
            state = utf8_step(state, byte)
            if state is None:
                return None
        return state

    def _moved(self, token: int) -> None:
        key = (self.state, token)
        if key not in self.effect:
            self.effect[key] = self._after(self.state, self.tokens[token].as_py())
        self.state = self.effect[key]
        self.valid = self.state is not None

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of the characters that end within these ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is not in the vocabulary")
        taken = self.tokens.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        raw = self.held + (taken.buffers()[2].to_pybytes() if len(taken) else b"")
        self.held, done = b"", -1
        if self.valid:
            if self.state != START and len(ids):
                self._moved(int(ids[0]))
                done = 0
            for at in np.flatnonzero(self.partial[ids]).tolist():
                if at <= done or not self.valid:
                    continue
                self._moved(int(ids[at]))
                while self.valid and self.state != START and at + 1 < len(ids):  # a character goes on in the next token
                    at += 1
                    self._moved(int(ids[at]))
                done = at
        if self.valid and self.state[0]:  # at most three bytes back to the lead byte of the open character
            open_bytes = next(k for k in range(1, 5) if raw[-k] >= 0xC0)
            raw, self.held = raw[:-open_bytes], raw[-open_bytes:]
        return raw

    def close(self) -> bytes:
        rest, self.held = self.held, b""
        self.valid = self.valid and not rest
        return rest


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> StreamDecoder:
    return StreamDecoder({rank: token for token, rank in load_ranks(path).items()})


def forget() -> None:
    """Let go of what a worker has worked out; it comes back as it is needed."""
    _encoder.cache_clear()
    _decoder.cache_clear()


def _field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row; ``ranks`` is the path of a rank file, present wherever the tokenizer's package is.

    Each match of ``pattern`` is encoded separately and without special tokens.
    A null or empty text has no ids; repeated rows are each encoded; other
    columns do not matter; an empty table gives an empty result.
    """
    source, schema = _with_ids(docs, id_col, text_col)
    return source.mapInArrow(_encode_scan(ranks, pattern), schema).withColumnRenamed("doc_id", id_col)


def _with_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, T.StructType]:
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source, T.StructType([_field(source, "doc_id"), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _encode_scan(ranks: str, pattern: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks, pattern).encode
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids = [encode(text) if text else b"" for text in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return scan


_DECODED = [T.StructField("decoded", T.BinaryType()), T.StructField("valid_utf8", T.BooleanType())]


def decoded(df: DataFrame, ranks: str, ids_col: str = "ids", at_once: int = 4096) -> DataFrame:
    """Adds ``decoded`` (bytes) and ``valid_utf8`` to ``df``; null ids decode to nothing.  Ids not in the vocabulary are an error."""
    kept = df.drop("decoded", "valid_utf8")
    return kept.mapInArrow(_decode_scan(ranks, ids_col, at_once), T.StructType([*kept.schema.fields, *_DECODED]))


def _decode_scan(ranks: str, ids_col: str = "ids", at_once: int = 4096):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                raw, valid = [], []
                for ids in part.column(ids_col):
                    values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                    decoder.restart()
                    pieces = [decoder.feed(values[k : k + at_once]) for k in range(0, len(values), at_once)]
                    pieces.append(decoder.close())
                    raw.append(b"".join(pieces))
                    valid.append(decoder.valid)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary()), pa.array(valid)], [*part.schema.names, "decoded", "valid_utf8"])

    return scan


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, and hashes of the ids and of the bytes they decode to, of every row."""
    source, schema = _with_ids(docs, id_col, text_col)
    encode, decode = _encode_scan(ranks, pattern), _decode_scan(ranks)
    # one pass, so that a task has one Python worker and not one for each half
    both = source.mapInArrow(lambda batches: decode(encode(batches)), T.StructType([*schema.fields, *_DECODED]))
    return both.select(
        F.col("doc_id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "valid_utf8",
    )
