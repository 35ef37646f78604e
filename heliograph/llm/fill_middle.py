"""Operator 12, fill-in-middle transformation: texts cut at two random token boundaries and put together in another order.

Each text is decoded to an array of code points.  A token is the white space
before a word and the word, or white space at the text's end; it begins at the
text's start and wherever white space follows a character that is none, so
comparing the classes of neighbours and ``flatnonzero`` give all boundaries.  The
hash of the row's id picks two of them by rank; the three pieces are sliced and
encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import byte_slices

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

#: Code points of ``[\x20\x09-\x0D]``.
_SPACES = np.zeros(0x21, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Code points that are looked at together, so that the working arrays of a very long text stay small.
BLOCK_POINTS = 1 << 20


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens begin in an array of code points, and its length."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    found = [np.zeros(1, dtype=np.int64)]
    last = True  # before the text counts as white space: its start is a boundary already
    for begin in range(0, len(points), BLOCK_POINTS):
        block = points[begin : begin + BLOCK_POINTS]
        space = (block <= 0x20) & _SPACES[np.minimum(block, 0x20)]
        turns = space.copy()
        turns[1:] &= ~space[:-1]
        turns[0] &= not last
        last = bool(space[-1])
        found.append(np.flatnonzero(turns) + begin)
    return np.concatenate([*found, [len(points)]])


def ranks_of(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


@dataclass(frozen=True)
class Plan:
    """How texts are turned: ``rate`` of 100 are, ``suffix_first`` of 100 of them begin with the suffix."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80


def turned(text: str, key: object, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and of middle, output."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    h1, h2, h3, h4 = ranks_of(key, plan.seed)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, at[first]), (at[first], at[second]), (at[second], len(points))))
    to_prefix, to_suffix, to_middle = MARKS
    if h4 % 100 < plan.suffix_first:
        return n, "spm", int(at[first]), int(at[second] - at[first]), f"{to_suffix}{suffix}{to_prefix}{prefix}{to_middle}{middle}"
    return n, "psm", int(at[first]), int(at[second] - at[first]), f"{to_prefix}{prefix}{to_suffix}{suffix}{to_middle}{middle}"


def restored(output: str, form: str) -> str:
    """The text that :func:`turned` was given, from its output and form alone.

    A turned text holds no mark of its own and no mark can begin inside another,
    so the first place of each mark is where it was put.
    """
    if form == "plain":
        return output
    to_prefix, to_suffix, to_middle = MARKS
    opening, between = (to_suffix, to_prefix) if form == "spm" else (to_prefix, to_suffix)
    one, _, rest = output.removeprefix(opening).partition(between)
    two, _, middle = rest.partition(to_middle)
    return two + middle + one if form == "spm" else one + middle + two


def transformed(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored`` for every row of ``docs``.

    ``restored`` is rebuilt from ``output`` and ``form``, for checking.  A null
    text counts as empty: no tokens, form ``plain``; a null id is hashed as no
    digits; a text of white space is one token; rows of one id and text give the
    same output; other columns do not matter, whatever their names; an empty
    table gives an empty result.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()), ("restored", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(*f) for f in fields)])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = [turned(text or "", key, plan) for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                again = pa.array([restored(row[4], row[1]) for row in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, again], schema.names)

    return source.mapInArrow(scan, schema)


def digested(found: DataFrame) -> DataFrame:
    """The rows of :func:`transformed` with hashes in place of texts."""
    sha = lambda column: F.sha2(F.col(column).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


#: The same over ``documents`` with the settings of :class:`Plan`, in DuckDB's SQL.
ORACLE_SQL = r"""
with source as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), hashed as (
  select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from source
), ranked as (
  select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from hashed
), cut as (
  select *, coalesce(array_to_string(list_slice(tokens, 1, a), ''), '') as prefix, coalesce(array_to_string(list_slice(tokens, a + 1, b), ''), '') as middle,
    coalesce(array_to_string(list_slice(tokens, b + 1, n), ''), '') as suffix
  from ranked
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""
