"""Fill-in-middle: a text is cut into units, dealt into prefix, middle and suffix, and put together anew.

A batch runs through Arrow's functions alone. Units (runs of letters, else single characters) are split
into lists; the lists are flattened beside the indices of their texts; a unit's ordinal tells its role;
the units of each role are filtered and rebuilt as lists, and the pieces joined.

A text's two cuts and its form are hashed from seed and id, so they are the same under any partitioning.
A null text counts as empty, a null id as the empty string; repeated rows are cut alike; texts of any
length are cut whole, some STEP bytes of short texts at a time. Columns that clash with an output column
are replaced, all others pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialis.llm.common import free_name

#: What stands before the parts of a text, and the units as bytes of UTF-8.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc2-\xf4][\x80-\xbf]+)"
#: A byte that UTF-8 never holds: it parts the units.
END = b"\xff"
#: Bytes of text that are cut at a time.
STEP = 4_000_000
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows in order, some STEP bytes of text at a time, with their texts as bytes (null: none)."""
    for b in batches:
        texts = pc.fill_null(b.column(b.schema.get_field_index(text)).cast(pa.large_binary()), b"")
        block = np.cumsum(pc.binary_length(texts).to_numpy()) // STEP
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                yield b.slice(i, j - i), texts[i:j]


def units_of(texts: pa.Array) -> pa.Array:
    """Each text's list of units, and an empty one at its end."""
    return pc.split_pattern(pc.replace_substring_regex(texts, UNIT, b"\\1" + END), END)


def three_parts(units: pa.Array, lower: np.ndarray, upper: np.ndarray) -> list[pa.Array]:
    """The joined units before `lower`, from there to before `upper`, and from there on."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units).to_numpy()
    size = pc.list_value_length(units).to_numpy().astype(np.int64)
    ordinal = np.arange(len(flat)) - (np.cumsum(size) - size)[parent]
    role = (ordinal >= lower[parent]).astype(np.int8) + (ordinal >= upper[parent])
    parts = []
    for r in range(3):
        own = role == r
        ends = np.concatenate([[0], np.cumsum(np.bincount(parent[own], minlength=len(units)))])
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(own)).cast(pa.binary())), b"").cast(pa.large_binary()))
    return parts


def transformed(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts with the numbers h1 to h4."""
    units = units_of(texts)
    n = pc.list_value_length(units).to_numpy().astype(np.int64) - 1
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    prefix, middle, suffix = three_parts(units, np.minimum(a, b), np.maximum(a, b))
    marked = [pc.match_substring(texts, m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(marked[0], marked[1]), pc.or_(marked[2], pa.array((n == 0) | (h[2] % 100 >= fim_percent))))
    spm = pa.array(h[3] % 100 < spm_percent)
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    none = pa.scalar(b"", pa.large_binary())
    mixed = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return [pa.array(n), form, *chars, pc.if_else(plain, texts, mixed).cast(pa.large_string()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if
    plain) and output.

    `fim_percent` of the documents that hold none of the marks are cut, `spm_percent` of these with the
    suffix first. The text itself has to be named otherwise than an output column.
    """
    added = T.StructType.fromDDL(COLUMNS)
    rest = docs.drop(*added.names)
    names = [free_name(rest, f"fim_{i}") for i in range(4)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    numbers = {name: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, text):
            h = [b.column(b.schema.get_field_index(name)).to_numpy() for name in names]
            kept = b.drop_columns(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, *transformed(texts, h, fim_percent, spm_percent)], names=[*kept.schema.names, *added.names])

    return rest.withColumns(numbers).mapInArrow(run, T.StructType([*rest.schema.fields, *added.fields]))


def restored(outputs: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that were put together as `outputs`."""
    none = pa.scalar(b"", pa.large_binary())
    plain = pc.equal(form, "plain")
    # A mixed output parts into nothing, and what follows each of its three marks.
    lists = pc.split_pattern_regex(pc.if_else(plain, pa.scalar(b"<P><S><M>", pa.large_binary()), outputs), "<[PSM]>")
    first, second, middle = (pc.list_element(lists, i) for i in (1, 2, 3))
    mixed = pc.if_else(pc.equal(form, "spm"), pc.binary_join_element_wise(second, middle, first, none), pc.binary_join_element_wise(first, middle, second, none))
    return pc.if_else(plain, outputs, mixed)


def restore_text(df: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """`df` with the text that `output` was made of, from output and form alone; a null form is plain."""
    rest = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, outputs in slices(batches, output):
            back = restored(outputs, pc.fill_null(b.column(b.schema.get_field_index(form)), "plain"))
            yield pa.RecordBatch.from_arrays([*b.columns, back.cast(pa.large_string()).cast(pa.string())], names=[*b.schema.names, to])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(to, T.StringType())]))


#: The same rows in DuckDB, for the defaults over `documents`.
SQL = """
with d as (select doc_id, coalesce(text, '') as s, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
cut as (select *, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') as u, list_transform(range(0, 4), lambda i: ('0x' || substr(h, (8 * i + 1)::int, 8))::bigint) as k from d),
placed as (select *, len(u) as n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) as lo, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) as hi,
    case when s = '' or contains(s, '<P>') or contains(s, '<S>') or contains(s, '<M>') or k[3] % 100 >= 90 then 'plain' when k[4] % 100 < 20 then 'spm' else 'psm' end as form from cut),
parts as (select *, array_to_string(u[1:lo], '') as p, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:], '') as x from placed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
    sha256(case form when 'plain' then s when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256, sha256(s) as restored_sha256 from parts
"""
