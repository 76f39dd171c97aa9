"""Delimited text whose broken lines are kept apart with the reason.

The structural test of a batch is one regular expression (quoting) and one CSV
parse whose invalid-row callback receives the lines with a wrong number of
fields.  Fields are read as strings; the judged ones are cast as vectors, and
cells that fail are named in the reason.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, free_names

#: The exported header, the type each field gets, and what the judged fields must look like.
FIELDS = {
    "game_id": "int",
    "eventnum": "int",
    "eventmsgtype": "int",
    "period": "int",
    "pctimestring": "string",
    "homedescription": "string",
    "visitordescription": "string",
    "player1_id": "int",
    "player1_team_id": "int",
}
JUDGED = {
    "eventnum": r"^0*[1-9][0-9]{0,3}$",
    "pctimestring": r"^(?:(?:0?[0-9]|1[01]):[0-5][0-9]|12:00)$",
    "player1_team_id": r"^(?:[0-9]{5}(?:\.0)?)?$",
}
WHOLE = r"^0*([0-9]{1,9})(?:\.0)?$"
QUOTING = r'\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z'
@dataclass(frozen=True)
class LineFormat:
    """Fields in order with their Spark types (int or string), and the patterns of those that are judged."""

    fields: tuple[tuple[str, str], ...] = tuple(FIELDS.items())
    judged: tuple[tuple[str, str], ...] = tuple(JUDGED.items())
    batch_bytes: int = 32 << 20


def _stand_ins(lines: pa.Array) -> dict[str, str]:
    """For each line end that is inside a line, and would end the row for the CSV reader, a character that no line holds."""
    held = lambda c: pc.any(pc.match_substring(lines, c)).as_py()
    free = (c for c in map(chr, [*range(1, 0x20), *range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE)]) if c not in "\t\n\r" and not held(c))
    return {end: next(free) for end in "\n\r" if held(end)}


def _parse(lines: pa.Array, fmt: LineFormat) -> tuple[dict[str, pa.Array], pa.Array]:
    """Field vectors (null where the line failed) and the reason of each line."""
    n = len(lines)
    names = [f for f, _ in fmt.fields]
    reason = np.full(n, None, object)
    whole = pc.fill_null(pc.match_substring_regex(lines, QUOTING), False)
    quoted = whole.to_numpy(zero_copy_only=False)
    reason[~quoted] = "quoting"
    reason[pc.is_null(lines).to_numpy(zero_copy_only=False)] = "null line"
    rest, back = lines.filter(whole), {}
    if len(rest):
        for end, stand in _stand_ins(rest).items():
            rest, back[stand] = pc.replace_substring(rest, end, stand), end
    good = np.zeros(0, np.int64)
    columns = [pa.array([], pa.string()) for _ in names]
    if len(rest):
        rows = pc.binary_join_element_wise(pc.binary_join_element_wise(pa.array(np.flatnonzero(quoted)).cast(pa.string()), rest, ","), "\n", "")
        data = pa.concat_arrays([rows]).cast(pa.large_binary())
        size = int(np.frombuffer(data.buffers()[1], np.int64)[len(data)])

        def wrong_width(row):
            reason[int(row.text.split(",", 1)[0])] = f"fields: {row.actual_columns - 1}"
            return "skip"

        table = pcsv.read_csv(
            data.buffers()[2].slice(0, size),
            read_options=pcsv.ReadOptions(use_threads=False, block_size=size + 1024, column_names=["\0line", *names]),
            parse_options=pcsv.ParseOptions(invalid_row_handler=wrong_width),
            convert_options=pcsv.ConvertOptions(
                column_types={"\0line": pa.int64(), **{f: pa.string() for f in names}}, strings_can_be_null=False, check_utf8=False
            ),
        ).combine_chunks()
        if table.num_rows:
            good = table.column(0).to_numpy()
            columns = [c.chunk(0) for c in table.columns[1:]]
    where = np.full(n, -1)
    where[good] = np.arange(len(good))
    at = pa.array(where, pa.int32(), mask=where < 0)
    judged = dict(fmt.judged)
    out: dict[str, pa.Array] = {}
    for (f, kind), v in zip(fmt.fields, columns):
        for stand, end in back.items():
            v = pc.replace_substring(v, stand, end)
        bare = pc.utf8_trim_whitespace(v)
        if f in judged:
            fine = pc.match_substring_regex(bare, judged[f]).to_numpy(zero_copy_only=False)
            for i in good[~fine]:
                reason[i] = f if reason[i] is None else f"{reason[i]}; {f}"
        if kind == "int":
            digits = pc.struct_field(pc.extract_regex(bare, WHOLE.replace("(", "(?P<d>", 1)), "d")
            v = digits.cast(pa.int32())
        elif f in judged:
            v = bare
        out[f] = v.take(at)
    return out, pa.array(reason, pa.string())


def parse_lines(df: DataFrame, line: str = "line", keep: Iterable[str] = ("line_id",), fmt: LineFormat = LineFormat()) -> DataFrame:
    """One row per line: the ``keep`` columns, the typed fields, and ``reject_reason`` (null for a valid line).

    A rejected line has null fields where it couldn't be split; fields of a line
    that splits are given as far as they cast.  A null line is rejected as
    ``null line``, an empty one for its number of fields.  Blanks and quotes
    around a judged field don't count.  Every character of a field is kept, line
    ends and control characters included.  Repeated lines give repeated rows, an
    empty table gives none.  Only ``keep`` columns of the input are carried; a
    field of the same name as one of them gets a number behind its name.
    Nothing is shuffled: every batch is parsed where it is read.
    """
    keep = list(keep)
    fields = [f for f, _ in fmt.fields]
    *named, why = free_names([*fields, "reject_reason"], keep)
    src = df.select(*[col(k) for k in keep], col(line).cast("string").alias("\0line"))
    schema = ", ".join(
        [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep] + [f"`{a}` {kind}" for a, (_, kind) in zip(named, fmt.fields)] + [f"`{why}` string"]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = whole.num_rows
            while step > 1 and whole.nbytes * step > fmt.batch_bytes * max(1, whole.num_rows):
                step = (step + 1) // 2
            for start in range(0, whole.num_rows, max(1, step)):
                b = whole.slice(start, step)
                lines = b.column(len(keep))
                if pa.types.is_large_string(lines.type):
                    lines = lines.cast(pa.string())
                out, reason = _parse(lines, fmt)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[out[f] for f in fields], reason], names=[*keep, *named, why])

    return src.mapInArrow(kernel, schema)


def valid_lines(parsed: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """The typed rows of the lines that hold."""
    return parsed.filter(col(reason).isNull()).drop(reason)


def rejected_lines(parsed: DataFrame, keep: Iterable[str] = ("line_id",), reason: str = "reject_reason") -> DataFrame:
    """Key and reason of the lines that fail."""
    return parsed.filter(col(reason).isNotNull()).select(*[col(k) for k in keep], F.col(reason))
