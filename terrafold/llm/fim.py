"""Fill-in-the-middle transformation by a two-pass matcher that streams over units.

A text is a run of units, the matches of a pattern taken left to right (code points unless told otherwise). The first pass over a
text only counts its matches; two ranks are drawn from hashes of the document's id; the second pass advances a lazy iterator of matches to
the smaller rank and on to the larger, and reads off where those units end. No pass keeps a unit: beside the text
itself, memory is one match and two places, however long the text is. What stands between or before units stays with the part in
which it begins, so nothing is lost for patterns that leave gaps.

Prefix, middle and suffix are put in one of two orders, each part behind its mark:

- psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle
- spm: suffix mark, suffix, prefix mark, prefix, middle mark, middle

All other texts are plain and stay as they are: empty and null ones (null counts as empty), texts that hold a mark already, and the share that
the rate leaves. `restore` gives the exact text back from output and form; marks must begin with a character that they hold nowhere else, so that
no mark can arise where a part meets one.

The draws hash `1:` and the decimal doc_id, so rows of one id and equal text are cut alike, wherever and however often they are. A null
doc_id is drawn as an id without digits. Very long texts are cut whole, in one task each, as is every row. Other columns pass through
unchanged, the result is one struct column, `fim`, or `fim_2` and so on where a column has that name already. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
#: Characters of output that leave a task at once (one longer text leaves alone).
BATCH_CHARS = 1 << 22


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for mark in self.all():
            if not mark or mark[0] != self.prefix[0] or mark.count(mark[0]) != 1:
                raise ValueError(f"marks begin with one character that they hold nowhere else: {mark!r}")
        if len({*self.all()}) < 3 or any(a != b and a.startswith(b) for a in self.all() for b in self.all()):
            raise ValueError("no mark may begin another")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def count_units(units: re.Pattern, text: str) -> int:
    """How many units a text has; matches are dropped as they come."""
    numbers = count()
    deque(zip(units.finditer(text), numbers), maxlen=0)
    return next(numbers)


def find_cuts(units: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first so many units end, and the second so many (not fewer): one iterator goes on from cut to cut."""
    matches = units.finditer(text)

    def advance(steps: int, at: int) -> int:
        last = deque(islice(matches, steps), maxlen=1)
        return last[0].end() if last else at

    one = advance(first, 0)
    return one, advance(second - first, one)


def draws(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearrange(text: str, doc_id: int | None, units: re.Pattern, marks: Marks, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    n = count_units(units, text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in marks.all()):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = find_cuts(units, text, a, b)
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((marks.suffix, text[b:], marks.prefix, text[:a], marks.middle, text[a:b]))
    return n, "psm", a, b - a, "".join((marks.prefix, text[:a], marks.suffix, text[b:], marks.middle, text[a:b]))


_SCHEMA = pa.schema([("units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def fill_in_middle(docs: DataFrame, pattern: str = CODE_POINT, marks: Marks = Marks(), rate: int = 90, spm: int = 20) -> DataFrame:
    """The documents' columns and, last, a struct: units, form (plain, psm, spm), prefix_chars, middle_chars, output.

    rate: of 100 texts, how many are rearranged; spm: of 100 of those, how many have the suffix first.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            made, size, start = [], 0, 0
            for k, (doc_id, text) in enumerate(zip(batch.column(own.index("doc_id")), batch.column(own.index("text")))):
                made.append(rearrange(text.as_py() or "", doc_id.as_py(), units, marks, rate, spm))
                size += len(made[-1][-1])
                if size > BATCH_CHARS or k == batch.num_rows - 1:
                    columns = [pa.array(values, f.type) for values, f in zip(zip(*made), _SCHEMA)]
                    columns[-1] = columns[-1].cast(pa.string()) if size < 1 << 29 else columns[-1]
                    struct = pa.StructArray.from_arrays(columns, [f.name for f in _SCHEMA])
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(made)).columns, struct], [*inner, "fim"])
                    made, size, start = [], 0, k + 1

    own = docs.columns
    name, k = "fim", 2
    while name in own:
        name, k = f"fim_{k}", k + 1
    # columns go by number meanwhile, so names that clash don't matter
    inner = [f"own{k}" for k in range(len(own))]
    cast = {"doc_id": "long", "text": "string"}
    numbered = docs.select(*(F.col(f"`{c}`").cast(cast[c]).alias(i) if c in cast else F.col(f"`{c}`").alias(i) for c, i in zip(own, inner)))
    fields = ", ".join(f"{i} {f.dataType.simpleString()}" for i, f in zip(inner, numbered.schema))
    out = numbered.mapInArrow(work, f"{fields}, fim struct<units:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, own)), F.col("fim").alias(name))


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from: parts are found by their marks."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.char_length(one) + len(second) + 1, F.char_length(rest))
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, F.substring(rest, F.char_length(two) + len(marks.middle) + 1, F.char_length(rest))

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    suffix_2, prefix_2, middle_2 = parts(marks.suffix, marks.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
