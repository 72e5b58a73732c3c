"""Fill-in-middle transformation: a kernel over the UTF-8 buffer of a whole Arrow batch cuts all of its texts together.

Null texts are empty. A text is plain, and stays as it is, if it is empty, holds a mark itself, or is drawn to be; others
are cut into prefix, middle and suffix between code points. Draws follow from the seed and the key alone, so that equal
keys are drawn alike, repeated rows give repeated results, and a lost task gives the same again; a null key draws as an
empty one. Bytes that are no UTF-8 belong to the unit before them. Other columns are left out. Texts of any length are
one unit of work each; a batch holds few of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Marks before the parts, and shares in percent: of texts that are cut, and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CUT, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of bytes: those that go on with a code point, and the three places of a mark.
GOES_ON, OPENS, NAMES, CLOSES = 1, 2, 3, 4
CLASS = np.zeros(256, np.uint8)
CLASS[0x80:0xC0] = GOES_ON
for letters, kind in ((b"<", OPENS), (b"PSM", NAMES), (b">", CLOSES)):
    CLASS[list(letters)] = kind


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and ends. Nulls must be gone."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.zeros(0, np.uint8)
    return data, at - at[0]


def marks(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand within one text, in order, and in which text each."""
    found = np.flatnonzero((classes[:-2] == OPENS) & (classes[1:-1] == NAMES) & (classes[2:] == CLOSES))
    row = np.searchsorted(at, found, "right") - 1
    whole = found + 3 <= at[row + 1]
    return found[whole], row[whole]


class Units:
    """Code points of all texts of a batch: a mask of the bytes that begin one, and its running sum over the batch."""

    def __init__(self, classes: np.ndarray, at: np.ndarray):
        begins = classes != GOES_ON
        begins[at[:-1][at[:-1] < at[1:]]] = True
        self.running = np.cumsum(begins, dtype=np.int32 if len(begins) < 2**31 else np.int64)
        sums = np.concatenate([self.running[:1] * 0, self.running])
        self.before = sums[at[:-1]].astype(np.int64)  # what the sum restarts from at each text
        self.n = sums[at[1:]] - self.before

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte after so many units of each text."""
        return np.searchsorted(self.running, (self.before + units + 1).astype(self.running.dtype), "left")


def spliced(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """A text from each row of byte ranges, the ranges of a row joined."""
    at = np.concatenate([[0], np.cumsum((end - begin).sum(1))])
    whole = np.concatenate([data[a:b] for a, b in zip(begin.ravel().tolist(), end.ravel().tolist())] or [data[:0]])
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(whole))


def transformed(texts: pa.Array, first: np.ndarray, second: np.ndarray, kept: np.ndarray, suffix_first: np.ndarray) -> pa.RecordBatch:
    """Form, units, parts and output of each text, from two draws of cuts and two of form."""
    data, at = buffers(texts)
    classes = CLASS[data]
    units = Units(classes, at)
    marked = np.zeros(len(texts), bool)
    marked[marks(classes, at)[1]] = True
    plain = kept | marked | (units.n == 0)
    first, second = first % (units.n + 1), second % (units.n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    start, stop, x, y = at[:-1], at[1:], units.cut(low), units.cut(high)
    # the marks stand behind the data, so that every part of an output is a range of one buffer
    p, s, m = (np.full(len(texts), len(data) + 3 * k) for k in range(3))
    psm, spm = ((p, 3), (start, x - start), (s, 3), (y, stop - y), (m, 3), (x, y - x)), ((s, 3), (y, stop - y), (p, 3), (start, x - start), (m, 3), (x, y - x))
    begin, size = (np.where(suffix_first[:, None], np.stack([np.broadcast_to(e[k], start.shape) for e in spm], 1), np.stack([np.broadcast_to(e[k], start.shape) for e in psm], 1)) for k in (0, 1))
    begin[plain], size[plain] = 0, 0
    begin[plain, 0], size[plain, 0] = start[plain], (stop - start)[plain]
    out = spliced(np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)]), begin, begin + size)
    form = pa.array(np.where(plain, PLAIN, np.where(suffix_first, SPM, PSM)).tolist(), pa.string())
    part = lambda n: pa.array(n, pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays([pa.array(units.n, pa.int64()), form, part(low), part(high - low), out], ["n", "form", "prefix_chars", "middle_chars", "output"])


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The text from each output and its form. An output of a cut form holds three marks, and its text none."""
    data, at = buffers(outputs)
    form = np.array(forms.to_pylist(), object)
    start, stop = at[:-1], at[1:]
    begin, end = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    begin[:, 0], end[:, 0] = start, stop
    cut = form != PLAIN
    found, row = marks(CLASS[data], at)
    second, third = found[cut[row]].reshape(-1, 3)[:, 1:].T
    begin[cut], end[cut] = np.stack([start[cut] + 3, second + 3, third + 3], 1), np.stack([second, third, stop[cut]], 1)
    for kind, order in ((PSM, [0, 2, 1]), (SPM, [1, 2, 0])):  # prefix, middle, suffix
        begin[form == kind], end[form == kind] = begin[form == kind][:, order], end[form == kind][:, order]
    return spliced(data, begin, end)


def fill_in_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output; one pass, no shuffle.

    Draws are the first four groups of eight hexadecimal digits of the SHA-256 of ``seed:key``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)

    def draw(k: int) -> Column:
        return F.conv(F.substring("#digest", 8 * k + 1, 8), 16, 10).cast("long")

    def run(batches):
        for batch in batches:
            first, second, kept, spm = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            got = transformed(batch.column(1), first, second, kept, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.columns], ["k", *got.schema.names])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), digest.alias("#digest"))
    rows = rows.select("k", "t", draw(0).alias("h1"), draw(1).alias("h2"), (draw(2) % 100 >= cut).alias("kept"), (draw(3) % 100 < suffix_first).alias("spm"))
    kind = docs.schema[key].dataType.simpleString()
    out = map_arrow(rows, run, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("k", key)


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made of, from the output and the form alone. Null outputs are empty; a null form is plain."""
    names = [c for c in rows.columns if c != into]
    place, kind = names.index(output), names.index(form)

    def run(batches):
        for batch in batches:
            text = rebuilt(batch.column(place).fill_null(""), batch.column(kind).fill_null(PLAIN))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, into])

    kept = rows.select(names)
    return map_arrow(kept, run, kept.withColumn(into, F.lit(None).cast("string")).schema)
