"""Fill-in-the-middle examples with cuts at line ends.

A text is cut into lines; two seeded cuts make prefix, middle and suffix, which
are written in one of two orders behind the marks ``<P>``, ``<S>`` and ``<M>``.

Lines are found eight bytes at a time: the UTF-8 bytes of a block of texts are
viewed as 64-bit words. Arithmetic on a word sets the high bit of each of its
bytes that ends a line (and, in a second array, of each that continues a code
point). ``bitwise_count`` per word and their running sums rank any place; the
k-th line end is the word found in the sums, then the byte found in the word by
clearing its lower marks.

Defined results: a null text is empty, and an empty text is plain; a text that
holds one of the marks is plain, so that ``restore`` is exact; a row without a
doc_id has nothing that seeds its cuts and is plain; every row gives one row,
repeated rows give equal ones; an empty table gives none; very long texts are
worked on whole, in arrays of an eighth of their bytes; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import arrow_map, blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_EACH = np.uint64(0x0101010101010101)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_ONE, _EIGHT = np.uint64(1), np.uint64(8)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, zeros behind them: one word more than
    whole ones at least, so that the place behind the last byte has one."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte that equals ``byte``, exactly."""
    x = words ^ (_EACH * np.uint64(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuing_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte 10xxxxxx."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before each place."""
        word = place >> 3
        below = (_ONE << (_EIGHT * (place & 7).astype(np.uint64))) - _ONE
        return self.sums[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, k from 1."""
        word = np.searchsorted(self.sums, k, "left") - 1
        left, m = k - self.sums[word], self.marks[word]
        for j in range(1, 8):
            m = np.where(left > j, m & (m - _ONE), m)
        return 8 * word + (np.bitwise_count((m & (~m + _ONE)) - _ONE) >> 3)


def _cut(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """(lines, place of the first cut, of the second, code points of prefix and
    middle) of each text."""
    words = words_of(data)
    ends, more = Marks(equal_bytes(words, 0x0A)), Marks(continuing_bytes(words))
    start, end = bounds[:-1], bounds[1:]
    before = ends.rank(start)
    closed = ends.rank(end) - before
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
    n = closed + ((end > start) & (last != 0x0A))
    a, b = h1 % (n + 1), h2 % (n + 1)

    def behind(k: np.ndarray) -> np.ndarray:
        """The place behind each text's k-th line."""
        out = np.where(k == 0, start, end)
        at = np.flatnonzero((k > 0) & (k <= closed))
        out[at] = ends.select(before[at] + k[at]) + 1
        return out
    one, two = behind(np.minimum(a, b)), behind(np.maximum(a, b))

    def points(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (y - x) - (more.rank(y) - more.rank(x))
    return n, one, two, points(start, one), points(one, two)


def fill_in_middle(docs: DataFrame, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Per row: doc_id, n (lines), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output. A map: nothing is shuffled."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("long").cast("string")), 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])

    def run(batch: pa.RecordBatch):
        ids, h = batch.column("doc_id"), [batch.column(f"h{k}").fill_null(0).to_numpy() for k in (1, 2, 3, 4)]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        for b in blocks(batch.column("text")):
            own = slice(b.rows.start, b.rows.stop)
            n, one, two, prefix, middle = _cut(b.data, b.bounds, h[0][own], h[1][own])
            wanted = known[own] & (h[2][own] % 100 < fim_percent)
            suffix_first = h[3][own] % 100 < spm_percent
            form, output = [], []
            for i in range(len(b.rows)):
                text = b.data[b.bounds[i]:b.bounds[i + 1]].tobytes()
                x, y = one[i] - b.bounds[i], two[i] - b.bounds[i]
                if not text or not wanted[i] or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    form.append("plain")
                    output.append(text)
                elif suffix_first[i]:
                    form.append("spm")
                    output.append(b"".join((SUFFIX, text[y:], PREFIX, text[:x], MIDDLE, text[x:y])))
                else:
                    form.append("psm")
                    output.append(b"".join((PREFIX, text[:x], SUFFIX, text[y:], MIDDLE, text[x:y])))
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(b.rows.start, len(b.rows)), pa.array(n.astype(np.int64)), pa.array(form, pa.string()),
                 pa.array(prefix.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain),
                 pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return arrow_map(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The exact text from an example and its form. No text in psm or spm form
    holds a mark, and marks can't overlap, so there are three places to split."""
    psm = form == "psm"
    whole = F.transform(F.array(F.split(output, "<[PSM]>", -1)), lambda x: F.concat(
        F.when(psm, x[1]).otherwise(x[2]), x[3], F.when(psm, x[2]).otherwise(x[1])))
    return F.when(form == "plain", output).otherwise(whole[0])
