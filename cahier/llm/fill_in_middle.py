"""Fill-in-the-middle transformation with a learned rank index.

The units of a text are runs of ASCII letters and single other code points. A piecewise-linear index maps a unit's rank
to the byte at which it begins: segments are fitted greedily so that no boundary is farther than ERROR bytes from its
segment's line, and what is missing is stored as one signed byte per boundary. A cut is predicted from its segment and
corrected by its residual, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import text_blocks

#: Residuals fit a signed byte.
ERROR = 127
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Boundaries that are looked at together while a segment grows.
_LOOK = 4096


@dataclass
class RankIndex:
    """Per segment its first rank, the offset there and the slope; per boundary the residual. ``n`` units have n + 1
    boundaries, the text's end included."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @property
    def n(self) -> int:
        return len(self.residual) - 1

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def cut(self, rank: int) -> int:
        """The byte at which the unit of this rank begins."""
        return int(self.predict(np.array([rank]))[0]) + int(self.residual[rank])


def boundaries(data: np.ndarray) -> np.ndarray:
    """The bytes of UTF-8 at which units begin, and the end. Only letters stick together."""
    if not len(data):
        return np.zeros(1, np.int64)
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(begins), len(data))


def fit(b: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments over boundaries ``b``: each runs as far as one slope from its first point stays within ``error - 1`` of
    all its points (the last byte of room is for rounding)."""
    first, slope, at = [], [], 0
    room = error - 1
    while at < len(b):
        low, high, to = -np.inf, np.inf, at + 1
        while to < len(b):
            ranks = np.arange(to, min(len(b), to + _LOOK))
            rise, run = b[ranks] - b[at], ranks - at
            lows = np.maximum(low, np.maximum.accumulate((rise - room) / run))
            highs = np.minimum(high, np.minimum.accumulate((rise + room) / run))
            bad = np.flatnonzero(lows > highs)
            fits = int(bad[0]) if len(bad) else len(ranks)
            if fits:
                low, high, to = lows[fits - 1], highs[fits - 1], to + fits
            if len(bad):
                break
        first.append(at)
        slope.append((low + high) / 2 if to > at + 1 else 0.0)
        at = to
    index = RankIndex(np.array(first), b[np.array(first)], np.array(slope), np.zeros(len(b), np.int8))
    left = b - index.predict(np.arange(len(b)))
    assert np.abs(left).max() <= error
    index.residual = left.astype(np.int8)
    return index


def _draw(seed: int, key: Column, part: int) -> Column:
    """The part-th group of eight hexadecimal digits of the SHA-256 of 'seed:key', as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output, n_segments.

    Both cuts are drawn from the id and the seed by SHA-256, so reruns agree. A text is left plain (null lengths) if it
    is empty, holds a marker already, or by draw in ``plain_percent`` of 100 cases; of the others ``spm_percent`` of 100
    have the suffix first. Null texts are empty; a null id is drawn for as an empty one; texts are cut whole, whatever
    their length; repeated rows give equal rows; an empty table gives none; other columns are not read. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[_draw(seed, F.col(id_col), i).alias(f"h{i + 1}") for i in range(4)])
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in text_blocks(batches):
            draws = [b.column(i).to_numpy() for i in range(2, 6)]
            units, segments, form, prefix, middle, out = [], [], [], [], [], []
            for i in range(b.num_rows):
                own = data[off[i] : off[i + 1]]
                index = fit(boundaries(own))
                h1, h2, h3, h4 = (int(d[i]) for d in draws)
                raw, n = own.tobytes(), index.n
                units.append(n)
                segments.append(len(index.first))
                if not raw or h3 % 100 >= 100 - plain_percent or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    out.append(raw)
                    continue
                a, z = sorted((index.cut(h1 % (n + 1)), index.cut(h2 % (n + 1))))
                head, mid, tail = raw[:a], raw[a:z], raw[z:]
                swap = h4 % 100 < spm_percent
                form.append("spm" if swap else "psm")
                prefix.append(int(((own[:a] & 0xC0) != 0x80).sum()))
                middle.append(int(((own[a:z] & 0xC0) != 0x80).sum()))
                parts = ((SUFFIX, tail), (PREFIX, head), (MIDDLE, mid)) if swap else ((PREFIX, head), (SUFFIX, tail), (MIDDLE, mid))
                out.append(b"".join(m.encode() + p for m, p in parts))
            cols = [pa.array(units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()), pa.array(segments, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"])

    made = slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary, n_segments long")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text from an output and its form: the parts between the markers in their old order. Texts with markers of
    their own are plain, so each marker's first place is its own."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    first, second, third = F.instr(out, PREFIX), F.instr(out, SUFFIX), F.instr(out, MIDDLE)

    def between(a: Column, z: Column) -> Column:
        return F.substring(out, a + 3, z - a - 3)

    rest = F.substring(out, third + 3, F.length(out))
    psm = F.concat(between(first, second), rest, between(second, third))
    spm = F.concat(between(first, third), rest, between(second, first))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)


ORACLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS x, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(x) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(x[1:a], '') AS pre, array_to_string(x[a + 1:z], '') AS mid, array_to_string(x[z + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
