"""Strict mapping of words to character spans of the raw text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

_SPAN = StructType([StructField("n", IntegerType()), StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("ok", BooleanType())])


def place_words(raw: str, words: list[str]) -> list[tuple]:
    """(n, a, b, ok) of each word: how many letters and numbers it has, and the characters of ``raw`` that these are, in order."""
    import regex

    kept = regex.compile(r"['\p{L}\p{N}]")
    clean = ["".join(kept.findall(w or "")) for w in words]
    at = [m.start() for m in kept.finditer(raw)]
    ok = "".join(clean) == "".join(raw[i] for i in at)
    out, done = [], 0
    for w in clean:
        placed = ok and len(w) > 0
        out.append((len(w), at[done] if placed else None, at[done + len(w) - 1] + 1 if placed else None, ok))
        done += len(w)
    return out


#: Words that Python holds as objects at once; a text is not cut.
PIECE_WORDS = 20_000


def word_spans(df: DataFrame, by: list[str], raw: str, words: str) -> DataFrame:
    """``(by, word_index, n, a, b, ok)``: the characters of the raw text that each word's letters and numbers are, in order.

    ``ok`` is false for the words of a text whose letters and numbers aren't exactly those of its words; nothing is matched loosely.
    A word without letters or numbers has no span.  Each text is placed where it lies, without a shuffle, and words leave as rows of
    numbers, some thousands at a time.
    """
    rows = df.where(F.col(raw).isNotNull() & F.col(words).isNotNull()).select(*by, F.col(raw).alias("raw_"), F.col(words).alias("words_"))
    schema = StructType([rows.schema[c] for c in by] + [StructField("word_index", IntegerType()), *_SPAN])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def told(b: pa.RecordBatch, held: list[list[tuple]], first: int) -> pa.RecordBatch:
        sizes = [len(x) for x in held]
        at = pa.array(np.repeat(np.arange(first, first + len(held)), sizes))
        index = np.concatenate([np.arange(n) for n in sizes]) if sizes else []
        columns = [index, *zip(*(x for spans in held for x in spans), strict=True)] if sum(sizes) else [[]] * 5
        mine = [b.column(i).take(at) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*mine, *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    def run(batches):
        for b in batches:
            held, first, n = [], 0, 0
            for i in range(b.num_rows):
                held.append(place_words(b.column(len(by))[i].as_py(), b.column(len(by) + 1)[i].as_py()))
                n += len(held[-1])
                if n >= PIECE_WORDS:
                    yield told(b, held, first)
                    held, first, n = [], i + 1, 0
            yield told(b, held, first)

    return rows.mapInArrow(run, schema)
