"""Quality rules whose thresholds come from the data, per language and source.

Every document gets a few counts. Their rates are summarised by quantile sketches
with bins of fixed relative width (a bin is a power of ``GAMMA``), so a sketch is a
set of (bin, count) rows, merging is adding counts, and the result does not depend
on how rows were dealt out. Sketches are kept per (language, source); groups with few
documents use the merged sketch of their language, and small languages that of all.
A document is out of line when a rate lies beyond the quartile fences of its group.

Null or empty texts count nothing; null languages and sources are groups of their
own; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx
from tidemark.llm.scratch import Scratch

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Relative width of a sketch's bins.
GAMMA = 1.02
#: Documents a group needs for thresholds of its own.
ENOUGH = 200
#: Quartile ranges beyond the quartiles that still pass.
REACH = 4.0
#: Per rate: the least slack on top of the quartiles, and whether low values are judged too.
RATES: dict[str, tuple[float, bool]] = {
    "word_length": (2.0, True),
    "symbols": (0.1, False),
    "dup_lines": (0.2, False),
    "repeats": (0.15, False),
}

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    bits = np.zeros(1 << 16, bool)
    bits[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = bits[(keys & np.uint64(0xFFFF)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(twice, keys[maybe])
    out[maybe] = twice[np.minimum(at, len(twice) - 1)] == keys[maybe]
    return out


def _line_counts(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def count_texts(data: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(off) - 1
    w = tx.words(data, off)
    out = {"n_words": np.diff(w.first)}
    ink = np.zeros(len(data) + 1, np.int64)
    in_word = tx.covered(len(data), w.start, w.end - w.start) if len(w) else np.zeros(len(data), bool)
    np.cumsum(in_word & ((data & 0xC0) != 0x80), out=ink[1:])
    out["word_chars"] = ink[off[1:]] - ink[off[:-1]]
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=signs[1:])
    out["n_symbols"] = signs[off[1:]] - signs[off[:-1]]
    lines = [_line_counts(data[off[i] : off[i + 1]].tobytes()) for i in range(n)]
    out["n_lines"] = np.array([x[0] for x in lines], np.int64)
    out["n_dup_lines"] = np.array([x[1] for x in lines], np.int64)

    grams = tx.window_hashes(tx.word_hashes(data, w), window)
    doc = w.text_of()
    at = np.flatnonzero(doc[: len(grams)] == doc[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
    keys = tx.mix(grams[at] ^ tx.mix(doc[at].astype(np.uint64) + np.uint64(1))) if len(at) else np.zeros(0, np.uint64)
    again = np.zeros(len(w) + 1, np.int64)
    if len(at):
        np.cumsum(tx.covered(len(w), at[_repeated(keys)], window), out=again[1:])
    out["n_repeat_words"] = again[w.first[1:]] - again[w.first[:-1]]
    return out


def document_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` without its text, with the counts added."""
    rest = docs.drop(text, *COUNTS)
    names = rest.columns
    schema = T.StructType([*rest.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(len(names)))
            for lo, hi in tx.slices(off):
                found = count_texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[c]) for c in COUNTS)], names=[*names, *COUNTS])

    return docs.select(*names, text).mapInArrow(counted, schema)


def rates() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
    }


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, rate, bin, n): the sketches of several rates. Adding n merges sketches."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), v.cast("double").alias("value")) for k, v in values.items())))
    bin_of = F.when(F.col("v.value") > 0, F.ceil(F.log("v.value") / F.log(F.lit(GAMMA)))).otherwise(F.lit(-(1 << 40)))
    return (
        rows.select(*keys, each.alias("v"))
        .groupBy(*keys, F.col("v.rate").alias("rate"), bin_of.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, docs, q1, q3) from sketch rows; a group has a bounded number of bins."""
    merged = sketches.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    each = Window.partitionBy(*keys, "rate")
    upto = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.when(F.col("bin") == -(1 << 40), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") - 0.5))
    ranked = merged.select(*keys, "rate", middle.alias("value"), F.sum("n").over(upto).alias("_upto"), F.sum("n").over(each).alias("_all"))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("value")))
    return ranked.groupBy(*keys, "rate").agg(F.max("_all").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, rate, low, high): the limits of every group that has rows."""
    levels = [["lang", "source"], ["lang"], []]
    found = [quartiles(sketches, keys) for keys in levels]
    out = sketches.select("lang", "source", "rate").distinct()
    for i, (keys, q) in enumerate(zip(levels, found, strict=True)):
        q = q.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("rate").alias("_rate"), F.struct("docs", "q1", "q3").alias(f"_{i}"))
        match = F.col("rate") == F.col("_rate")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(q, match).drop("_rate", *(f"_{k}" for k in keys))
    use = F.when(F.col("_0.docs") >= ENOUGH, F.col("_0")).when(F.col("_1.docs") >= ENOUGH, F.col("_1")).otherwise(F.col("_2"))
    slack = F.coalesce(*(F.when(F.col("rate") == k, F.lit(v[0])) for k, v in RATES.items()))
    both = F.coalesce(*(F.when(F.col("rate") == k, F.lit(v[1])) for k, v in RATES.items()))
    span = REACH * (F.col("_use.q3") - F.col("_use.q1")) + slack
    return out.withColumn("_use", use).select(
        "lang",
        "source",
        "rate",
        F.when(both, F.col("_use.q1") - span).otherwise(F.lit(float("-inf"))).alias("low"),
        (F.col("_use.q3") + span).alias("high"),
    )


def quality_filter(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed (fixed rules), and
    kept (base rules hold and no rate lies beyond its group's fences).

    Sketches are made of the documents that pass the base rules.
    """
    work = Scratch(docs.sparkSession, "quality")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = document_counts(named)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = work.save(counted.withColumn("base_failed", failed), "counts")
    limits = fences(work.save(sketch(counted.where(~F.col("base_failed")), ["lang", "source"], rates()), "sketches"))
    bounds = limits.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("rate") == k, F.col(side))).alias(f"{k}_{side}") for k in RATES for side in ("low", "high"))
    )
    bounds = work.save(bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "bounds")
    inside = F.lit(True)
    for k, value in rates().items():
        inside = inside & (value >= F.col(f"{k}_low")) & (value <= F.col(f"{k}_high"))
    match = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return counted.join(bounds, match, "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")
    )
