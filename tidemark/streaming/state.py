"""The latest view as a table that micro-batches add to.

Each micro-batch folds its own writes and adds the partial rows as one
``delta/batch=<label>/`` folder: cost grows with the batch, not with the state. Only
after the folder is complete is the batch committed, by an empty file in ``commits/``;
readers and ``compact`` see committed batches and nothing else.

``compact`` folds the committed batches into the base. Rows are dealt into buckets by the
low bits of a hash of the entity, and only buckets that the batches touch are written
again. A bucket that would outgrow ``BUCKET_BYTES`` is split by one bit, or several, as it
is written: buckets stay of one size, and their number, with the tasks of a compaction,
grows with the state. The last step is a file in ``generations/`` that names the buckets,
for each the folder that holds it, and the batches that are folded in. Merging a partial
row twice changes nothing, so a batch that is replayed after it was folded does no harm,
and a reader that still uses the generation before sees the same state. ``changes`` tells
what two generations differ in, from the buckets that do. ``vacuum`` removes what no
generation since the newest needs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.files import Files
from tidemark.functions.timefns import as_of_literal, ntz_to_micros
from tidemark.operators.latest import LAST_WRITE, finish_view, merge_partials, partial_rows, partial_schema
from tidemark.spec import EVENT_TS, FeatureGroup

#: Hash bits that buckets of a new state go by: 32 buckets.
DEPTH = 5
#: Bytes of a bucket, beyond which it is split.
BUCKET_BYTES = 256 << 20
#: Hash bits that a bucket can go by. The list of buckets by these bits is one literal.
MOST_DEPTH = 20


@dataclass(frozen=True)
class _Generation:
    """Buckets are numbered 2^depth + bits: bucket b splits into 2 * 2^depth + bits and that
    plus 2^depth. Every hash ends in the bits of exactly one bucket."""

    number: int
    buckets: tuple[int, ...]
    #: The generation whose folder holds a bucket; an empty bucket has none.
    folders: dict[int, int]
    folded: frozenset[str]


def _new_buckets(depth: int = DEPTH) -> tuple[int, ...]:
    return tuple((1 << depth) + b for b in range(1 << depth))


def _depth(bucket: int) -> int:
    return bucket.bit_length() - 1


def _split(bucket: int, times: int) -> list[int]:
    """The buckets that one becomes when it is split so many times."""
    found = [bucket]
    for _ in range(times):
        size = 1 << _depth(found[0])
        found = [child for b in found for child in (b + size, b + 2 * size)]
    return sorted(found)


def _generation(files: Files, path: str, number: int) -> _Generation:
    if number == 0:
        return _Generation(0, _new_buckets(), {}, frozenset())
    found = json.loads(files.read(f"{path}/generations/{number}"))
    folders = {int(b): g for b, g in found["folders"].items()}
    return _Generation(number, tuple(found["buckets"]), folders, frozenset(found["folded"]))


def _newest(files: Files, path: str) -> _Generation:
    return _generation(files, path, max((int(n) for n in files.names(f"{path}/generations")), default=0))


def newest_generation(spark: SparkSession, path: str) -> int:
    """The number of the last compaction; 0 before the first."""
    return _newest(Files(spark), path).number


def _keep(files: Files, path: str, at: _Generation) -> None:
    known = {"buckets": list(at.buckets), "folders": at.folders, "folded": sorted(at.folded)}
    files.write(f"{path}/generations/{at.number}", json.dumps(known))


def _bucket(fg: FeatureGroup, buckets: tuple[int, ...]) -> Column:
    """The bucket of an entity, looked up by as many bits as the finest bucket has."""
    deepest = max(_depth(b) for b in buckets)
    by_bits = [0] * (1 << deepest)
    for b in buckets:
        size = 1 << _depth(b)
        by_bits[b - size :: size] = [b] * (len(by_bits) // size)
    # Parsed once, when the plan is made.
    known = F.from_json(F.lit(json.dumps(by_bits)), "array<int>")
    bits = F.xxhash64(fg.entity).bitwiseAND(F.lit((1 << deepest) - 1).cast("bigint"))
    return F.get(known, bits.cast("int"))


def add_writes(fg: FeatureGroup, writes: DataFrame, path: str, batch: str) -> None:
    """Add one micro-batch and commit it; adding the same batch again replaces it."""
    files = Files(writes.sparkSession)
    files.delete(f"{path}/commits/{batch}")
    partial_rows(fg, writes).write.mode("overwrite").option("compression", "zstd").parquet(
        f"{path}/delta/batch={batch}"
    )
    files.write(f"{path}/commits/{batch}", "")


def _read(spark: SparkSession, fg: FeatureGroup, paths: list[str]) -> DataFrame | None:
    """Partial rows in the shape of the current spec: a feature added after a file was
    written is null there."""
    if not paths:
        return None
    entity = fg.entity_dtype.spark_type if fg.entity_dtype else spark.read.parquet(paths[0]).schema[fg.entity].dataType
    return spark.read.schema(partial_schema(fg, entity)).parquet(*paths)


def _deltas(spark: SparkSession, fg: FeatureGroup, path: str, batches: list[str]) -> DataFrame | None:
    return _read(spark, fg, [f"{path}/delta/batch={b}" for b in batches])


def _base(spark: SparkSession, fg: FeatureGroup, path: str, at: _Generation, only: set[int] | None = None) -> DataFrame | None:
    folders = [f"{path}/base/gen={g}/bucket={b}" for b, g in sorted(at.folders.items()) if only is None or b in only]
    return _read(spark, fg, folders)


def _together(parts: list[DataFrame | None]) -> DataFrame | None:
    found = [p for p in parts if p is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else None


def _pending(files: Files, path: str, at: _Generation) -> list[str]:
    return [b for b in files.names(f"{path}/commits") if b not in at.folded]


def read_latest(
    spark: SparkSession, fg: FeatureGroup, path: str, as_of: object = None
) -> DataFrame:
    """The latest view of all committed batches; with ``as_of``, without the records
    expired by then."""
    files = Files(spark)
    at = _newest(files, path)
    rows = _together([_base(spark, fg, path, at), _deltas(spark, fg, path, _pending(files, path, at))])
    if rows is None:
        raise FileNotFoundError(f"no state below {path}")
    return finish_view(fg, merge_partials(fg, rows), as_of)


def _sizes(files: Files, path: str, at: _Generation, touched: list[int], delta_bytes: int) -> dict[int, int]:
    """About how many bytes the touched buckets will have: what is there, and their share of
    the new rows."""
    share = delta_bytes // max(1, len(touched))
    held = {b: files.size(f"{path}/base/gen={at.folders[b]}/bucket={b}") if b in at.folders else 0 for b in touched}
    return {b: n + share for b, n in held.items()}


def compact(spark: SparkSession, fg: FeatureGroup, path: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Fold the committed batches into the base and return the new generation's number.

    One compaction runs at a time; ingestion and readers need not stop.
    """
    files = Files(spark)
    at = _newest(files, path)
    pending = _pending(files, path, at)
    number = at.number + 1
    deltas = _deltas(spark, fg, path, pending)
    folders, buckets = dict(at.folders), at.buckets
    if deltas is not None:
        found = deltas.select(_bucket(fg, at.buckets).alias("b")).distinct().collect()  # numbers of buckets
        touched = sorted(r[0] for r in found)
    if deltas is not None and touched:
        new_bytes = sum(files.size(f"{path}/delta/batch={b}") for b in pending)
        written: list[int] = []
        for b, size in _sizes(files, path, at, touched, new_bytes).items():
            times = max(0, (-(-size // bucket_bytes) - 1).bit_length())
            written += _split(b, min(times, MOST_DEPTH - _depth(b)))
        kept = [b for b in at.buckets if b not in set(touched)]
        buckets = tuple(sorted([*kept, *written]))
        rows = _together([_base(spark, fg, path, at, set(touched)), deltas])
        merged = merge_partials(fg, rows).withColumn("bucket", _bucket(fg, buckets))
        # Each bucket is one task's work.
        place = F.map_from_arrays(F.from_json(F.lit(json.dumps(written)), "array<int>"), F.sequence(F.lit(0), F.lit(len(written) - 1)))
        dealt = merged.repartitionById(len(written), place[F.col("bucket")])
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/base/gen={number}")
        for b in touched:
            folders.pop(b, None)
        there = {int(n.removeprefix("bucket=")) for n in files.names(f"{path}/base/gen={number}")}
        folders |= {b: number for b in written if b in there}
    _keep(files, path, _Generation(number, buckets, folders, at.folded | set(pending)))
    return number


def generation_view(spark: SparkSession, fg: FeatureGroup, path: str, number: int, as_of: object = None) -> DataFrame:
    """The latest view as of a compaction (which ``vacuum`` must not have removed)."""
    return finish_view(fg, _rows_of(spark, fg, path, _generation(Files(spark), path, number)), as_of)


def _rows_of(spark: SparkSession, fg: FeatureGroup, path: str, at: _Generation, only: set[int] | None = None) -> DataFrame:
    found = _base(spark, fg, path, at, only)
    if found is None:
        entity = fg.entity_dtype.spark_type if fg.entity_dtype else T.StringType()
        return spark.createDataFrame([], partial_schema(fg, entity))
    return found


UPSERT, DELETE = "upsert", "delete"
OP = "_op"


def changes(
    spark: SparkSession,
    fg: FeatureGroup,
    path: str,
    since: int,
    upto: int | None = None,
    as_of_before: object = None,
    as_of: object = None,
) -> DataFrame:
    """What turns the view of generation ``since`` (0: nothing) into that of ``upto`` (the
    newest): ``_op``, the entity, and for upserts its features and event time.

    Only buckets that differ are read whole and compared, entity by entity. With a ttl and
    times of reading, records of the other buckets that expired in between are deletes; for
    that their last write alone is read.
    """
    files = Files(spark)
    old = _generation(files, path, since)
    new = _newest(files, path) if upto is None else _generation(files, path, upto)
    same = {b for b, g in new.folders.items() if old.folders.get(b) == g}
    before = finish_view(fg, _rows_of(spark, fg, path, old, set(old.folders) - same), as_of_before)
    after = finish_view(fg, _rows_of(spark, fg, path, new, set(new.folders) - same), as_of)
    names = [*fg.feature_names, EVENT_TS]

    def packed(view: DataFrame, side: str) -> DataFrame:
        return view.select(fg.entity, F.struct(*names).alias(side))

    met = packed(before, "a").join(packed(after, "b"), fg.entity, "full")
    differ = met.filter(~F.col("a").eqNullSafe(F.col("b")))
    op = F.when(F.col("b").isNull(), DELETE).otherwise(UPSERT).alias(OP)
    found = differ.select(op, fg.entity, *[F.col("b")[n].alias(n) for n in names])
    if as_of is None or fg.ttl_seconds <= 0:
        return found
    ends = F.col(LAST_WRITE) + F.lit(fg.ttl_seconds * 1_000_000)
    gone = ends <= ntz_to_micros(as_of_literal(as_of))
    if as_of_before is not None:
        gone = gone & (ends > ntz_to_micros(as_of_literal(as_of_before)))
    kept = _rows_of(spark, fg, path, new, same).filter(gone).select(fg.entity)
    types = {f.name: f.dataType for f in found.schema.fields}
    expired = kept.select(F.lit(DELETE).alias(OP), fg.entity, *[F.lit(None).cast(types[n]).alias(n) for n in names])
    return found.unionByName(expired)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove folded batches, and base folders and generations that the newest does not use.
    Call it once no reader that started before the newest generation still runs."""
    files = Files(spark)
    at = _newest(files, path)
    if not at.number:
        return
    # The list of folded batches is emptied last: a batch without a commit is not read.
    for batch in sorted(at.folded):
        files.delete(f"{path}/commits/{batch}")
        files.delete(f"{path}/delta/batch={batch}")
    for folder in files.names(f"{path}/base"):
        number = int(folder.removeprefix("gen="))
        used = {b for b, g in at.folders.items() if g == number}
        if not used:
            files.delete(f"{path}/base/{folder}")
            continue
        for bucket in files.names(f"{path}/base/{folder}"):
            if int(bucket.removeprefix("bucket=")) not in used:
                files.delete(f"{path}/base/{folder}/{bucket}")
    _keep(files, path, _Generation(at.number, at.buckets, at.folders, frozenset()))
    for name in files.names(f"{path}/generations"):
        if int(name) < at.number:
            files.delete(f"{path}/generations/{name}")
