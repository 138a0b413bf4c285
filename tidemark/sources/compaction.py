"""Compaction of feature tables: many small batches into few files for each date.

``compact_features`` folds finished batches into packs, ``_packs/gen=<n>/date=<d>/``: the rows
of a date, with the label of their batch, in as many files as their bytes ask for. Packs
of a date that are still small are taken along, full ones are left alone, so that a byte is
written again a few times only. Dates that no new batch touches are not read.

What counts is written down in ``_manifest/<n>``, which appears by one rename: the packs of
each date, and the batches that are in them. Readers use the newest manifest, the batches
it does not name, and nothing else; without a manifest a table is what its batches are.

A batch that is written again after it was folded is void in the packs from then on
(a marker in ``_void/``) and is read from its own folder; the next compaction leaves the
old rows out. ``vacuum_features`` removes batches, packs and markers no longer used.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.files import Files
from tidemark.spec import EVENT_TS, FeatureGroup

BATCH = "_batch"
#: Bytes of a file that compaction aims for.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    #: The packs of each date: (generation, bytes).
    packs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    #: Batches in the packs whose folders may still exist.
    folded: frozenset[str] = frozenset()
    #: Markers whose rows the packs no longer hold.
    settled: frozenset[str] = frozenset()


def read_manifest(files: Files, path: str) -> Manifest:
    numbers = [int(n) for n in files.names(f"{path}/_manifest")]
    if not numbers:
        return Manifest()
    found = json.loads(files.read(f"{path}/_manifest/{max(numbers)}"))
    packs = {d: [tuple(p) for p in listed] for d, listed in found["packs"].items()}
    return Manifest(max(numbers), packs, frozenset(found["folded"]), frozenset(found["settled"]))


def _keep(files: Files, path: str, m: Manifest) -> None:
    known = {"packs": m.packs, "folded": sorted(m.folded), "settled": sorted(m.settled)}
    files.write(f"{path}/_manifest/{m.number}", json.dumps(known))


def _void(files: Files, path: str, m: Manifest) -> dict[str, str]:
    """Markers that still count, with the batch that each makes void in the packs."""
    return {n: n.rpartition("--")[0] for n in files.names(f"{path}/_void") if n not in m.settled}


def mark_rewritten(files: Files, path: str, batch: str) -> None:
    """Called before a named batch is written: rows of that batch in the packs are void."""
    if files.names(f"{path}/_manifest"):
        files.write(f"{path}/_void/{batch}--{uuid.uuid4().hex}", "")


@dataclass(frozen=True)
class Parts:
    """What a reader reads: folders of batches, packs by (generation, date), and batches whose
    rows in the packs are void."""

    batches: list[str]
    packs: list[tuple[int, str]]
    void: list[str]


def parts_of(files: Files, path: str, m: Manifest) -> Parts:
    void = set(_void(files, path, m).values())
    there = [n.removeprefix("batch=") for n in files.names(path) if n.startswith("batch=")]
    packs = [(g, d) for d, listed in sorted(m.packs.items()) for g, _ in listed]
    return Parts([b for b in there if b not in m.folded or b in void], packs, sorted(void))


def read_parts(spark: SparkSession, path: str, parts: Parts, schema: T.StructType) -> DataFrame | None:
    """Rows of batches and packs with ``date`` and ``_batch``; None if there are none."""
    date = T.StructField("date", T.DateType())
    found = []
    if parts.batches:
        listed = [f"{path}/batch={b}" for b in parts.batches]
        own = T.StructType([*schema.fields, date, T.StructField("batch", T.StringType())])
        found.append(spark.read.schema(own).option("basePath", path).parquet(*listed).withColumnRenamed("batch", BATCH))
    if parts.packs:
        listed = [f"{path}/_packs/gen={g}/date={d}" for g, d in parts.packs]
        own = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType()), date])
        packed = spark.read.schema(own).option("basePath", f"{path}/_packs").parquet(*listed)
        if parts.void:
            packed = packed.filter(~F.col(BATCH).isin(parts.void))
        found.append(packed.select(*schema.fieldNames(), "date", BATCH))
    if not found:
        return None
    columns = [*schema.fieldNames(), "date", BATCH]
    return found[0].select(*columns) if len(found) == 1 else found[0].select(*columns).unionByName(found[1])


def _dates(files: Files, folder: str) -> dict[str, int]:
    names = [n for n in files.names(folder) if n.startswith("date=")]
    return {n.removeprefix("date="): files.size(f"{folder}/{n}") for n in names}


def _rewritten(spark: SparkSession, path: str, m: Manifest, void: list[str]) -> set[tuple[int, str]]:
    """Packs that hold void rows."""
    listed = [f"{path}/_packs/gen={g}/date={d}" for d, gens in m.packs.items() for g, _ in gens]
    if not void or not listed:
        return set()
    own = T.StructType([T.StructField(BATCH, T.StringType()), T.StructField("gen", T.IntegerType()), T.StructField("date", T.StringType())])
    rows = spark.read.schema(own).option("basePath", f"{path}/_packs").parquet(*listed)
    found = rows.filter(F.col(BATCH).isin(void)).select("gen", "date").distinct().collect()
    return {(r.gen, r.date) for r in found}


def stored_fields(spark: SparkSession, path: str, parts: Parts) -> dict[str, T.StructField]:
    """All columns of the files of the parts, from their footers."""
    found: dict[str, T.StructField] = {}
    groups = [(path, [f"{path}/batch={b}" for b in parts.batches]), (f"{path}/_packs", [f"{path}/_packs/gen={g}/date={d}" for g, d in parts.packs])]
    for base, listed in groups:
        if listed:
            schema = spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*listed).schema
            found |= {f.name: f for f in schema.fields if f.name not in (BATCH, "date", "batch", "gen")}
    return found


def _whole_schema(spark: SparkSession, fg: FeatureGroup, path: str, parts: Parts) -> T.StructType:
    """All columns that the parts have, those of the spec as it says."""
    from tidemark.sources.offline import stored_schema

    known = stored_schema(spark, fg, path)
    found = stored_fields(spark, path, parts)
    more = [f for n, f in found.items() if n not in known.fieldNames()]
    return T.StructType([*known.fields, *more])


def compact_features(spark: SparkSession, fg: FeatureGroup, root: str, file_bytes: int = FILE_BYTES) -> int:
    """Fold all finished batches and return the manifest's number. One compaction runs at a
    time; writers of other batches, and readers, need not stop."""
    from tidemark.sources.offline import table_path

    files, path = Files(spark), table_path(fg, root)
    m = read_manifest(files, path)
    void = _void(files, path, m)
    parts = parts_of(files, path, m)
    # A batch that is still being written has no such file.
    done = [b for b in parts.batches if files.exists(f"{path}/batch={b}/_SUCCESS")]
    stale = _rewritten(spark, path, m, parts.void)
    new: dict[str, int] = {}
    for b in done:
        for d, n in _dates(files, f"{path}/batch={b}").items():
            new[d] = new.get(d, 0) + n
    taken: list[tuple[int, str]] = []
    left: dict[str, list[tuple[int, int]]] = {}
    for d, listed in m.packs.items():
        for g, n in listed:
            if (g, d) in stale or (d in new and n < file_bytes):
                taken.append((g, d))
                new[d] = new.get(d, 0) + n
            else:
                left.setdefault(d, []).append((g, n))
    number = m.number + 1
    # No pack has void rows from now on. A void batch that is not there yet will be read from
    # its own folder.
    settled = m.settled | set(void)
    folded = (m.folded | set(done)) - (set(void.values()) - set(done))
    if new:
        taken_parts = Parts(done, taken, parts.void)
        rows = read_parts(spark, path, taken_parts, _whole_schema(spark, fg, path, taken_parts))
        # A date's rows go to as many tasks as it shall have files, each to tasks of its own.
        counts = {d: max(1, -(-n // file_bytes)) for d, n in sorted(new.items())}
        begin = dict(zip(counts, accumulate([0, *counts.values()]), strict=False))
        per_date, first = (F.from_json(F.lit(json.dumps(x)), "map<string,int>")[F.col("date").cast("string")] for x in (counts, begin))
        task = first + F.pmod(F.xxhash64(fg.entity, EVENT_TS), per_date).cast("int")
        dealt = rows.repartitionById(sum(counts.values()), task).sortWithinPartitions("date", fg.entity, EVENT_TS)
        folder = f"{path}/_packs/gen={number}"
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(folder)
        for d, n in _dates(files, folder).items():
            left.setdefault(d, []).append((number, n))
    _keep(files, path, Manifest(number, left, frozenset(folded), frozenset(settled)))
    return number


def vacuum_features(spark: SparkSession, fg: FeatureGroup, root: str) -> None:
    """Remove what the newest manifest does not use. Call it once no reader that started before
    it still runs."""
    from tidemark.sources.offline import table_path

    files, path = Files(spark), table_path(fg, root)
    m = read_manifest(files, path)
    if not m.number:
        return
    void = set(_void(files, path, m).values())
    for b in m.folded - void:
        files.delete(f"{path}/batch={b}")
    used = {(g, d) for d, listed in m.packs.items() for g, _ in listed}
    for name in files.names(f"{path}/_packs"):
        g = int(name.removeprefix("gen="))
        folder = f"{path}/_packs/{name}"
        if not any(g == x for x, _ in used):
            files.delete(folder)
            continue
        for d in _dates(files, folder):
            if (g, d) not in used:
                files.delete(f"{folder}/date={d}")
    for n in m.settled:
        files.delete(f"{path}/_void/{n}")
    # Lists of what is gone are emptied last.
    _keep(files, path, Manifest(m.number + 1, m.packs, m.folded & void, frozenset()))
    for n in files.names(f"{path}/_manifest"):
        if int(n) <= m.number:
            files.delete(f"{path}/_manifest/{n}")


def file_counts(spark: SparkSession, fg: FeatureGroup, root: str) -> dict[str, int]:
    """How many data files a reader reads for each date."""
    from tidemark.sources.offline import table_path

    files, path = Files(spark), table_path(fg, root)
    parts = parts_of(files, path, read_manifest(files, path))
    folders = [f"{path}/batch={b}" for b in parts.batches]
    out: dict[str, int] = {}
    for folder in folders:
        for d in _dates(files, folder):
            out[d] = out.get(d, 0) + len(files.names(f"{folder}/date={d}"))
    for g, d in parts.packs:
        out[d] = out.get(d, 0) + len(files.names(f"{path}/_packs/gen={g}/date={d}"))
    return out
