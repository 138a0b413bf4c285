"""Point-in-time (as-of) left join.

Every spine row receives, per feature group, the latest feature row of the same
entity whose event time is not after the spine's event time. All groups are
answered by one pass: spine and features are laid on one timeline per entity,
shuffled once by entity, and a running ``last`` carries the newest payload of
every group forward.

A timeline is sorted inside one task, so an entity holding a large share of the
rows would become one huge task. Such hot entities are found by a count of the
entity column and get their timeline cut into chunks that follow event time;
each chunk starts from a carry row holding the last payloads of all earlier
chunks, which makes the cut exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefns import as_utc_ntz, ntz_to_micros
from tidemark.operators.skew import BROADCAST_ROWS, HOT_ROWS, hot_keys
from tidemark.spec import EVENT_TS, INGEST_TS, FeatureGroup
from tidemark.workspace import new_run_dir

# Payload structs carried through one sort; more groups are joined in further passes.
GROUPS_PER_PASS = 16

# A hot entity's timeline is cut by the hour, and an hour that is itself too large at
# quantiles of its event times: as many of a grid of them as its rows ask for.
CELL_MICROS = 3_600_000_000
CUT_GRID = 1_024
# Cuts are looked up in two steps, by groups of this many.
CUT_GROUP = 32

# Partitions that rows without a match are spread over, where they are not kept apart.
UNMATCHED_PARTS = 1 << 20

# Order of rows at one instant: what came before, features, spine.
_CARRY, _FEATURE, _SPINE = -1, 0, 1


@dataclass(frozen=True)
class _Payload:
    """One group's columns on the timeline and in the result."""

    slot: str
    fg: FeatureGroup
    names: dict[str, str]  # feature -> result column
    ts_name: str

    @property
    def dtype(self) -> T.StructType:
        fields = [T.StructField(f.name, f.spark_type) for f in self.fg.features]
        return T.StructType([*fields, T.StructField(EVENT_TS, T.TimestampNTZType())])

    def expand(self) -> list[Column]:
        slot = F.col(self.slot)
        features = [slot[f].alias(n) for f, n in self.names.items()]
        return [*features, slot[EVENT_TS].alias(self.ts_name)]


def point_in_time_join(
    spine: DataFrame,
    groups: Sequence[tuple[FeatureGroup, DataFrame | None]],
    entity_col: str,
    event_ts_col: str = "event_ts",
    *,
    prefix: bool = False,
    hot_rows: int | None = HOT_ROWS,
    read_once: bool = False,
) -> DataFrame:
    """Attach the features of ``groups`` as they were at each spine row's time.

    ``groups`` pairs a spec with its feature rows (entity, ``_event_ts``, the
    features, optionally ``_ingest_ts``); ``None`` stands for a group without
    data and yields null columns. Equal event times are decided by ``_ingest_ts``
    (a time or a sequence number), then by a hash of the features. A spine row
    with a null entity or time keeps null features. Result: the spine's columns,
    per group its features and ``_ts_<group>``; ``prefix=True`` names features
    ``<group>__<feature>``.

    ``hot_rows`` is the number of rows above which an entity is cut into chunks
    (checked by one job over the entity column); ``None`` skips the check.

    ``read_once`` sends spine rows that nothing can match through the shuffle as well,
    spread over ``UNMATCHED_PARTS`` partitions, so that a spine which is itself the result of
    a join is computed once. It is for callers that have looked for hot entities
    themselves, and skips the check.
    """
    if len(groups) > GROUPS_PER_PASS:
        head, tail = groups[:GROUPS_PER_PASS], groups[GROUPS_PER_PASS:]
        first = point_in_time_join(
            spine, head, entity_col, event_ts_col, prefix=prefix, hot_rows=hot_rows, read_once=read_once
        )
        return point_in_time_join(
            first, tail, entity_col, event_ts_col, prefix=prefix, hot_rows=hot_rows, read_once=read_once
        )

    payloads = _layout(spine, groups, prefix)
    times = as_utc_ntz(F.col(event_ts_col), spine.schema[event_ts_col].dataType)
    no_match = F.col(entity_col).isNull() | F.col(event_ts_col).isNull()
    key_type = _key_type(spine.schema[entity_col].dataType)

    spread = F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in spine.columns]))), F.lit(UNMATCHED_PARTS))
    labels = (spine if read_once else spine.filter(~no_match)).select(
        F.when(~no_match, F.col(entity_col)).cast(key_type).alias("__k"),
        F.when(no_match, spread).otherwise(F.lit(0)).cast("bigint").alias("__part"),
        F.when(~no_match, times).alias("__t"),
        F.lit(_SPINE).alias("__kind"),
        F.lit(None).cast("bigint").alias("__tie1"),
        F.lit(None).cast("bigint").alias("__tie2"),
        *[F.lit(None).cast(p.dtype).alias(p.slot) for p in payloads],
        F.struct(*[F.col(f"`{c}`") for c in spine.columns]).alias("__s"),
    )
    spine_type = labels.schema["__s"].dataType
    timeline = labels
    for payload, (_, rows) in zip(payloads, groups, strict=True):
        if rows is not None:
            timeline = timeline.unionByName(
                _feature_rows(payload, payloads, rows, key_type, spine_type)
            )

    columns = ["__s", *[p.slot for p in payloads]]
    expanded = ["__s.*", *[c for p in payloads for c in p.expand()]]
    if read_once:
        return _carry_forward(timeline, payloads, ["__k", "__part"]).select(*columns).select(*expanded)
    timeline = timeline.drop("__part")
    rows, hot = (0, 0) if hot_rows is None else _count_hot(timeline, hot_rows)
    if not hot:
        answered = _carry_forward(timeline, payloads, ["__k"])
    else:
        answered = _hot_path(timeline, payloads, hot_rows, rows // hot_rows <= BROADCAST_ROWS)

    # Without a key or a time nothing can match; these rows skip the shuffle.
    unmatched = spine.filter(no_match).select(
        F.struct(*[F.col(f"`{c}`") for c in spine.columns]).alias("__s"),
        *[F.lit(None).cast(p.dtype).alias(p.slot) for p in payloads],
    )
    result = answered.select(*columns).unionByName(unmatched.select(*columns))
    return result.select(*expanded)


@dataclass(frozen=True)
class Keyed:
    """A feature group to be joined by a key of its own: a column of the spine, whose values
    are entities of the group. ``rows`` is None for a group without data."""

    entity_col: str
    fg: FeatureGroup
    rows: DataFrame | None


def plan_passes(groups: Sequence[Keyed]) -> list[tuple[str, list[Keyed]]]:
    """One pass for each distinct key, with all groups of that key.

    Every pass shuffles the spine with what earlier passes have added, so that the keys with
    the fewest added columns come first: wide features are carried as seldom as possible.
    """
    by_key: dict[str, list[Keyed]] = {}
    for g in groups:
        by_key.setdefault(g.entity_col, []).append(g)

    def width(found: list[Keyed]) -> int:
        # Lists count as many columns.
        return sum(1 + sum(16 if isinstance(f.spark_type, T.ArrayType) else 1 for f in g.fg.features) for g in found)

    return sorted(by_key.items(), key=lambda kv: width(kv[1]))


def point_in_time_join_keys(
    spine: DataFrame,
    groups: Sequence[Keyed],
    event_ts_col: str = "event_ts",
    *,
    prefix: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Point-in-time join with groups that have different entities.

    Each row of the spine names one entity for each key (a user, a customer ...). Groups
    are joined key by key, each key in one pass and one shuffle (``plan_passes``). Rows
    pass through as they are: equal rows stay as many as they were, and a row without one
    of its keys still gets the features of the others. Columns come in the order of
    ``groups``, whatever the order of the passes.
    """
    plans = plan_passes(groups)
    # All names are laid out before anything is joined: a clash is an error up front.
    layout = _layout(spine, [(g.fg, g.rows) for g in groups], prefix)
    found = spine
    for i, (key, mine) in enumerate(plans):
        pairs = [(g.fg, g.rows) for g in mine]
        # Hot entities show in the key columns alone; earlier passes need not run for that.
        hot = hot_rows is not None and _any_hot(spine, key, mine, hot_rows)
        if hot and i:
            # The chunked path reads its spine several times.
            found = _written(found)
        found = point_in_time_join(
            found, pairs, key, event_ts_col, prefix=prefix, hot_rows=hot_rows if hot else None, read_once=not hot
        )
    added = [n for p in layout for n in (*p.names.values(), p.ts_name)]
    return found.select(*[F.col(f"`{c}`") for c in (*spine.columns, *added)])


def _any_hot(spine: DataFrame, key: str, groups: list[Keyed], hot_rows: int) -> bool:
    keys = spine.select(F.col(key).cast("string").alias("__k"))
    for g in groups:
        if g.rows is not None:
            keys = keys.union(g.rows.select(F.col(g.fg.entity).cast("string").alias("__k")))
    return not hot_keys(keys, "__k", hot_rows).isEmpty()


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = new_run_dir(rows.sparkSession, "pass")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _layout(spine: DataFrame, groups: Sequence, prefix: bool) -> list[_Payload]:
    taken = set(spine.columns)
    payloads = []
    for i, (fg, _) in enumerate(groups):
        names = {f: f"{fg.name}__{f}" if prefix else f for f in fg.feature_names}
        payload = _Payload(f"__g{i}", fg, names, f"_ts_{fg.name}")
        for name in [*names.values(), payload.ts_name]:
            if name in taken:
                raise ValueError(f"column {name!r} appears twice; use prefix=True or rename it")
            taken.add(name)
        payloads.append(payload)
    return payloads


def _key_type(dtype: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(dtype, T.IntegralType) else dtype


def _feature_rows(
    payload: _Payload,
    payloads: list[_Payload],
    rows: DataFrame,
    key_type: T.DataType,
    spine_type: T.DataType,
) -> DataFrame:
    fg = payload.fg
    found = _key_type(rows.schema[fg.entity].dataType)
    if found != key_type:
        raise TypeError(
            f"entity of {fg.name!r} is {found.simpleString()}, "
            f"the spine's is {key_type.simpleString()}"
        )
    event_ts = as_utc_ntz(F.col(EVENT_TS), rows.schema[EVENT_TS].dataType)
    packed = F.struct(
        *[F.col(f.name).cast(f.spark_type).alias(f.name) for f in fg.features],
        event_ts.alias(EVENT_TS),
    )
    arrival = F.lit(None).cast("bigint")
    if INGEST_TS in rows.columns:
        dtype = rows.schema[INGEST_TS].dataType
        arrival = F.col(INGEST_TS)
        if not isinstance(dtype, T.IntegralType):
            arrival = ntz_to_micros(as_utc_ntz(arrival, dtype))
    return rows.filter(F.col(fg.entity).isNotNull() & F.col(EVENT_TS).isNotNull()).select(
        F.col(fg.entity).cast(key_type).alias("__k"),
        F.lit(0).cast("bigint").alias("__part"),
        event_ts.alias("__t"),
        F.lit(_FEATURE).alias("__kind"),
        arrival.cast("bigint").alias("__tie1"),
        F.xxhash64(*[F.col(f"`{f}`") for f in fg.feature_names]).alias("__tie2"),
        *[
            (packed if p is payload else F.lit(None)).cast(p.dtype).alias(p.slot)
            for p in payloads
        ],
        F.lit(None).cast(spine_type).alias("__s"),
    )


def _carry_forward(
    timeline: DataFrame, payloads: list[_Payload], partition: list[str]
) -> DataFrame:
    """Newest payload of every group at each row of a sorted timeline."""
    upto = (
        W.partitionBy(*partition)
        .orderBy("__t", "__kind", "__tie1", "__tie2")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    newest = {p.slot: F.last(p.slot, ignorenulls=True).over(upto) for p in payloads}
    return timeline.withColumns(newest).filter(F.col("__kind") == _SPINE)


def _count_hot(timeline: DataFrame, hot_rows: int) -> tuple[int, int]:
    """Rows with a key, and how many keys are hot."""
    keys = timeline.filter(F.col("__k").isNotNull()).groupBy("__k").agg(F.count(F.lit(1)).alias("n"))
    found = keys.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") >= hot_rows).alias("hot")).first()
    return found["rows"] or 0, found["hot"]


def _hot_path(timeline: DataFrame, payloads: list[_Payload], hot_rows: int, few: bool) -> DataFrame:
    """The same answer with the timelines of hot entities cut into chunks.

    ``hot``, ``cuts`` and the points are lists of things that each stand for at
    least ``hot_rows`` rows, so N rows give at most N / hot_rows of them. They are broadcast
    if N, which has been counted, makes that ``few``; else they are joined like any table.
    """
    near = F.broadcast if few else (lambda listed: listed)
    slots = [p.slot for p in payloads]
    hot = near(hot_keys(timeline.select("__k"), "__k", hot_rows))
    cold = timeline.join(hot, "__k", "left_anti").withColumn("__chunk", F.lit(0).cast("bigint"))
    warm = _chunked(timeline.join(hot, "__k", "left_semi"), hot_rows, near)

    # Newest payloads per chunk, combined before the shuffle, then run forward:
    # one row per chunk and entity.
    by_chunk = W.partitionBy("__k").orderBy("__chunk")
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    upto = by_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = warm.groupBy("__k", "__chunk", "__point").agg(*[_newest(s) for s in slots])
    carries = (
        newest.withColumns({s: F.last(s, ignorenulls=True).over(before) for s in slots})
        .filter(~F.col("__point"))
        .select(
            "__k",
            F.lit(None).cast("timestamp_ntz").alias("__t"),
            F.lit(_CARRY).alias("__kind"),
            F.lit(None).cast("bigint").alias("__tie1"),
            F.lit(None).cast("bigint").alias("__tie2"),
            *slots,
            F.lit(None).cast(timeline.schema["__s"].dataType).alias("__s"),
            "__chunk",
        )
    )
    columns = [*timeline.columns, "__chunk"]
    chunks = (
        cold.select(*columns)
        .unionByName(warm.filter(~F.col("__point")).select(*columns))
        .unionByName(carries.select(*columns))
    )
    answered = _carry_forward(chunks, payloads, ["__k", "__chunk"])

    # All spine rows of a point share one answer.
    at_point = (
        newest.withColumns({s: F.last(s, ignorenulls=True).over(upto) for s in slots})
        .filter("__point")
        .select("__k", "__chunk", *slots)
    )
    point_spine = warm.filter(F.col("__point") & (F.col("__kind") == _SPINE))
    point_answers = point_spine.select("__k", "__chunk", "__s").join(
        near(at_point), ["__k", "__chunk"], "left"
    )
    return answered.select("__s", *slots).unionByName(point_answers.select("__s", *slots))


def _chunked(rows: DataFrame, hot_rows: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``__chunk``, which grows with event time, and ``__point``, set where the
    chunk is a single instant that alone holds at least ``hot_rows`` rows."""
    micros = ntz_to_micros(F.col("__t"))
    started = micros - F.pmod(micros, F.lit(CELL_MICROS))
    rows = rows.withColumn("__cell", (started / F.lit(CELL_MICROS)).cast("bigint"))
    quantiles = [i / CUT_GRID for i in range(1, CUT_GRID)]
    cells = (
        rows.groupBy("__k", "__cell")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.percentile_approx(micros, quantiles, 20 * CUT_GRID).alias("__grid"),
        )
        .filter(F.col("__n") >= hot_rows)
    )
    # Two cuts for each hot_rows rows of the cell, as far as the grid goes.
    step = F.greatest(F.lit(1), F.floor(F.lit(CUT_GRID * hot_rows) / (F.lit(2) * F.col("__n"))))
    quantile_cuts = F.array_distinct(F.filter("__grid", lambda c, i: (i + 1) % step == 0))
    points = (
        rows.groupBy("__k", "__cell", "__t")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= hot_rows)
        .groupBy("__k", "__cell")
        .agg(F.collect_list(micros).alias("__points"))
    )
    no_points = F.array().cast("array<bigint>")
    all_cuts = F.array_sort(F.array_union(quantile_cuts, F.coalesce("__points", no_points)))
    last = F.floor((F.size("__cuts") - 1) / CUT_GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("__cuts"), i * CUT_GROUP + 1, CUT_GROUP))
    cuts = (
        cells.join(points, ["__k", "__cell"], "left")
        .select("__k", "__cell", F.coalesce("__points", no_points).alias("__points"), all_cuts.alias("__cuts"))
        .withColumn("__groups", groups)
        .withColumn("__heads", F.transform("__groups", lambda g: g[0]))
    )
    # Rows of one cell get even numbers by the cuts before them; a point is a cut
    # itself and gets the odd number just below the rows that follow it.
    begun = F.size(F.filter("__heads", lambda c: c < micros))
    inside = F.size(F.filter(F.get("__groups", begun - 1), lambda c: c < micros))
    earlier = F.when(begun == 0, F.lit(0)).otherwise((begun - 1) * CUT_GROUP + inside)
    is_point = F.coalesce(F.array_contains("__points", micros), F.lit(False))
    per_cell = 4 * CUT_GRID + 2 * (CELL_MICROS // 1_000)
    number = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
        F.lit(2) * earlier + is_point.cast("int")
    )
    return (
        rows.join(near(cuts.select("__k", "__cell", "__points", "__cuts", "__groups", "__heads")), ["__k", "__cell"], "left")
        .withColumn("__chunk", F.col("__cell") * F.lit(per_cell) + number)
        .withColumn("__point", is_point)
        .drop("__cell", "__cuts", "__points", "__groups", "__heads")
    )


def _newest(slot: str) -> Column:
    ordering = F.when(F.col(slot).isNotNull(), F.struct("__t", "__tie1", "__tie2"))
    return F.max_by(F.col(slot), ordering).alias(slot)
