"""Latest value per entity: per-field last-write-wins with expiry.

Writes are rows (entity, features, ``_event_ts``, ``_write_ts``, ``_seq``); a null
feature is a field the write does not carry. Writes arrive in the order of
``_write_ts`` and then ``_seq`` (an offset, say, which only orders one partition of
one topic).

Every write renews the expiry of the entity's whole record, so a pause of at
least ``ttl`` between two writes wipes all fields. Cut time into cells of one
ttl: two writes in one cell are always closer than ttl, so a wipe can only lie
between two cells. Writes therefore fold to one partial row per (entity, cell)
before anything is shuffled, and only those partial rows are put in order.
Folding is idempotent: a partial row may be merged twice without effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codec import decode
from tidemark.functions.timefns import as_of_literal, as_utc_ntz, micros_to_ntz, ntz_to_micros
from tidemark.operators.skew import HOT_ROWS, lookup_join, reduce_to
from tidemark.spec import EVENT_TS, SEQ, WRITE_TS, FeatureGroup, ModelVersion

CELL = "_cell"
FIRST_WRITE = "_first_write"
LAST_WRITE = "_last_write"

# With a ttl below this many seconds a busy entity has very many cells: they are merged chunk
# by chunk of so many cells first, each chunk a group of its own.
SHORT_TTL = 3_600
CHUNK_CELLS = 4_096
_CHUNK = "__chunk"

ARRIVAL = "arrival"
EVENT_TIME = "event_time"


def from_sparse(fg: FeatureGroup, writes: DataFrame, values: str = "values") -> DataFrame:
    """Sparse text writes (``map<string,string>``) to typed columns; fields outside
    the spec are dropped."""
    typed = decode(
        fg,
        writes.withColumnRenamed(EVENT_TS, "__event_ts"),
        fields=values,
        defaults=False,
    )
    return typed.drop(EVENT_TS).withColumnRenamed("__event_ts", EVENT_TS)


def partial_rows(
    fg: FeatureGroup, writes: DataFrame, order: str = ARRIVAL, expire: bool = True
) -> DataFrame:
    """Fold writes to one row per (entity, ttl cell)."""
    write_us = ntz_to_micros(as_utc_ntz(F.col(WRITE_TS), writes.schema[WRITE_TS].dataType))
    event_ts = as_utc_ntz(F.col(EVENT_TS), writes.schema[EVENT_TS].dataType)
    ttl_us = fg.ttl_seconds * 1_000_000 if expire else 0
    # A cell is named by the time it starts; without expiry there is only one.
    cells = {CELL: write_us - F.pmod(write_us, F.lit(ttl_us))} if ttl_us > 0 else {}
    rows = writes.filter(F.col(fg.entity).isNotNull()).select(
        fg.entity,
        *[start.alias(name) for name, start in cells.items()],
        write_us.alias("__write"),
        F.col(SEQ).cast("bigint").alias(SEQ),
        # A write without event time happened when it was written.
        F.coalesce(ntz_to_micros(event_ts), write_us).alias("__event"),
        *[F.col(f.name).cast(f.spark_type).alias(f.name) for f in fg.features],
    )
    if order == ARRIVAL:
        newest = [F.col("__write"), F.col(SEQ)]
        event = F.max_by("__event", F.struct(*newest))
    elif order == EVENT_TIME:
        newest = [F.col("__event"), F.col(SEQ)]
        event = F.max("__event")
    else:
        raise ValueError(f"order must be {ARRIVAL!r} or {EVENT_TIME!r}, not {order!r}")
    folds = [
        F.max(
            F.when(
                F.col(f.name).isNotNull(),
                F.struct(newest[0].alias("at"), newest[1].alias("seq"), F.col(f.name).alias("v")),
            )
        ).alias(f.name)
        for f in fg.features
    ]
    folded = rows.groupBy(fg.entity, *cells).agg(
        F.min("__write").alias(FIRST_WRITE),
        F.max("__write").alias(LAST_WRITE),
        event.alias(EVENT_TS),
        *folds,
        F.max_by(SEQ, F.struct(*newest)).alias("__seq"),
    )
    if not cells:
        folded = folded.withColumn(CELL, F.lit(0).cast("bigint"))
    return folded.withColumnRenamed("__seq", SEQ)


def merge_partials(
    fg: FeatureGroup, partials: DataFrame, order: str = ARRIVAL, expire: bool = True
) -> DataFrame:
    """Merge partial rows to one row per entity, still in partial form."""
    alive = partials
    if expire and fg.ttl_seconds > 0:
        if fg.ttl_seconds < SHORT_TTL:
            # A pause inside a chunk wipes what lies before it in the chunk; what is left is one
            # row, and a pause before its first write lies between chunks.
            length = F.lit(fg.ttl_seconds * 1_000_000 * CHUNK_CELLS)
            chunked = partials.withColumn(_CHUNK, F.col(CELL) - F.pmod(F.col(CELL), length))
            by = [fg.entity, _CHUNK]
            alive = _merged(fg, _last_island(fg, chunked, by), order, by).drop(_CHUNK)
        alive = _last_island(fg, alive, [fg.entity])
    return _merged(fg, alive, order, [fg.entity])


def _merged(fg: FeatureGroup, rows: DataFrame, order: str, by: list[str]) -> DataFrame:
    merged = [F.max(f.name).alias(f.name) for f in fg.features]
    if order == ARRIVAL:
        event = F.max_by(EVENT_TS, F.struct(LAST_WRITE, SEQ))
    else:
        event = F.max(EVENT_TS)
    return rows.groupBy(*by).agg(
        F.min(CELL).alias(CELL),
        F.min(FIRST_WRITE).alias(FIRST_WRITE),
        F.max(LAST_WRITE).alias(LAST_WRITE),
        event.alias(EVENT_TS),
        *merged,
        F.max_by(SEQ, F.struct(LAST_WRITE, SEQ)).alias("__seq"),
    ).withColumnRenamed("__seq", SEQ)


def partial_schema(fg: FeatureGroup, entity: T.DataType) -> T.StructType:
    """The columns of partial rows as they are stored."""
    whole = T.LongType()
    kept = [
        T.StructField(
            f.name,
            T.StructType([T.StructField("at", whole), T.StructField("seq", whole), T.StructField("v", f.spark_type)]),
        )
        for f in fg.features
    ]
    return T.StructType(
        [
            T.StructField(fg.entity, entity),
            *(T.StructField(c, whole) for c in (CELL, FIRST_WRITE, LAST_WRITE, EVENT_TS)),
            *kept,
            T.StructField(SEQ, whole),
        ]
    )


def _last_island(fg: FeatureGroup, partials: DataFrame, by: list[str]) -> DataFrame:
    """Keep the partial rows after the last pause of at least ttl."""
    ttl_us = fg.ttl_seconds * 1_000_000
    by_time = W.partitionBy(*by).orderBy(FIRST_WRITE, LAST_WRITE)
    earlier = by_time.rowsBetween(W.unboundedPreceding, -1)
    pause = F.col(FIRST_WRITE) - F.max(LAST_WRITE).over(earlier)
    started = F.max(F.when(F.col("__pause") >= ttl_us, F.col(FIRST_WRITE)))
    whole = W.partitionBy(*by)
    return (
        partials.withColumn("__pause", pause)
        .withColumn("__start", started.over(whole))
        .filter(F.col("__start").isNull() | (F.col(FIRST_WRITE) >= F.col("__start")))
        .drop("__pause", "__start")
    )


def finish_view(
    fg: FeatureGroup, merged: DataFrame, as_of: object = None, order: str = ARRIVAL
) -> DataFrame:
    """Merged partial rows to the public view, without records expired at ``as_of``."""
    view = merged
    if as_of is not None and fg.ttl_seconds > 0:
        now = ntz_to_micros(as_of_literal(as_of))
        view = view.filter(F.col(LAST_WRITE) + F.lit(fg.ttl_seconds * 1_000_000) > now)

    def value(name: str) -> Column:
        return F.col(name)["v"].alias(name)

    return view.select(
        fg.entity,
        *[value(f) for f in fg.feature_names],
        micros_to_ntz(F.col(EVENT_TS)).alias(EVENT_TS),
    )


def latest_view(
    fg: FeatureGroup,
    writes: DataFrame,
    as_of: object = None,
    order: str = ARRIVAL,
    expire: bool | None = None,
) -> DataFrame:
    """One row per entity with the newest value of each field.

    A group with a ttl expires: a pause of at least ttl between two writes wipes what was
    there, unless ``expire`` is false. ``as_of`` (the read time) decides about the last
    write as well; without it the newest record counts as alive. ``order="event_time"`` lets the newest event win instead of the
    newest arrival.
    """
    expire = fg.ttl_seconds > 0 and expire is not False
    partials = partial_rows(fg, writes, order, expire)
    if not expire:
        # A single cell: the fold already is one row per entity.
        return finish_view(fg, partials, None, order)
    return finish_view(fg, merge_partials(fg, partials, order), as_of, order)


def select_features(
    fg: FeatureGroup, df: DataFrame, names: list[str] | None = None
) -> DataFrame:
    """Entity, the named features (all when empty) and the event time.

    Missing values take the spec's default; a name outside the spec gives null
    text, or the stored text if the table still has such a column.
    """
    columns = []
    for name in names or fg.feature_names:
        spec = fg.feature(name)
        if spec is None:
            stored = F.col(name).cast("string") if name in df.columns else F.lit(None)
            columns.append(stored.cast("string").alias(name))
        elif spec.default_value is None:
            columns.append(F.col(name))
        else:
            columns.append(F.coalesce(F.col(name), spec.default()).alias(name))
    return df.select(fg.entity, *columns, EVENT_TS)


def lookup_latest(
    fg: FeatureGroup, ids: DataFrame, latest: DataFrame, names: list[str] | None = None
) -> DataFrame:
    """One row per distinct requested id; ids without a record get the defaults."""
    wanted = ids.select(fg.entity).distinct()
    few = reduce_to(latest, wanted, fg.entity)
    return select_features(fg, wanted.join(few, fg.entity, "left"), names)


def features_for_model(
    model: ModelVersion,
    entities: DataFrame,
    views: dict[str, tuple[FeatureGroup, DataFrame]],
    entity_col: str,
) -> DataFrame:
    """Features of every group a model needs, one row per distinct entity.

    ``views`` maps a group name to its latest registered spec and latest view; a
    group that is not there is skipped. Adds ``_ts_<group>`` per group. All joins
    share one key, so each side is shuffled once.
    """
    result = entities.select(entity_col).distinct()
    for name in model.feature_groups:
        if name not in views:
            continue
        fg, latest = views[name]
        view = latest.withColumnRenamed(fg.entity, entity_col)
        clash = set(result.columns) & set(fg.feature_names)
        if clash:
            raise ValueError(f"features {sorted(clash)} come from several groups")
        result = result.join(view, entity_col, "left")
        result = result.withColumns(
            {
                f.name: F.coalesce(F.col(f.name), f.default())
                for f in fg.features
                if f.default_value is not None
            }
        ).withColumnRenamed(EVENT_TS, f"_ts_{name}")
    return result


def attach_features(
    requests: DataFrame, features: DataFrame, entity_col: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Give every request its entity's features; requests may repeat entities."""
    return lookup_join(requests, features, entity_col, hot_rows)


def event_seconds(ts: Column) -> Column:
    """Event time as epoch seconds, the form in which stores exchange it."""
    return (ntz_to_micros(ts) / F.lit(1e6)).cast(T.DoubleType())
