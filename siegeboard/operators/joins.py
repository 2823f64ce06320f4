"""Join operators: new rows, checked joins, updates, fills and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matches as mx
from ..functions.keys import col
from ..plans.joins import fits_broadcast, join_lookup
from .ranking import with_row_index


def new_matches(batch: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``batch`` whose key is not in ``known``, one per key.

    A batch of countable size is sent to the big table, which then is only
    scanned for its key column and not shuffled.
    """
    rows = batch.dropDuplicates([key])
    ids = rows.select(key)
    stored = known.select(key)
    if fits_broadcast(ids):
        stored = stored.join(F.broadcast(ids), key, "left_semi")
    return rows.join(stored, key, "left_anti")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, after checking that no key occurs twice."""
    repeated = df.groupBy(*[col(k) for k in keys]).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"key is not unique: {repeated[0].asDict()}")
    return df


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a lookup table whose key must be unique."""
    assert_unique(right, on)
    return join_lookup(left, right, on, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], validate: bool = True) -> DataFrame:
    """Left join with one row per key on both sides; columns of both come from the left.

    The check costs one aggregate per side and can be switched off.
    """
    if validate:
        assert_unique(left, on)
        assert_unique(right, on)
    extra = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*[col(c) for c in extra]), list(on), "left")


def update(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Overwrite left values with the right row's non-null values."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    fresh = right.select(*[col(k) for k in on], *[col(c).alias(f"_new_{c}") for c in shared])
    joined = left.join(fresh, list(on), "left")
    return joined.select(
        *[F.coalesce(col(f"_new_{c}"), col(c)).alias(c) if c in shared else col(c) for c in left.columns]
    )


def fill_where_missing(
    left: DataFrame, right: DataFrame, on: Sequence[str], probes: dict[str, callable]
) -> DataFrame:
    """Take a column from the right where its probe is null on the left only.

    ``probes`` maps a column to a function that picks the value to test.
    """
    fresh = right.select(*[col(k) for k in on], *[col(c).alias(f"_new_{c}") for c in probes])
    joined = left.join(fresh, list(on), "left")
    changed = {}
    for name, probe in probes.items():
        new = col(f"_new_{name}")
        changed[name] = F.when(probe(col(name)).isNull() & probe(new).isNotNull(), new).otherwise(col(name))
    return joined.select(*[changed[c].alias(c) if c in changed else col(c) for c in left.columns])


def award_probe(awards: Column) -> Column:
    return mx.first_award_value(awards)


def map_probe(value: Column) -> Column:
    return value["scriptName"]


def itself(value: Column) -> Column:
    return value


DETAIL_PROBES = {"awards": award_probe, "Map": map_probe}
REPAIR_PROBES = {**DETAIL_PROBES, "Map Name": itself}


def fill_nested(left: DataFrame, right: DataFrame) -> DataFrame:
    """Awards and map from freshly fetched details where they were missing."""
    return fill_where_missing(left, right, ["id"], DETAIL_PROBES)


def repair(
    main: DataFrame, backups: DataFrame, order: str, key: str = "id", probes: dict[str, callable] | None = None
) -> DataFrame:
    """Fill gaps from many backups at once: the first usable value in ``order`` wins.

    All backups are folded to one row per key before a single join.
    """
    tests = {c: p for c, p in (probes or REPAIR_PROBES).items() if c in main.columns and c in backups.columns}
    first = backups.groupBy(col(key)).agg(
        *[F.min_by(col(c), F.when(p(col(c)).isNotNull(), col(order))).alias(c) for c, p in tests.items()]
    )
    return fill_where_missing(main, first, [key], tests)


def join_by_replay(games: DataFrame, groups: DataFrame, lists: Sequence[str], key: str = "id") -> DataFrame:
    """Attach to each game the group that lists its id; shared columns stay the game's.

    A countable number of games is sent to the lists, so that only their ids
    are shuffled.
    """
    ids = F.array_distinct(F.flatten(F.array(*[F.coalesce(col(c), F.array().cast("array<string>")) for c in lists])))
    keep = [c for c in groups.columns if c not in games.columns and c not in lists and c != key]
    exploded = groups.select(F.explode(ids).alias(key), *[col(c) for c in keep])
    wanted = games.select(key)
    if fits_broadcast(wanted):
        exploded = exploded.join(F.broadcast(wanted), key, "left_semi")
    return games.join(exploded, key, "left")


def zip_rows(left: DataFrame, left_order: Sequence[Column], right: DataFrame, right_order: Sequence[Column], name: str = "row") -> DataFrame:
    """Put rows side by side by their place; the shorter side is filled with nulls."""
    a = with_row_index(left, left_order, name=name)
    b = with_row_index(right, right_order, name=name)
    return a.join(b, name, "full")


def translate_names(
    df: DataFrame, key: Sequence[str], list_column: str, names: DataFrame, strict: bool = True, joiner: str = ", "
) -> DataFrame:
    """Replace a list of user ids by the joined names in list order.

    ``names`` holds ``userId, name``. With ``strict`` an id without a name row is
    an error, as is a lookup that returns nothing at all.
    """
    listed = df.select(*[col(k) for k in key], F.posexplode(col(list_column)).alias("_place", "userId"))
    known = names.select("userId", "name", F.lit(True).alias("_known"))
    named = join_lookup(listed, known, ["userId"])
    checked = F.when(
        F.col("_known").isNull() & F.lit(strict),
        F.raise_error(F.concat(F.lit("no name for user "), F.col("userId").cast("string"))).cast("string"),
    ).otherwise(F.coalesce(F.col("name"), F.col("userId").cast("string")))
    texts = (
        named.withColumn("_text", checked)
        .groupBy(*[col(k) for k in key])
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_texts"))
        .select(*[col(k) for k in key], F.array_join(F.transform("_texts", lambda t: t["_text"]), joiner).alias("_joined"))
    )
    return df.join(texts, list(key), "left").withColumn(list_column, F.coalesce("_joined", F.lit(""))).drop("_joined")
