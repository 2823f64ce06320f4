"""What many takers gather from the groups they list, tile by tile.

The pairs of groups say who hands on to whom, but a row for each pair and each handed
item (a word of a player set, a player) is many times the input. So the two meet in
tiles: the takers of a bucket (in several parts if they list very many sources) and one slice
of the items, by hash. A tile gets the items of the bucket's groups once and, for every taker,
the list of its sources; it holds the items as a matrix of groups and items, and what a taker
gathers is one reduction over the rows of its sources. How many slices a bucket has follows
from its groups, items and rows, so the matrix has a bounded size at any size of the input,
and every result row leaves its tile complete.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.joins import join_lookup
from ..session import store

#: Groups times items (and rows of items) of a tile, and listed sources of its takers.
TILE_CELLS = 1 << 20
TILE_SOURCES = 1 << 22
#: Rows whose list cells are put together at once.
CELL_ROWS = 16

SETS = ("own_winners", "own_players", "win_winners", "win_players", "loss_players")
UNITED = ["gid", "word", "own_winners", "carried", "winners", "players"]


def source_lists(pairs: DataFrame) -> DataFrame:
    """For each group that takes from others (``gid``) their ids as lists, ``won`` and ``lost``."""
    others = pairs.where(F.col("source") != F.col("gid"))
    lists = [F.collect_list(F.when(F.col("easier") == e, F.col("source"))).alias(name) for name, e in (("won", True), ("lost", False))]
    return others.groupBy("gid").agg(*lists).withColumn("n_sources", F.size("won") + F.size("lost"))


def with_bucket(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` of groups that can be compared, with their ``bucket``."""
    known = groups.where(F.col("bucket").isNotNull()).select("gid", F.xxhash64("bucket").alias("bucket"))
    return join_lookup(rows, known, ["gid"], "inner")


def tiled(
    items: DataFrame,
    takers: DataFrame,
    item: str,
    key: Sequence[str],
    cells: int = TILE_CELLS,
    sources: int = TILE_SOURCES,
    matrix: bool = True,
) -> PandasCogroupedOps:
    """``items`` (``bucket``, ``gid``, ``item``, more columns) and ``takers`` (``bucket``, ``key``, ``n_sources``, lists) by tile.

    ``home`` marks the items of groups that are, with ``gid`` as key, takers of the tile. Without a ``matrix`` of groups
    and items, a tile is measured by what its takers gather: the items of a group times the listed groups.
    """
    held = items.groupBy("bucket").agg(
        F.approx_count_distinct(item).alias("n_items"), F.approx_count_distinct("gid").alias("n_groups"), F.count(F.lit(1)).alias("n_rows")
    )
    taking = takers.groupBy("bucket").agg(F.sum("n_sources").alias("n_listed"))
    listed = F.coalesce(F.col("n_listed"), F.lit(0))
    size = F.greatest(F.col("n_items") * F.col("n_groups") if matrix else F.col("n_rows") * listed / F.col("n_groups"), F.col("n_rows"))
    dealt = store(
        held.join(taking, "bucket", "left").select(
            "bucket",
            F.ceil(size / cells).cast("int").alias("n_slices"),
            F.greatest(F.lit(1), F.ceil(listed / sources)).cast("int").alias("n_parts"),
        )
    )

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def part(of: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*of), F.col("n_parts")).cast("int")

    left = (
        join_lookup(items, dealt, ["bucket"], "inner")
        .withColumn("part", each("n_parts"))
        .withColumn("slice", F.pmod(F.xxhash64(item), F.col("n_slices")).cast("int"))
        .withColumn("home", part(["gid"]) == F.col("part"))
        .drop("n_slices", "n_parts")
    )
    right = (
        join_lookup(takers, dealt, ["bucket"], "inner")
        .withColumn("slice", each("n_slices"))
        .withColumn("part", part(key))
        .drop("n_slices", "n_parts", "n_sources")
    )
    tile = ["bucket", "part", "slice"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile))


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _listed(table: pa.Table, name: str, gids: np.ndarray) -> Iterator[np.ndarray]:
    """For every taker the matrix rows of its sources, those without items in the tile left out."""
    lists = table.column(name).combine_chunks()
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    row = np.minimum(np.searchsorted(gids, ids), len(gids) - 1)
    some = gids[row] == ids
    kept = np.concatenate([[0], np.cumsum(some)])
    yield from np.split(row[some], kept[ends[:-1]]) if len(ends) else ()


def gathered(left: pa.Table, right: pa.Table, gids: np.ndarray, names: Sequence[str]) -> Iterator[tuple]:
    """Every taker of a tile with its own matrix row (or none) and the rows of its sources, one array for each list."""
    takers = _values(right, "gid")
    own = np.minimum(np.searchsorted(gids, takers), len(gids) - 1)
    lists = [_listed(right, name, gids) for name in names]
    for gid, row, *rows in zip(takers, own, *lists, strict=True):
        yield gid, row if gids[row] == gid else None, *rows
    home = np.unique(_values(left, "gid")[_values(left, "home")])
    none = np.zeros(0, dtype=np.int64)
    for gid in np.setdiff1d(home, takers):
        yield gid, int(np.searchsorted(gids, gid)), *[none] * len(names)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _united(left: pa.Table, right: pa.Table) -> pa.Table:
    """Player sets of the takers of a tile: their own words joined with those that their sources hand on."""
    gids, row = np.unique(_values(left, "gid"), return_inverse=True)
    words, at = np.unique(_values(left, "word"), return_inverse=True)
    sets = {}
    for name in SETS:
        sets[name] = np.zeros((len(gids), len(words)), dtype=np.int64)
        sets[name][row, at] = left.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    none = np.zeros(len(words), dtype=np.int64)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for gid, own, won, lost in gathered(left, right, gids, ("won", "lost")) if len(gids) else ():
        own_winners, own_players = (sets[c][own] if own is not None else none for c in SETS[:2])
        carried = np.bitwise_or.reduce(sets["win_winners"][won], axis=0)
        players = np.bitwise_or.reduce(sets["win_players"][won], axis=0) | np.bitwise_or.reduce(sets["loss_players"][lost], axis=0)
        players |= own_players
        some = np.flatnonzero(players | own_winners | carried)
        for column, x in zip(out, (np.full(len(some), gid), words[some], own_winners[some], carried[some], players[some]), strict=True):
            column.append(x)
    gid, word, own_winners, carried, players = map(_joined, out)
    bits = [pa.array(x, mask=x == 0) for x in (own_winners, carried, own_winners | carried, players)]
    return pa.table([pa.array(gid), pa.array(word), *bits], names=UNITED)


def united_words(groups: DataFrame, own: DataFrame, pairs: DataFrame, **limits: int) -> DataFrame:
    """Player sets of all groups after carrying over (``UNITED``); ``own`` has ``gid``, ``word`` and ``SETS``."""
    lists = with_bucket(source_lists(pairs), groups)
    tiles = tiled(with_bucket(own, groups), lists, "word", ["gid"], **limits)
    alone = own.join(groups.where(F.col("bucket").isNull()).select("gid"), "gid", "left_semi")
    unknown = F.lit(None).cast("bigint")
    kept = alone.select(
        "gid", "word", "own_winners", unknown.alias("carried"), F.col("own_winners").alias("winners"), F.col("own_players").alias("players")
    )
    return tiles.applyInArrow(_united, ", ".join(f"{c} bigint" for c in UNITED)).unionByName(kept)


def _first_met(left: pa.Table, right: pa.Table, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every taker the seat (row) at which it first meets each player, and whether that is after the top match.

    Own seats at the top match come before all others, then own seats and those of sources in their ``order``.
    """
    n = left.num_rows
    gids, row = np.unique(_values(left, "gid"), return_inverse=True)
    players, at = np.unique(_values(left, "player"), return_inverse=True)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)

    def firsts(chosen: np.ndarray, value: np.ndarray) -> np.ndarray:
        m = np.full((len(gids), len(players)), 2 * n, dtype=np.int64)
        np.minimum.at(m, (row[chosen], at[chosen]), value[chosen])
        return m

    win, loss, top = (left.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for c in ("win", "loss", "top"))
    seats = {"won": firsts(win, rank + n), "lost": firsts(loss, rank + n)}
    own_seats = firsts(_values(left, "home"), np.where(top, rank, rank + n))
    never = np.full(len(players), 2 * n)
    for gid, own, won, lost in gathered(left, right, gids, ("won", "lost")) if n else ():
        best = own_seats[own] if own is not None else never
        for name, rows in (("won", won), ("lost", lost)):
            if len(rows):
                best = np.minimum(best, seats[name][rows].min(axis=0))
        best = best[best < 2 * n]
        yield gid, order[best % n], best >= n


def _first(left: pa.Table, right: pa.Table) -> pa.Table:
    """The first place at which each player meets each taker."""
    order = pc.sort_indices(left, sort_keys=[(c, "ascending") for c in ("start", "match", "place")], null_placement="at_start").to_numpy()
    out: list[list[np.ndarray]] = [[], [], []]
    for gid, seats, late in _first_met(left, right, order):
        for column, x in zip(out, (np.full(len(seats), gid), seats, late.astype(np.int32)), strict=True):
            column.append(x)
    gid, seat, part = map(_joined, out)
    columns = [left.column(c).take(pa.array(seat)) for c in ("player", "start", "match", "place")]
    return pa.table([pa.array(gid), columns[0], pa.array(part.astype(np.int32)), *columns[1:]], names=["gid", "player", "part", "start", "match", "place"])


def first_seats(groups: DataFrame, seats: DataFrame, pairs: DataFrame, **limits: int) -> DataFrame:
    """``gid``, ``player`` and ``first_seen``, the place where the player first comes up for the group.

    ``seats``: ``gid``, ``player``, ``start``, ``match``, ``place``, whether the match is the group's ``top``, and
    whether the seat goes to others by a ``win`` or a ``loss``.
    """
    kind = dict(seats.dtypes)
    ddl = f"gid bigint, player bigint, part int, start {kind['start']}, match {kind['match']}, place int"
    lists = with_bucket(source_lists(pairs), groups)
    place = F.struct("part", "start", "match", "place").alias("first_seen")
    found = tiled(with_bucket(seats, groups), lists, "player", ["gid"], **limits).applyInArrow(_first, ddl).select("gid", "player", place)
    alone = seats.join(groups.where(F.col("bucket").isNull()).select("gid"), "gid", "left_semi")
    own = alone.withColumn("part", F.when(F.col("top"), 0).otherwise(1)).select("gid", "player", place)
    return found.unionByName(own.groupBy("gid", "player").agg(F.min("first_seen").alias("first_seen")))


def packed(**columns: pa.Array) -> bytes:
    """Columns as one compressed text, so that many values travel as one short row."""
    batch = pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(parts: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts]).combine_chunks()


PIECES = "gid bigint, cell string, part binary"


def _pieces(rows: list[tuple[int, str, bytes]]) -> pa.Table:
    gid, cell, part = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(gid, pa.int64()), pa.array(cell, pa.string()), pa.array(part, pa.binary())], names=["gid", "cell", "part"])


def _met_in_order(gid: int, cell: str, at: np.ndarray, late: np.ndarray, names: pa.Array) -> tuple[int, str, bytes]:
    found = pa.table([pa.array(late), pa.array(at), names], names=["late", "at", "name"])
    order = np.lexsort((at, late))
    if len(np.unique(at)) < len(at):  # names decide
        order = pc.sort_indices(found, sort_keys=[(c, "ascending") for c in found.column_names]).to_numpy()
    found = found.take(pa.array(order))
    return gid, cell, packed(**{c: found.column(c).combine_chunks() for c in found.column_names})


def member_pieces(groups: DataFrame, seats: DataFrame, pairs: DataFrame, cell: str, **limits: int) -> DataFrame:
    """What ``first_seats`` finds as ``PIECES`` of a list cell: the names of some players of a group, in the order of their first places.

    ``seats`` have the ``name`` to be listed and their place among all seats as a number ``at`` instead of start, match and place.
    A piece has the players of one tile, so a group has as many pieces as its bucket has slices.
    """

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        at, names = _values(left, "at"), left.column("name").combine_chunks()
        found = _first_met(left, right, np.argsort(at, kind="stable"))
        return _pieces([_met_in_order(gid, cell, at[rows], late, names.take(pa.array(rows))) for gid, rows, late in found if len(rows)])

    def alone(own: pa.Table) -> pa.Table:
        gid = own.column("gid")[0].as_py()
        return _pieces([_met_in_order(gid, cell, _values(own, "at"), _values(own, "late"), own.column("name").combine_chunks())])

    lists = with_bucket(source_lists(pairs), groups)
    found = tiled(with_bucket(seats, groups), lists, "player", ["gid"], **limits).applyInArrow(tile, PIECES)
    rest = seats.join(groups.where(F.col("bucket").isNull()).select("gid"), "gid", "left_semi")
    first = rest.groupBy("gid", "player", "name").agg(F.min(F.struct((~F.col("top")).alias("late"), "at")).alias("first"))
    return found.unionByName(first.select("gid", "name", "first.late", "first.at").groupBy("gid").applyInArrow(alone, PIECES))


def replay_pieces(groups: DataFrame, replays: DataFrame, pairs: DataFrame, named: dict[str, str], **limits: int) -> DataFrame:
    """The ``replays`` (``gid``, ``kind``, ``replay``) that groups take from others, as ``PIECES`` of list cells, sorted.

    ``named`` has the names of the cells of the kinds ``Win`` and ``Loss``. No row is made for a pair of groups and a replay.
    """

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        values = left.column("replay").combine_chunks()
        order = pc.sort_indices(values, null_placement="at_start").to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        gids, kinds = _values(left, "gid"), left.column("kind")
        takers = _values(right, "gid")
        rows = []
        for kind, listed in (("Win", "won"), ("Loss", "lost")):
            mine = np.flatnonzero(pc.equal(kinds, kind).to_numpy(zero_copy_only=False))
            mine = mine[np.argsort(gids[mine], kind="stable")]
            held, ranks = np.unique(gids[mine], return_index=True), rank[mine]
            if not len(mine):
                continue
            by_group = np.split(ranks, held[1][1:])
            for gid, sources in zip(takers, _listed(right, listed, held[0]), strict=True):
                if len(sources):
                    taken = np.sort(np.concatenate([by_group[i] for i in sources]))
                    rows.append((gid, named[kind], packed(value=values.take(pa.array(order[taken])))))
        return _pieces(rows)

    lists = with_bucket(source_lists(pairs), groups)
    return tiled(with_bucket(replays, groups), lists, "replay", ["gid"], matrix=False, **limits).applyInArrow(tile, PIECES)


def with_cells(table: DataFrame, pieces: DataFrame, lists: Sequence[str], texts: Sequence[str], value: T.DataType, n_rows: int) -> DataFrame:
    """``table`` (``n_rows`` rows, one a ``gid``) with its list cells put together from their pieces, in one shuffle.

    ``lists``: sorted arrays of ``value``, empty without pieces; ``texts``: names joined by commas.
    """
    schema = T.StructType(
        [*table.schema.fields, *[T.StructField(c, T.ArrayType(value)) for c in lists], *[T.StructField(c, T.StringType()) for c in texts]]
    )
    deal = F.pmod(F.xxhash64("gid"), F.lit(-(-n_rows // CELL_ROWS) or 1)).alias("deal")

    def listed(parts: list[bytes]) -> pa.Array:
        if not parts:
            return pa.array([], to_arrow_type(value))
        found = unpacked(parts).column("value").combine_chunks()
        return found if len(parts) == 1 else found.take(pc.sort_indices(found, null_placement="at_start"))

    def told(parts: list[bytes]) -> str:
        if not parts:
            return ""
        found = unpacked(parts)
        if len(parts) > 1:
            found = found.sort_by([(c, "ascending") for c in ("late", "at", "name")])
        return ", ".join(found.column("name").drop_null().to_pylist())

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[tuple[int, str], list[bytes]] = {}
        for gid, cell, part in zip(*(right.column(c).to_pylist() for c in ("gid", "cell", "part")), strict=True):
            parts.setdefault((gid, cell), []).append(part)
        gids, left = left.column("gid").to_pylist(), left.drop_columns(["deal"])
        for name in lists:
            found = [listed(parts.get((gid, name), [])) for gid in gids]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            left = left.append_column(name, pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found) if found else listed([])))
        for name in texts:
            left = left.append_column(name, pa.array([told(parts.get((gid, name), [])) for gid in gids], pa.string()))
        return left

    return table.select("*", deal).groupBy("deal").cogroup(pieces.select("*", deal).groupBy("deal")).applyInArrow(fill, schema)


def _union_sizes(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many bits of the tile's words each record's groups hold together."""
    gids, row = np.unique(_values(left, "gid"), return_inverse=True)
    words, at = np.unique(_values(left, "word"), return_inverse=True)
    bits = np.zeros((len(gids), len(words)), dtype=np.int64)
    bits[row, at] = _values(left, "bits")
    sizes = np.zeros(right.num_rows, dtype=np.int64)
    for i, rows in enumerate(_listed(right, "groups", gids) if len(gids) else ()):
        sizes[i] = np.bitwise_count(np.bitwise_or.reduce(bits[rows], axis=0).view(np.uint64)).sum()
    keys = [c for c in right.schema.names if c not in ("bucket", "part", "slice", "groups")]
    return pa.table([*[right.column(c) for c in keys], pa.array(sizes)], names=[*keys, "size"])


def union_sizes(sets: DataFrame, records: DataFrame, key: Sequence[str], **limits: int) -> DataFrame:
    """Size of the union of the sets (``bucket``, ``gid``, ``word``, ``bits``) of each record's list ``groups`` as ``size``."""
    kept = records.select("bucket", *key, F.size("groups").alias("n_sources"), "groups")
    out = T.StructType([*[records.schema[c] for c in key], T.StructField("size", T.LongType())])
    tiles = tiled(sets, kept, "word", key, **limits).applyInArrow(_union_sizes, out)
    return tiles.groupBy(*key).agg(F.sum("size").alias("size"))
