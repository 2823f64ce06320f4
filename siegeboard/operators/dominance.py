"""Results carried to comparable settings.

A win on settings that are at least as hard counts for a group too, and so does
a loss on settings that are at most as hard. All matches of a group share
their settings, so the comparison runs between groups, not between matches.

Plan: groups with equal map and equal-role settings share a ``bucket``. A bucket's groups lie
in blocks of bounded size: up to two setting columns (the pivots) are cut into a few ordered
levels, small neighbouring level cells make one block and a large cell makes several.
Sources and targets are both held in blocks. Of every block the lowest and highest value of each
compared setting are known, so pairs of blocks that cannot match are dropped before any
group moves. What is left is an equi-join on the pair of blocks with the exact comparison
as residual: a bucket with a third of all groups becomes many small tasks. Levels and blocks
only steer the work; any choice gives the same rows. The pairs are written once, by outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.keys import col, fingerprint
from ..functions.ordinals import ordinal
from ..plans.joins import join_lookup, join_skewed
from ..roles import MatchColumns, SettingRoles
from ..session import store
from .carry import first_seats, member_pieces, replay_pieces, united_words, with_cells
from .groups import difficulty, group_table, member_words, with_group_key
from .ranking import with_row_index

LEVELS = 8
BLOCK_GROUPS = 256
PAIRS_PER_TASK = 1 << 22
MAX_TASKS = 32_000


@dataclass(frozen=True)
class Pivot:
    """A range column cut into levels at ``splits``; ``rises`` when larger is harder."""

    name: str
    splits: tuple[float, ...]
    rises: bool

    def level(self) -> Column:
        value = F.col(self.name)
        steps = [F.when(value >= F.lit(s), 1).otherwise(0) for s in self.splits]
        return sum(steps[1:], steps[0])


@dataclass(frozen=True)
class Comparable:
    """Groups ready to be compared: ``groups`` is stored and has the ``block`` of each.

    ``axes`` maps a compared setting to the short column that holds its value,
    text levels turned into their place. ``meetings`` are the pairs of blocks
    (``s_block``, ``t_block``) of which some groups may match, by outcome (``easier``), ``tasks`` over how many tasks
    the comparisons are spread.
    """

    groups: DataFrame
    meetings: DataFrame
    roles: SettingRoles
    axes: dict[str, str]
    gates: dict[str, str]
    tasks: int


def _gated(roles: SettingRoles, name: str) -> bool:
    return bool(roles.gates_of(name))


def _axis_value(roles: SettingRoles, name: str) -> Column:
    return ordinal(col(name), roles.levels[name]) if name in roles.levels else col(name)


def _choose_pivots(groups: DataFrame, axes: dict[str, str], roles: SettingRoles, count: int):
    """The ``count`` ungated numeric range settings with most values, with level splits.

    One aggregate; only a handful of numbers per setting reaches the driver.
    """
    numeric = {f.name for f in groups.schema.fields if isinstance(f.dataType, T.NumericType)}
    usable = [
        c
        for c in [*roles.higher, *roles.lower]
        if not _gated(roles, c) and c not in roles.optional and axes[c] in numeric
    ]
    if not usable or count == 0:
        return ()
    shares = [i / LEVELS for i in range(1, LEVELS)]
    stats = groups.agg(
        *[F.approx_count_distinct(axes[c]).alias(f"n_{axes[c]}") for c in usable],
        *[F.percentile_approx(axes[c], shares, 200).alias(f"q_{axes[c]}") for c in usable],
        *[F.min(axes[c]).alias(f"m_{axes[c]}") for c in usable],
    ).first()
    ranked = sorted(usable, key=lambda c: (-stats[f"n_{axes[c]}"], c))
    pivots = []
    for name in ranked:
        axis = axes[name]
        low = stats[f"m_{axis}"]
        splits = tuple(sorted({float(q) for q in (stats[f"q_{axis}"] or []) if q > low}))
        if splits:
            pivots.append(Pivot(axis, splits, name in roles.higher))
        if len(pivots) == count:
            break
    return tuple(pivots)


def comparable_groups(
    groups: DataFrame,
    roles: SettingRoles,
    by: Sequence[str] = (),
    pivots: int = 2,
    block_groups: int = BLOCK_GROUPS,
) -> Comparable:
    """Give groups an id, a bucket and comparison axes, and store them."""
    plain_equal = [c for c in roles.equal if not _gated(roles, c)]
    on_axis = [c for c in roles.settings if c not in plain_equal]
    axes = {c: f"x{i}" for i, c in enumerate(on_axis)}
    switches = [g.switch for g in roles.gates]
    gates = {s: f"off{i}" for i, s in enumerate(switches)}
    bucket_parts = [*by, roles.map_column, *plain_equal]
    not_null = [col(c).isNotNull() for c in roles.compared]
    is_source = not_null[0]
    for part in not_null[1:]:
        is_source = is_source & part
    bucket_known = col(bucket_parts[0]).isNotNull()
    for part in bucket_parts[1:]:
        bucket_known = bucket_known & col(part).isNotNull()
    ready = groups.select(
        F.monotonically_increasing_id().alias("gid"),
        *groups.columns,
        F.when(bucket_known, fingerprint(bucket_parts)).alias("bucket"),
        is_source.alias("is_source"),
        *[_axis_value(roles, c).alias(axes[c]) for c in on_axis],
        *[
            F.coalesce(col(g.switch) == F.lit(g.off), F.lit(False)).alias(gates[g.switch])
            for g in roles.gates
        ],
    )
    placed = store(ready)
    chosen = _choose_pivots(placed, axes, roles, pivots)
    cell = [f"level_{p.name}" for p in chosen]
    for pivot in chosen:
        placed = placed.withColumn(f"level_{pivot.name}", F.coalesce(pivot.level(), F.lit(0)))
    blocked = store(_in_blocks(placed, cell, block_groups))
    meetings = store(_meetings(blocked, roles, axes, gates))
    compared = meetings.agg(F.sum(F.col("n_sources").cast("double") * F.col("n_targets"))).first()[0] or 0.0
    return Comparable(blocked, meetings, roles, axes, gates, _comparison_tasks(groups.sparkSession, compared))


def _in_blocks(groups: DataFrame, cell: Sequence[str], block_groups: int) -> DataFrame:
    """Add ``block``: neighbouring small cells of a bucket together, a large cell in several by hash.

    Only counts of cells, a few dozen a bucket, are put in order.
    """
    place = [F.col(c) for c in cell] or [F.lit(0)]
    cells = groups.where(F.col("bucket").isNotNull()).groupBy("bucket", *cell).agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("bucket").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("held") > block_groups
    small_before = F.coalesce(F.sum(F.when(~large, F.col("held"))).over(before), F.lit(0))
    numbered = cells.select(
        F.col("bucket").alias("_bucket"),
        *[F.col(c).alias(f"_{c}") for c in cell],
        F.when(large, F.ceil(F.col("held") / block_groups)).otherwise(1).alias("_parts"),
        F.when(large, F.concat(F.lit("cell "), F.concat_ws(" ", *cell)))
        .otherwise(F.concat(F.lit("run "), F.floor(small_before / block_groups).cast("string")))
        .alias("_name"),
    )
    same = F.col("bucket") == F.col("_bucket")
    for c in cell:
        same = same & (F.col(c) == F.col(f"_{c}"))
    part = F.pmod(F.xxhash64("gid"), F.col("_parts"))
    joined = groups.join(numbered, same, "left")
    return joined.withColumn("block", F.when(F.col("_name").isNotNull(), F.xxhash64("bucket", "_name", part))).drop(
        "_bucket", "_parts", "_name", *[f"_{c}" for c in cell]
    )


def _meetings(groups: DataFrame, roles: SettingRoles, axes: dict[str, str], gates: dict[str, str]) -> DataFrame:
    """Pairs of blocks of one bucket that may hold a pair of groups, with the number of groups on either side.

    A pair is out if for some compared setting no value of the one block can suit any of the other. An
    optional setting that both blocks leave open, or a gate that is open for some source, leaves them in.
    """
    ends = [
        e
        for a in axes.values()
        for e in (F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}"), F.bool_or(F.col(a).isNull()).alias(f"un_{a}"))
    ]
    held = groups.where(F.col("block").isNotNull())

    def side(df: DataFrame, mark: str) -> DataFrame:
        opened = [F.bool_or(g).alias(g) for g in gates.values()]
        found = df.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"), *ends, *opened)
        return found.select("bucket", *[F.col(c).alias(f"{mark}_{c}") for c in found.columns if c != "bucket"])

    targets = side(held, "t")

    def met(easier: bool) -> DataFrame:
        counted = F.col("n_wins") if easier else F.col("n_losses")
        possible = F.lit(True)
        for name, a in axes.items():
            if name in roles.higher or name in roles.lower:
                down = easier == (name in roles.higher)
                fits = F.col(f"t_lo_{a}") <= F.col(f"s_hi_{a}") if down else F.col(f"t_hi_{a}") >= F.col(f"s_lo_{a}")
            else:
                fits = (F.col(f"t_lo_{a}") <= F.col(f"s_hi_{a}")) & (F.col(f"t_hi_{a}") >= F.col(f"s_lo_{a}"))
            fits = F.coalesce(fits, F.lit(False))
            if name in roles.optional:
                fits = fits | (F.col(f"s_un_{a}") & F.col(f"t_un_{a}"))
            for gate in roles.gates_of(name):
                fits = fits | F.col(f"s_{gates[gate.switch]}")
            possible = possible & fits
        pairs = side(held.where(F.col("is_source") & (counted > 0)), "s").join(targets, "bucket").where(possible)
        return pairs.select(
            F.lit(easier).alias("easier"), "s_block", "t_block", F.col("s_n").alias("n_sources"), F.col("t_n").alias("n_targets")
        )

    return met(True).unionByName(met(False))


def _comparison_tasks(spark, compared: float) -> int:
    """Tasks for so many comparisons.

    The rows are few bytes but many comparisons, so the number comes from the
    comparisons and is not left to byte sizes.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = 2 * min(partitions, spark.sparkContext.defaultParallelism)
    return max(spread, min(MAX_TASKS, int(compared // PAIRS_PER_TASK) + 1))


def _comparison(state: Comparable, easier: bool) -> Column:
    """Exact residual between source columns ``s_*`` and target columns."""
    roles, axes = state.roles, state.axes
    condition = F.lit(True)
    for name, axis in axes.items():
        source, target = F.col(f"s_{axis}"), F.col(axis)
        if name in roles.higher:
            test = target <= source if easier else target >= source
        elif name in roles.lower:
            test = target >= source if easier else target <= source
        else:
            test = target == source
        if name in roles.optional:
            test = (source.isNull() & target.isNull()) | test
        for gate in roles.gates_of(name):
            test = F.col(f"s_{state.gates[gate.switch]}") | test
        condition = condition & test
    return condition


def match_targets(state: Comparable, easier: bool) -> DataFrame:
    """Pairs ``(source, gid)`` where the source's result counts for the target.

    ``easier`` pairs won groups with targets that are no harder, otherwise lost
    groups with targets that are no easier. A group that can be a source is paired with itself too.
    """
    compared = [*state.axes.values()]
    counted = F.col("n_wins") if easier else F.col("n_losses")
    meetings = state.meetings.where(F.col("easier") == easier).select("s_block", "t_block")
    sources = state.groups.where(F.col("is_source") & (counted > 0)).select(
        F.col("gid").alias("source"),
        F.col("block").alias("s_block"),
        *[F.col(a).alias(f"s_{a}") for a in compared],
        *[F.col(g).alias(f"s_{g}") for g in state.gates.values()],
    )
    targets = state.groups.where(F.col("block").isNotNull()).select("gid", F.col("block").alias("t_block"), *compared)
    keys = ["s_block", "t_block"]
    left = sources.join(meetings, "s_block").repartition(state.tasks, *keys)
    right = targets.join(meetings, "t_block").repartition(state.tasks, *keys)
    return left.join(right.hint("shuffle_hash"), keys).where(_comparison(state, easier)).select("source", "gid")


def pair_table(state: Comparable) -> DataFrame:
    """All pairs of both outcomes (``easier``), written once; each outcome is a folder of its own."""
    both = [match_targets(state, e).select(F.lit(e).alias("easier"), "source", "gid") for e in (True, False)]
    return store(both[0].unionByName(both[1]), partition_by=("easier",))


@dataclass(frozen=True)
class ExtendedGroups:
    """Groups with carried results; all tables are stored.

    ``pairs``: the pair table.
    ``words``: gid, word, own_winners, winners, players and carried, the winners
    that come from other groups (bit sets).
    ``sized``: the group table plus #Winners, #Players and Difficulty.
    """

    state: Comparable
    pairs: DataFrame
    own_words: DataFrame
    words: DataFrame
    sized: DataFrame


def extend_results(
    matches_df: DataFrame,
    roles: SettingRoles,
    matches: MatchColumns,
    by: Sequence[str] = (),
    pivots: int = 2,
    block_groups: int = BLOCK_GROUPS,
) -> ExtendedGroups:
    """Player sets and difficulty of every group after carrying results over."""
    keyed = with_group_key(matches_df, roles, by)
    state = comparable_groups(group_table(keyed, roles, matches, by), roles, by, pivots, block_groups)
    ids = state.groups.select("group_key", "gid")
    own = store(member_words(keyed.join(ids, "group_key"), matches, "gid"))
    pairs = pair_table(state)
    words = store(united_words(state.groups, own, pairs))
    sizes = words.groupBy("gid").agg(
        F.coalesce(F.sum(F.bit_count("winners")), F.lit(0)).alias("#Winners"),
        F.coalesce(F.sum(F.bit_count("players")), F.lit(0)).alias("#Players"),
    )
    sized = (
        state.groups.join(sizes, "gid", "left")
        .na.fill(0, ["#Winners", "#Players"])
        .withColumn("Difficulty", difficulty(F.col("#Winners"), F.col("#Players")))
    )
    return ExtendedGroups(state, pairs, own, words, store(sized))


def _others(extended: ExtendedGroups, easier: bool) -> DataFrame:
    """Stored pairs of one outcome without those of a group with itself."""
    return extended.pairs.where((F.col("easier") == easier) & (F.col("source") != F.col("gid"))).select("source", "gid")


def merged_replays(extended: ExtendedGroups, replays: DataFrame, takers: DataFrame | None = None) -> DataFrame:
    """Replays of other groups that count for each group, one row per group and replay.

    ``replays`` is the output of ``own_replays``; the result has ``gid, kind, replay``. ``takers`` (``gid`` and more
    columns, one row a group) limits the groups and adds its columns: they are looked up for the pairs, before these meet
    the replays, so that the rows of the result are not shuffled any more.
    """
    ids = extended.state.groups.select("group_key", "gid")
    by_group = join_lookup(replays, ids, ["group_key"], "inner").select(F.col("gid").alias("source"), "kind", "replay")
    wanted = store(by_group, partition_by=("kind",))
    out = ["gid", "kind", "replay", *([] if takers is None else [c for c in takers.columns if c != "gid"])]

    def carried(easier: bool, kind: str) -> DataFrame:
        pairs = _others(extended, easier)
        if takers is not None:
            pairs = join_lookup(pairs, takers, ["gid"], "inner")
        return join_skewed(pairs, wanted.where(F.col("kind") == kind), ["source"]).select(*[col(c) for c in out])

    return carried(True, "Win").unionByName(carried(False, "Loss"))


def ordered_members(
    extended: ExtendedGroups,
    matches_df: DataFrame,
    matches: MatchColumns,
    by: Sequence[str] = (),
    winners_only: bool = False,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Own and carried players of each group with their place in the report.

    First come the players of the group's top match (highest damage, unknown
    first), then everybody else by the earliest match that brings them. The place is
    the struct ``first_seen``; rows are one per group and player, so no list is
    built here. ``targets`` limits the groups.
    """
    pairs = extended.pairs.where("easier") if winners_only else extended.pairs
    rows = first_seats(extended.state.groups, _seats(extended, matches_df, matches, by, winners_only), pairs)
    return rows if targets is None else rows.join(targets.select("gid"), "gid", "left_semi")


def _seats(extended: ExtendedGroups, matches_df: DataFrame, matches: MatchColumns, by: Sequence[str], winners_only: bool) -> DataFrame:
    """Every player of every match with the place in its list, and what ``first_seats`` needs to know."""
    ids = extended.state.groups.select("group_key", "gid", "is_source")
    keyed = with_group_key(matches_df, extended.state.roles, by).join(ids, "group_key")
    listed = col(matches.winners if winners_only else matches.players)
    seen = keyed.select(
        "gid",
        "is_source",
        col(matches.ai_win).alias("ai_win"),
        col(matches.start).alias("start"),
        col(matches.id).alias("match"),
        F.posexplode(listed).alias("place", "player"),
    ).where(F.col("player").isNotNull())

    top = keyed.groupBy("gid").agg(
        F.min(F.struct((-col(matches.damage_value)).alias("minus_damage"), col(matches.id).alias("match"))).alias("top")
    )
    handed, nobody = F.col("is_source"), F.lit(False)
    return join_lookup(seen, top, ["gid"], "inner").select(
        "gid",
        "player",
        "start",
        "match",
        "place",
        F.coalesce(F.col("match") == F.col("top.match"), nobody).alias("top"),
        F.coalesce(handed & ~F.col("ai_win"), nobody).alias("win"),
        (nobody if winners_only else F.coalesce(handed & F.col("ai_win"), nobody)).alias("loss"),
    )


#: Groups times players, and gathered replays, of a tile that makes list cells.
CELL_VALUES = 4 << 20
#: A seat's number is that of its match, shifted by so many bits, and its place there.
PLACE_BITS = 24


def report_cells(
    extended: ExtendedGroups,
    table: DataFrame,
    matches_df: DataFrame,
    matches: MatchColumns,
    replays: DataFrame,
    names: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """``table`` (one row a ``gid``) with the merged replays and the named members of each group.

    What ``merged_replays`` and ``ordered_members`` hold as rows, but tiles hand on finished pieces of the cells, which
    are shuffled once. ``replays``: ``gid``, ``kind``, ``replay``; ``names``: ``player``, ``name``, all names of a player as one.
    """
    groups, pairs = extended.state.groups, extended.pairs
    start, match = col(matches.start).alias("start"), col(matches.id).alias("match")
    walk = store(with_row_index(matches_df.select(start, match).distinct(), [F.col(c).asc_nulls_first() for c in ("start", "match")], name="rank"))
    lists = {kind: f"Merged {kind} Replays" for kind in ("Win", "Loss")}
    pieces = replay_pieces(groups, replays, pairs, lists, cells=CELL_VALUES)
    for winners_only, cell in ((True, "Winners"), (False, "Players")):
        seats = _seats(extended, matches_df, matches, by, winners_only).join(
            walk.select(F.col("start").alias("_start"), F.col("match").alias("_match"), "rank"),
            F.col("start").eqNullSafe(F.col("_start")) & F.col("match").eqNullSafe(F.col("_match")),
        )
        at = F.shiftleft("rank", PLACE_BITS) + F.col("place")
        numbered = join_lookup(seats.select("gid", "player", at.alias("at"), "top", "win", "loss"), names.withColumn("_known", F.lit(True)), ["player"])
        unknown = F.raise_error(F.concat(F.lit("no name for user "), F.col("player").cast("string"))).cast("string")
        named = numbered.withColumn("name", F.when(F.col("_known").isNull(), unknown).otherwise(F.col("name"))).drop("_known")
        listed = pairs.where("easier") if winners_only else pairs
        pieces = pieces.unionByName(member_pieces(groups, store(named), listed, cell, cells=CELL_VALUES))
    return with_cells(table, pieces, [*lists.values()], ["Winners", "Players"], replays.schema["replay"].dataType, groups.count())
