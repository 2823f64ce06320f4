"""What each setting column means when two matches are compared."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Gate:
    """While ``switch`` holds ``off`` on the source, ``members`` are not compared."""

    switch: str
    off: object
    members: tuple[str, ...]


@dataclass(frozen=True)
class SettingRoles:
    """Setting columns by role.

    ``equal`` must match, a larger ``higher`` and a smaller ``lower`` value is
    harder. ``optional`` columns are among ``higher``; a null there only meets a
    null. ``levels`` gives the order of text levels. ``map_column`` must match.
    """

    map_column: str
    equal: tuple[str, ...] = ()
    higher: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    gates: tuple[Gate, ...] = ()
    levels: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def settings(self) -> list[str]:
        return sorted({*self.equal, *self.higher, *self.lower})

    @property
    def keys(self) -> list[str]:
        return [self.map_column, *self.settings]

    @property
    def compared(self) -> list[str]:
        """Columns in which a source must not be null."""
        return [c for c in self.keys if c not in self.optional]

    def gates_of(self, column: str) -> list[Gate]:
        return [g for g in self.gates if column in g.members]

    def keep(self, columns) -> "SettingRoles":
        """The same roles on the columns that are still there."""
        have = set(columns)

        def kept(names):
            return tuple(n for n in names if n in have)

        gates = tuple(
            Gate(g.switch, g.off, kept(g.members)) for g in self.gates if g.switch in have
        )
        return replace(
            self,
            equal=kept(self.equal),
            higher=kept(self.higher),
            lower=kept(self.lower),
            optional=kept(self.optional),
            gates=gates,
        )


@dataclass(frozen=True)
class MatchColumns:
    """Names of the match columns an operator reads."""

    id: str = "id"
    start: str = "startTime"
    duration: str = "durationMs"
    ai_win: str = "ai_win"
    players: str = "players"
    winners: str = "winners"
    damage: str = "damage_award"
    damage_value: str = "damage_award_value"
    eco: str = "eco_award"
