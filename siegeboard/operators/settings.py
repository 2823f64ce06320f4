"""Setting columns: types, defaults, roles per AI."""

from __future__ import annotations

from ..roles import Gate, SettingRoles

# Tweak columns in their published order.
TWEAK_COLUMNS = [
    "tweakunits",
    *[f"tweakunits{i}" for i in range(1, 10)],
    "tweakdefs",
    *[f"tweakdefs{i}" for i in range(1, 10)],
]

# Text columns besides the tweaks.
TEXT_COLUMNS = [
    "assistdronesenabled", "commanderbuildersenabled", "comrespawn", "deathmode", "draft_mode",
    "experimentalshields", "experimentalstandardgravity", "lootboxes_density", "lootboxes", "map_tidal",
    "mapmetadata_startpos", "raptor_raptorstart", "ruins_density", "ruins", "scav_scavstart", "scoremode",
    "teamcolors_anonymous_mode", "teamcolors_icon_dev_mode", "transportenemy", *TWEAK_COLUMNS,
]

# Whole-number columns.
INTEGER_COLUMNS = [
    "accuratelasers", "ai_incomemultiplier", "air_rework", "allowpausegameplay", "allowuserwidgets",
    "animationcleanup", "april1", "april1extra", "assistdronesair", "assistdronesbuildpowermultiplier",
    "assistdronescount", "capturebonus", "captureradius", "capturetime", "commanderbuildersbuildpower",
    "commanderbuildersrange", "coop", "critters", "debugcommands", "decapspeed", "defaultdecals",
    "disable_fogofwar", "disablemapdamage", "dominationscore", "dominationscoretime", "durationMs",
    "easter_egg_hunt", "easteregghunt", "emprework", "energy_share_rework", "energyperpoint", "evocom",
    "evocomlevelcap", "experimentalextraunits", "experimentalimprovedtransports", "experimentallegionfaction",
    "experimentalmassoverride", "experimentalnoaircollisions", "experimentalrebalancet2energy",
    "experimentalrebalancet2labs", "experimentalrebalancet2metalextractors",
    "experimentalrebalancewreckstandarization", "experimentalreversegear", "faction_limiter", "ffa_wreckage",
    "fixedallies", "forceallunits", "fullDurationMs", "junorework", "lategame_rebalance", "limitscore",
    "map_atmosphere", "map_waterislava", "map_waterlevel", "maxunits", "metalperpoint", "no_comtrans", "norush",
    "norushtimer", "numberofcontrolpoints", "proposed_unit_reworks", "ranked_game", "raptor_endless",
    "raptor_spawncountmult", "releasecandidates", "ruins_civilian_disable", "ruins_only_t1", "scav_endless",
    "scav_spawncountmult", "scoremode_chess_adduptime", "scoremode_chess_spawnsperphase",
    "scoremode_chess_unbalanced", "scoremode_chess", "shareddynamicalliancevictory", "skyshift", "slow_comtrans",
    "startenergy", "startenergystorage", "startmetal", "startmetalstorage", "starttime",
    "teamffa_start_boxes_shuffle", "tugofwarmodifier", "unbacom", "unified_maxslope", "unit_market",
    "unit_restrictions_noair", "unit_restrictions_noconverters", "unit_restrictions_noendgamelrpc",
    "unit_restrictions_noextractors", "unit_restrictions_nolrpc", "unit_restrictions_nonukes",
    "unit_restrictions_notacnukes", "unit_restrictions_notech2", "unit_restrictions_notech3", "usemapconfig",
    "usemexconfig",
]

# Columns kept with one decimal.
ONE_DECIMAL_COLUMNS = [
    "evocomleveluprate", "evocomxpmultiplier", "experimentalxpgain", "multiplier_builddistance",
    "multiplier_buildpower", "multiplier_buildtimecost", "multiplier_energyconversion", "multiplier_energycost",
    "multiplier_energyproduction", "multiplier_losrange", "multiplier_maxdamage", "multiplier_maxvelocity",
    "multiplier_metalcost", "multiplier_metalextraction", "multiplier_radarrange", "multiplier_resourceincome",
    "multiplier_shieldpower", "multiplier_turnrate", "multiplier_weapondamage", "multiplier_weaponrange",
    "raptor_firstwavesboost", "raptor_graceperiodmult", "raptor_queentimemult", "scav_bosstimemult",
    "scav_graceperiodmult", "unbacomleveluprate",
]

SPAWN_COLUMNS = ["raptor_spawntimemult", "scav_spawntimemult"]

# Order of text levels.
DIFFICULTY_LEVELS = ("veryeasy", "easy", "normal", "hard", "veryhard", "epic")
SWITCH_LEVELS = ("disabled", "enabled")
HP_LEVELS = ("Epic", "Epic+", "Epic++", "Epicer+", "Epicer++", "Epicest")
LEVELS = {
    "nuttyb_hp": HP_LEVELS,
    "scav_difficulty": DIFFICULTY_LEVELS,
    "raptor_difficulty": DIFFICULTY_LEVELS,
    "assistdronesenabled": SWITCH_LEVELS,
    "commanderbuildersenabled": SWITCH_LEVELS,
}

# Columns that are known but not settings.
OTHER_KNOWN_COLUMNS = [
    "AllyTeams", "AllyTeamsList", "awards", "Barbarian Handicap", "Barbarian Per Player", "barbarian_win",
    "barbarian", "draw", "evocomlevelupmethod", "fetch_success", "id", "is_player_ai_mixed", "Map Name", "Map",
    "nuttyb_hp", "player_win", "players", "raptor_difficulty", "raptors_win", "raptors", "scav_difficulty",
    "scavengers_win", "scavengers", "startTime", "supported_ais", "winners",
]
KNOWN_COLUMNS = [*TEXT_COLUMNS, *INTEGER_COLUMNS, *ONE_DECIMAL_COLUMNS, *SPAWN_COLUMNS, *OTHER_KNOWN_COLUMNS]

# What a missing setting means.
SETTING_DEFAULTS = {
    "evocomleveluprate": 5,
    "evocomlevelcap": 10,
    "evocomlevelupmethod": "dynamic",
    **{c: "" for c in TEXT_COLUMNS},
    **{c: 0 for c in INTEGER_COLUMNS if c.startswith("unit_restrictions_")},
    **{
        c: 0
        for c in (
            "accuratelasers", "april1", "april1extra", "easter_egg_hunt", "easteregghunt", "evocom", "forceallunits",
        )
    },
    **{
        c: 1
        for c in (
            "evocomxpmultiplier", "multiplier_maxdamage", "multiplier_energycost", "multiplier_metalcost",
            "multiplier_buildtimecost", "scav_graceperiodmult",
        )
    },
}

# A larger value is harder.
HIGHER_HARDER = [
    "maxunits", "multiplier_buildtimecost", "multiplier_energycost", "multiplier_maxvelocity",
    "multiplier_metalcost", "nuttyb_hp", "raptor_difficulty", "raptor_firstwavesboost", "raptor_spawncountmult",
    "raptor_spawntimemult", "scav_difficulty", "scav_spawntimemult", "unit_restrictions_noextractors",
    "unit_restrictions_notech2", "unit_restrictions_notech3",
]

# A smaller value is harder.
LOWER_HARDER = [
    "accuratelasers", "assistdronesbuildpowermultiplier", "assistdronescount", "assistdronesenabled",
    "commanderbuildersbuildpower", "commanderbuildersenabled", "commanderbuildersrange", "comrespawn",
    "disable_fogofwar", "evocom", "evocomleveluprate", "evocomxpmultiplier", "experimentalextraunits",
    "experimentallegionfaction", "forceallunits", "lootboxes", "multiplier_builddistance",
    "multiplier_buildpower", "multiplier_energyconversion", "multiplier_energyproduction", "multiplier_losrange",
    "multiplier_metalextraction", "multiplier_radarrange", "multiplier_resourceincome",
    "multiplier_shieldpower", "multiplier_turnrate", "multiplier_weapondamage", "multiplier_weaponrange",
    "unit_restrictions_nonukes", "raptor_queentimemult", "raptor_graceperiodmult", "releasecandidates",
    "scav_bosstimemult", "scav_graceperiodmult", "startenergy", "startenergystorage", "startmetal",
    "startmetalstorage",
]

# Must be equal, besides the tweaks.
EQUAL_COLUMNS = [
    "evocomlevelupmethod", "experimentalshields", "lootboxes_density", "multiplier_maxdamage",
    "raptor_raptorstart", "unit_restrictions_noair", "unit_restrictions_noendgamelrpc",
    "unit_restrictions_nolrpc", "unit_restrictions_notacnukes",
]

# Must be equal in barbarian matches, besides the tweaks.
BARBARIAN_EQUAL_COLUMNS = [
    "evocom", "evocomlevelcap", "evocomlevelupmethod", "evocomleveluprate", "evocomxpmultiplier",
    "experimentalextraunits", "experimentallegionfaction", "forceallunits", "lootboxes_density", "lootboxes",
    "multiplier_builddistance", "multiplier_buildpower", "multiplier_buildtimecost",
    "multiplier_energyconversion", "multiplier_energycost", "multiplier_energyproduction",
    "multiplier_losrange", "multiplier_maxdamage", "multiplier_maxvelocity", "multiplier_metalcost",
    "multiplier_metalextraction", "multiplier_radarrange", "multiplier_resourceincome",
    "multiplier_shieldpower", "multiplier_turnrate", "multiplier_weapondamage", "multiplier_weaponrange",
    "ruins_civilian_disable", "ruins_density", "ruins_only_t1", "ruins", "startenergy", "startenergystorage",
    "startmetal", "startmetalstorage", "unit_restrictions_noair", "unit_restrictions_noconverters",
    "unit_restrictions_noendgamelrpc", "unit_restrictions_noextractors", "unit_restrictions_nolrpc",
    "unit_restrictions_nonukes", "unit_restrictions_notacnukes", "unit_restrictions_notech2",
    "unit_restrictions_notech3",
]
BARBARIAN_HIGHER_HARDER = ["Barbarian Per Player", "Barbarian Handicap"]
BARBARIAN_LOWER_HARDER = ["comrespawn", "disable_fogofwar"]

# Switch, the value that turns it off, and the name part of what it governs.
GATE_RULES = [
    ("evocom", 0, "evocom"),
    ("commanderbuildersenabled", "disabled", "commanderbuilders"),
    ("assistdronesenabled", "disabled", "assistdrones"),
]


def ai_roles(ai: str) -> SettingRoles:
    """Setting roles for ``Barbarian``, ``Raptors`` or ``Scavengers`` matches."""
    if ai == "Barbarian":
        equal = [*BARBARIAN_EQUAL_COLUMNS, *TWEAK_COLUMNS]
        higher, lower = BARBARIAN_HIGHER_HARDER, BARBARIAN_LOWER_HARDER
    else:
        foreign = {"Raptors": "scav_", "Scavengers": "raptor_"}[ai]
        equal, higher, lower = (
            [c for c in names if foreign not in c]
            for names in ([*EQUAL_COLUMNS, *TWEAK_COLUMNS], HIGHER_HARDER, LOWER_HARDER)
        )
    gates = []
    for switch, off, part in GATE_RULES:
        names = [c for c in [*equal, *higher, *lower] if part in c]
        governed = [c for c in names if not (c == switch and c in lower)]
        gates.append(Gate(switch, off, tuple(governed)))
    return SettingRoles(
        map_column="Map Name",
        equal=tuple(equal),
        higher=tuple(higher),
        lower=tuple(lower),
        optional=tuple(c for c in ("nuttyb_hp",) if c in higher),
        gates=tuple(gates),
        levels={c: v for c, v in LEVELS.items() if c in {*equal, *higher, *lower}},
    )
