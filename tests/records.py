"""Hand-written nested match records."""

SCHEMA = (
    "id string, startTime timestamp, durationMs bigint, Map struct<scriptName:string>, `Map Name` string, "
    "AllyTeams array<struct<winningTeam:boolean,"
    "Players:array<struct<teamId:int,userId:bigint,name:string,handicap:int>>,"
    "AIs:array<struct<shortName:string,handicap:int>>>>, "
    "awards struct<fightingUnitsDestroyed:array<struct<teamId:int,value:double>>,mostResourcesProduced:struct<teamId:int>>, "
    "fetch_success boolean"
)


def humans(won, *players):
    return (won, [(i, u, f"user{u}", h) for i, (u, h) in enumerate(players)], [])


def bots(won, *ais):
    return (won, [], list(ais))


def awards(damage=None, value=None, eco=None):
    units = [] if damage is None else [(damage, value)]
    return (units, (eco,))


def match(mid, teams, at="2024-07-01 10:00:00", duration=1000, given=None, script="Foo Bar_v1.2", name=None, fetched=True):
    import datetime

    when = datetime.datetime.fromisoformat(at)
    return (mid, when, duration, (script,), name, teams, given, fetched)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
