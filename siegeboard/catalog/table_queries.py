"""Queries of the general operators on the order, event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as nu
from ..functions import text as tx
from ..functions.ordinals import ordinal
from ..operators import columns as co
from ..operators import importance as im
from ..operators import joins as jo
from ..operators import names as na
from ..operators import profile as pr
from ..operators.clean import cast_matches as cast_settings
from ..operators.clean import parse_start_time
from ..operators.filters import known_sources, lobby_players
from ..operators.cells import build_cells, search_cells
from ..operators.knn import knn
from ..operators.ranking import games_label, top_k_per, with_row_index
from ..operators.tiers import first_rows
from .matchview import table
from .registry import query


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's order priority is the name in use at the order date."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("userId"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderdate").alias("start"),
        F.col("o_orderkey").alias("match"),
    )


@query(
    "latest_names",
    "select o_custkey user_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as name from orders group by 1",
)
def latest_names(spark, sf):
    return na.latest_names(sightings(spark, sf)).select(F.col("userId").alias("user_id"), "name")


@query(
    "aliases",
    """select distinct o_custkey user_id, o_orderpriority as name from orders
       where o_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
)
def aliases(spark, sf):
    return na.aliases(sightings(spark, sf), "1-URGENT").select(F.col("userId").alias("user_id"), "name")


@query(
    "new_rows_anti",
    "select o_orderkey id, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
)
def new_rows_anti(spark, sf):
    """Orders that no returned line mentions."""
    batch = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    known = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return jo.new_matches(batch, known)


@query(
    "update_join",
    """select o_orderkey, coalesce(x.o_totalprice, o.o_totalprice) o_totalprice, coalesce(x.o_orderstatus, o.o_orderstatus) o_orderstatus
       from orders o left join (select l_orderkey k, max(l_extendedprice) o_totalprice,
         max(case when l_linestatus = 'O' then 'X' end) o_orderstatus from lineitem where l_returnflag = 'R' group by 1) x on x.k = o_orderkey""",
)
def update_join(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.max("l_extendedprice").alias("o_totalprice"),
            F.max(F.when(F.col("l_linestatus") == "O", "X")).alias("o_orderstatus"),
        )
    )
    return jo.update(left, right, ["o_orderkey"])


@query(
    "fill_missing",
    """select o_orderkey, coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, flag) status
       from orders left join (select l_orderkey k, max(case when l_returnflag <> 'N' then l_returnflag end) flag from lineitem group by 1) x
       on x.k = o_orderkey""",
)
def fill_missing(spark, sf):
    left = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    right = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("status"))
    )
    return jo.fill_where_missing(left, right, ["o_orderkey"], {"status": jo.itself})


@query(
    "one_to_one_join",
    """select o_orderkey, o_totalprice, cast(n as bigint) n_lines from orders
       left join (select l_orderkey k, count(*) n from lineitem group by 1) x on x.k = o_orderkey""",
)
def one_to_one_join(spark, sf):
    """Left join with both keys checked to be unique."""
    left = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return jo.join_one_to_one(left, right, ["o_orderkey"])


@query("label_lookup", "select c_custkey, c_name, n_name from customer left join nation on n_nationkey = c_nationkey")
def label_lookup(spark, sf):
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = jo.join_unique(table(spark, sf, "customer"), labels, ["c_nationkey"])
    return found.select("c_custkey", "c_name", "n_name")


@query(
    "backup_repair",
    """select o_orderkey, coalesce(case when o_orderstatus = 'F' then o_orderstatus end, x.s) o_orderstatus,
         coalesce(case when o_orderstatus <> 'O' then o_orderpriority end, x.p) o_orderpriority
       from orders left join (
         select l_orderkey k, arg_min(case when l_returnflag <> 'N' then l_returnflag end,
             case when l_returnflag <> 'N' then (l_linenumber, l_partkey, l_suppkey, l_extendedprice) end) s,
           arg_min(case when l_linestatus = 'O' then l_returnflag || l_linestatus end,
             case when l_linestatus = 'O' then (l_linenumber, l_partkey, l_suppkey, l_extendedprice) end) p
         from lineitem group by 1) x on x.k = o_orderkey""",
)
def backup_repair(spark, sf):
    """Gaps in orders filled from the first usable line, all lines folded in one pass."""
    orders = table(spark, sf, "orders")
    main = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    lines = table(spark, sf, "lineitem")
    backups = lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("o_orderstatus"),
        F.when(F.col("l_linestatus") == "O", F.concat("l_returnflag", "l_linestatus")).alias("o_orderpriority"),
    )
    probes = {"o_orderstatus": jo.itself, "o_orderpriority": jo.itself}
    return jo.repair(main, backups, "at", "o_orderkey", probes)


def gappy_parts(spark, sf) -> DataFrame:
    """Parts with nulls, a constant, an all-null and an empty-text column."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("p_type"),
        F.col("p_brand"),
        F.lit("").alias("tweakdefs9"),
        F.lit(None).cast("int").alias("unused"),
        F.lit(1.0).alias("multiplier_x"),
        F.lit("fixed").alias("p_state"),
    )


@query(
    "null_profile",
    """select 'p_size' setting, count(*) as "value" from part where p_size <= 10
       union all select 'p_type', count(*) from part where p_type = 'SMALL' union all select 'unused', count(*) from part""",
)
def null_profile(spark, sf):
    return pr.null_profile(gappy_parts(spark, sf))


@query(
    "distinct_counts",
    """select 'p_size' as "column", count(distinct p_size) filter (p_size > 10) + 1 n_unique from part
       union all select 'p_type', count(distinct p_type) filter (p_type <> 'SMALL') + 1 from part
       union all select 'p_brand', count(distinct p_brand) from part union all select 'unused', 1
       union all select 'p_state', 1""",
)
def distinct_counts(spark, sf):
    return pr.distinct_counts(gappy_parts(spark, sf), ["p_size", "p_type", "p_brand", "unused", "p_state"])


@query(
    "constant_columns",
    "select p_partkey, case when p_size > 10 then p_size end p_size, p_brand, case when p_type <> 'SMALL' then p_type end p_type from part",
)
def constant_columns(spark, sf):
    """Columns with a single value are found in one pass and dropped."""
    parts = gappy_parts(spark, sf)
    return co.drop_constant_columns(parts, [c for c in parts.columns if c != "p_partkey"])[0]


@query(
    "drop_empty",
    """select p_partkey, case when p_size > 10 then p_size end p_size, case when p_type <> 'SMALL' then p_type end p_type,
       p_brand, 1.0::double multiplier_x, 'fixed' p_state from part""",
)
def drop_empty(spark, sf):
    return co.drop_empty_columns(gappy_parts(spark, sf))


@query(
    "column_sizes",
    """select 'p_partkey' as "column", cast(8 * count(p_partkey) as bigint) bytes from part
       union all select 'p_name', cast(sum(strlen(p_name)) as bigint) from part
       union all select 'p_brand', cast(sum(strlen(p_brand)) as bigint) from part
       union all select 'p_type', cast(sum(strlen(p_type)) as bigint) from part
       union all select 'p_size', cast(4 * count(p_size) as bigint) from part
       union all select 'p_retailprice', cast(8 * count(p_retailprice) as bigint) from part""",
)
def column_sizes(spark, sf):
    return pr.column_sizes(table(spark, sf, "part"))


@query(
    "schema_drift",
    """select column_name as "column", case data_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
         when 'TIMESTAMP' then 'timestamp' else lower(data_type) end as type
       from information_schema.columns where table_name = 'orders' and column_name not in ('o_orderkey', 'o_custkey', 'o_orderdate')""",
)
def schema_drift(spark, sf):
    return co.schema_drift(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query(
    "spawn_mult",
    """select l_orderkey, l_linenumber, l_partkey, round(case when l_shipdate >= timestamp '1998-06-06' then x
         when x = 0 then 1.0 else 1.0 / x end, 6) mult
       from (select *, coalesce(case when l_returnflag <> 'R' then cast(l_quantity % 4 as double) end, 1.0::double) x from lineitem)""",
)
def spawn_mult(spark, sf):
    """Spawn multipliers; ship dates are moved so that the change day falls inside the data."""
    lines = table(spark, sf, "lineitem")
    raw = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") % 4)
    moved = F.col("l_shipdate") + F.expr("interval 26 years")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(nu.normalize_spawn_mult(raw, moved), 6).alias("mult")
    )


@query(
    "ordinal_levels",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2
         when '4-NOT SPECIFIED' then 3 when '5-LOW' then 4 end level from orders""",
)
def ordinal_levels(spark, sf):
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", ordinal(F.col("o_orderpriority"), levels).alias("level"))


@query(
    "fill_defaults",
    """select p_partkey, case when p_size > 10 then p_size else 0 end p_size, case when p_type <> 'SMALL' then p_type else 'none' end p_type from part""",
)
def fill_defaults(spark, sf):
    parts = gappy_parts(spark, sf).select("p_partkey", "p_size", "p_type")
    return co.fill_defaults(parts, {"p_size": 0, "p_type": "none", "absent": 1})


@query(
    "narrow_ints",
    """select * from (values ('l_linenumber', 'tinyint'), ('l_partkey', null), ('l_quantity', 'tinyint'), ('l_tax', 'double')) t("column", type)
       where type is not null
       union all select 'l_partkey', case when max(l_partkey) < 128 then 'tinyint' when max(l_partkey) < 32768 then 'smallint' else 'int' end from lineitem""",
)
def narrow_ints(spark, sf):
    """Types after narrowing, one row per column."""
    names = ["l_linenumber", "l_partkey", "l_quantity", "l_tax"]
    kinds = dict(co.narrow_integers(table(spark, sf, "lineitem").select(*names), names).dtypes)
    return spark.createDataFrame([(c, kinds[c]) for c in names], "column string, type string")


@query(
    "narrow_ints_values",
    "select l_orderkey, cast(l_linenumber as bigint) l_linenumber, cast(l_quantity as bigint) l_quantity, l_tax from lineitem",
)
def narrow_ints_values(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    narrow = co.narrow_integers(lines, ["l_linenumber", "l_quantity", "l_tax"])
    return narrow.select("l_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("l_linenumber", "l_quantity")], "l_tax")


@query(
    "quantize_1dp",
    "select l_orderkey, l_linenumber, l_partkey, round(cast(cast(l_discount as decimal(18, 2)) as decimal(18, 1))::double, 1) rate from lineitem",
)
def quantize_1dp(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", nu.quantize_1dp(F.col("l_discount")).alias("rate")
    )


@query(
    "parse_start_time",
    'select o_orderkey, cast(epoch(o_orderdate) as bigint) "at" from orders',
)
def parse_start(spark, sf):
    """ISO texts made from the order dates, read back as timestamps."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.unix_timestamp(parse_start_time(iso)).alias("at")
    )


@query(
    "map_name_normalize",
    r"""select p_partkey, regexp_replace(p_name || case p_size % 4 when 0 then '_v' || p_size || '.2' when 1 then ' ' || p_size
         when 2 then ' V' || p_size || 'b' else '' end, '(?i)[_\s]+[v\d\.]+\w*$', '') map_name from part""",
)
def map_name_normalize(spark, sf):
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    suffix = (
        F.when(kind == 0, F.concat(F.lit("_v"), size, F.lit(".2")))
        .when(kind == 1, F.concat(F.lit(" "), size))
        .when(kind == 2, F.concat(F.lit(" V"), size, F.lit("b")))
        .otherwise("")
    )
    return table(spark, sf, "part").select(
        "p_partkey", tx.normalize_map_name(F.concat("p_name", suffix)).alias("map_name")
    )


@query(
    "hyperlink",
    """select o_orderkey, case when n is null then ' ' else '=hyperlink("https://replays.example/' || f || '";"' || n || '")' end link
       from orders left join (select l_orderkey k, string_agg(l_partkey, ', ' order by l_partkey) n, min(l_partkey) f
         from (select distinct l_orderkey, l_partkey from lineitem where l_returnflag = 'R') group by 1) x on x.k = o_orderkey""",
)
def hyperlink(spark, sf):
    ids = (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")).alias("ids"))
    )
    joined = table(spark, sf, "orders").select("o_orderkey").join(ids, "o_orderkey", "left")
    return joined.select("o_orderkey", tx.hyperlink(F.col("ids"), "https://replays.example/").alias("link"))


@query(
    "display_formats",
    """select l_orderkey, l_linenumber, l_partkey, cast(cast(round(l_discount * 100, 0) as bigint) as varchar) || '%' as percent,
         a || repeat(' ', greatest(0, 4 - length(a))) one_decimal, b || repeat(' ', greatest(0, 4 - length(b))) wide_decimal,
         case when l_linenumber = 1 then '' else cast(l_linenumber - 1 as varchar) end blank,
         case when l_linenumber = 1 then '' else cast((l_linenumber - 1) * 0.5::double as varchar) end blank_double,
         case when l_quantity > 20 then '>20' else cast(cast(l_quantity as int) as varchar) end games from (select *,
           regexp_replace(cast(cast(round(l_quantity / 4, 1) as decimal(18, 1)) as varchar), '\\.0+$', '') a,
           regexp_replace(cast(cast(round(l_quantity * 1001 / 4, 1) as decimal(18, 1)) as varchar), '\\.0+$', '') b from lineitem)""".replace("\\\\", "\\"),
)
def display_formats(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        tx.percent(F.col("l_discount")).alias("percent"),
        tx.one_decimal(F.col("l_quantity") / 4).alias("one_decimal"),
        tx.one_decimal(F.col("l_quantity") * 1001 / 4).alias("wide_decimal"),
        tx.blank_zero(F.col("l_linenumber") - 1).alias("blank"),
        tx.blank_zero((F.col("l_linenumber") - 1) * F.lit(0.5)).alias("blank_double"),
        games_label(F.col("l_quantity").cast("int")).alias("games"),
    )


@query(
    "union_diagonal",
    """select n_nationkey as "key", n_name as "name", n_regionkey, null::double s_acctbal from nation
       union all select r_regionkey, r_name, null, null from region union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def union_diagonal(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return co.diagonal_union(nation, region, supplier)


@query(
    "append_rows",
    """select o_orderkey as id, o_totalprice as amount from orders where o_orderstatus = 'F'
       union all select l_orderkey, cast(l_linenumber as double) from lineitem where l_returnflag = 'R'""",
)
def append_rows(spark, sf):
    """Append with the batch's integers widened to the table's doubles."""
    base = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    batch = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_linenumber").alias("amount"), F.col("l_orderkey").alias("id"))
    return co.append_rows(base, batch)


@query(
    "align_columns",
    """select s_suppkey as id, s_name, s_acctbal, null::varchar n_name from supplier
       union all select n_nationkey, null, null, n_name from nation""",
)
def align_columns(spark, sf):
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")
    right = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), "n_name")
    a, b = co.align_columns(left, right)
    return a.unionByName(b)


@query("distinct_rows", "select distinct c_nationkey, c_mktsegment from customer")
def distinct_rows(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query(
    "array_ops",
    """select l_orderkey, array_to_string(list_sort(list_distinct(list_concat(r, n))), ',') united,
         array_to_string(list_sort(list_distinct(list_filter(r, lambda x: not list_contains(n, x)))), ',') only_r
       from (select l_orderkey, coalesce(list(l_suppkey) filter (l_returnflag = 'R'), []) r,
               coalesce(list(l_suppkey) filter (l_returnflag <> 'R'), []) n from lineitem group by 1)""",
)
def array_ops(spark, sf):
    """List union and difference; both keep one of each."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("r"),
        F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("n"),
    )

    def text(ids):
        return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")

    return lists.select(
        "l_orderkey", text(F.array_union("r", "n")).alias("united"), text(F.array_except("r", "n")).alias("only_r")
    )


@query(
    "interpolate",
    "select l_orderkey, l_linenumber, l_partkey, round(0 + (greatest(10.0, least(l_quantity, 40.0)) - 10) / 30.0::double * 100, 6) y from lineitem",
)
def interpolate(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(nu.interpolate(F.col("l_quantity"), 10, 40, 0, 100), 6).alias("y")
    )


@query(
    "required_teammates",
    """select l_orderkey, l_linenumber, l_partkey, round(greatest(1.0::double, 0.010523765015405669::double * (l_quantity * l_quantity)
         + 2.4052341883892385::double * l_quantity - 1.1838543289368846::double), 6) needed from lineitem""",
)
def required_teammates(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(nu.required_teammates(F.col("l_quantity")), 6).alias("needed")
    )


@query(
    "label_pack",
    """select vec_id, cast(round(label / 10.0::double * 1e8, 0) as bigint) + vec_id packed,
         round((cast(round(label / 10.0::double * 1e8, 0) as bigint) + vec_id)::double / 1e6, 6) percent from embeddings""",
)
def label_pack(spark, sf):
    packed = nu.pack_label(F.col("label") / 10, F.col("vec_id"))
    return table(spark, sf, "embeddings").select(
        "vec_id", packed.alias("packed"), F.round(nu.unpack_label(packed), 6).alias("percent")
    )


def label_centers(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label, as queries."""
    cells = vectors.select("label", F.posexplode("embedding").alias("axis", "value"))
    means = cells.groupBy("label", "axis").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    packed = F.array_sort(F.collect_list(F.struct("axis", "mean")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(packed, lambda c: c["mean"]).alias("vector")
    )


NEAREST_SQL = """with cells as (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings),
   centers as (select label, list(m order by i) q from (select label, i, avg(v) m from cells group by 1, 2) group by 1),
   gaps as (select c.label query_id, vec_id base_id, list_sum(list_transform(list_zip(c.q, e.embedding),
       lambda x: (x[1] - x[2]::double) * (x[1] - x[2]::double))) distance from centers c cross join embeddings e)
   select cast(query_id as bigint) query_id, cast(place as bigint) place, base_id, round(distance, 4) distance from (
     select *, row_number() over (partition by query_id order by distance, base_id) place from gaps) where place <= 8"""


@query("knn_l2_exact", NEAREST_SQL)
def knn_l2_exact(spark, sf):
    """Eight nearest vectors to the mean of every label."""
    vectors = table(spark, sf, "embeddings")
    base = vectors.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector"))
    near = knn(label_centers(vectors), base, 8)
    return near.select(
        "query_id", F.col("place").cast("bigint").alias("place"), "base_id", F.round("distance", 4).alias("distance")
    )


@query("lsh_knn", NEAREST_SQL)
def lsh_knn(spark, sf):
    """``knn_l2_exact`` through an index of cells, which reads only cells that can hold a nearest vector."""
    vectors = table(spark, sf, "embeddings")
    index = build_cells(vectors.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector")))
    near = search_cells(index, label_centers(vectors), 8)
    return near.select(
        "query_id", F.col("place").cast("bigint").alias("place"), "base_id", F.round("distance", 4).alias("distance")
    )


LINE_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_tax"]


@query(
    "corr_features",
    " union all ".join(f"select '{c}' \"Feature\", round(corr({c}, l_discount), 6) correlation from lineitem" for c in LINE_FEATURES),
)
def corr_features(spark, sf):
    found = im.correlations(table(spark, sf, "lineitem"), LINE_FEATURES, "l_discount")
    return found.select("Feature", F.round("correlation", 6).alias("correlation"))


@query(
    "f_scores",
    " union all ".join(
        f"select '{c}' \"Feature\", round(power(corr({c}, l_discount), 2) / (1 - power(corr({c}, l_discount), 2)) * (count(*) - 2), 4) f_score from lineitem"
        for c in LINE_FEATURES
    ),
)
def f_scores(spark, sf):
    found = im.f_scores(table(spark, sf, "lineitem"), LINE_FEATURES, "l_discount")
    return found.select("Feature", F.round("f_score", 4).alias("f_score"))


@query(
    "category_f_scores",
    " union all ".join(
        f"""select '{c}_' || v "Feature", round(power(r, 2) / (1 - power(r, 2)) * (n - 2), 4) f_score from (
            select v, (select corr(case when {c} = v then 1.0 else 0.0 end, l_quantity) from lineitem) r, (select count(*) from lineitem) n
            from (select distinct {c} v from lineitem))"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def category_f_scores(spark, sf):
    found = im.category_f_scores(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return found.select("Feature", F.round("f_score", 4).alias("f_score"))


@query("prefix_counts", "select split_part(p_name, ' ', 1) as prefix, count(*) n from part group by 1")
def prefix_counts(spark, sf):
    return pr.prefix_counts(table(spark, sf, "part"), "p_name", " ")


@query(
    "top_k_per",
    """select l_suppkey, cast(place as bigint) place, l_orderkey, l_extendedprice from (select *, row_number() over (partition by l_suppkey
         order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) place from lineitem) where place <= 5""",
)
def top_k(spark, sf):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    rows = top_k_per(table(spark, sf, "lineitem"), ["l_suppkey"], order, 5)
    return rows.select("l_suppkey", F.col("place").cast("bigint").alias("place"), "l_orderkey", "l_extendedprice")


@query(
    "row_index",
    "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 idx from orders",
)
def row_index(spark, sf):
    """Global row numbers from range-sorted parts."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_row_index(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], name="idx").select("o_orderkey", "idx")


@query(
    "zip_rows",
    """select n_name, r_name from (select n_name, row_number() over (order by n_nationkey) i from nation)
       full join (select r_name, row_number() over (order by r_regionkey) i from region) using (i)""",
)
def zip_rows(spark, sf):
    left = table(spark, sf, "nation").select("n_nationkey", "n_name")
    right = table(spark, sf, "region").select("r_regionkey", "r_name")
    return jo.zip_rows(left, [F.col("n_nationkey")], right, [F.col("r_regionkey")]).select("n_name", "r_name")


@query(
    "first_rows",
    "select o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 1000",
)
def first_rows_query(spark, sf):
    """The first thousand orders in time, the cap of the barbarian side."""
    orders = table(spark, sf, "orders")
    return first_rows(orders, 1000, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query(
    "known_sources",
    "select p_partkey from part where p_size > 10 and p_type <> 'SMALL'",
)
def known_sources_query(spark, sf):
    return known_sources(gappy_parts(spark, sf), ["p_size", "p_type"]).select("p_partkey")


@query(
    "lobby_players",
    """select s_suppkey, s_acctbal from supplier where s_name in (
         select s_name from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1)""",
)
def lobby_players_query(spark, sf):
    """Suppliers of one region as a lobby; a host bot per nation is left out."""
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation").where(F.col("n_regionkey") == 1)
    here = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lobby = here.select(F.col("s_name").alias("Player")).unionByName(
        nation.select(F.concat(F.lit("Host["), "n_name", F.lit("]")).alias("Player"))
    )
    ratings = supplier.withColumnRenamed("s_name", "Player")
    return lobby_players(ratings, lobby).select("s_suppkey", "s_acctbal")


@query("select_numeric", "select p_partkey, p_size, p_retailprice from part")
def select_numeric(spark, sf):
    return co.select_like(table(spark, sf, "part"), kind="numeric")


@query("select_pattern", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def select_pattern(spark, sf):
    return co.select_like(table(spark, sf, "lineitem"), r"(flag|status|date)$", drop=True)


@query("unnest_struct", "select o_orderkey, o_custkey, o_totalprice from orders")
def unnest_struct(spark, sf):
    packed = table(spark, sf, "orders").select("o_orderkey", F.struct("o_custkey", "o_totalprice").alias("facts"))
    return co.unnest(packed, "facts")


@query(
    "lobby_number",
    r"select l_orderkey, l_linenumber, l_partkey, regexp_replace(regexp_replace(cast(l_quantity - 1 as varchar), '\.0+$', ''), '^0$', '') shown from lineitem",
)
def lobby_number(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.lobby_number((F.col("l_quantity") - 1).cast("string")).alias("shown")
    )


@query(
    "cast_matches",
    """select cast(o_orderkey as varchar) id, cast(epoch(o_orderdate) as bigint) started, cast(o_custkey as bigint) startmetal,
         case when o_orderpriority = '1-URGENT' then '' else o_orderpriority end tweakdefs1,
         cast(cast(o_totalprice / 1000 as decimal(18, 1)) as double) multiplier_buildpower,
         case o_orderstatus when 'F' then 0 else 1 end noair, case o_orderstatus when 'P' then 3 else 10 end levelcap,
         case o_orderstatus when 'O' then 'epic' else 'easy' end raptor_difficulty from orders""",
)
def cast_matches(spark, sf):
    """Orders under setting names: texts in, typed and filled settings out."""
    status = F.col("o_orderstatus")
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startTime"),
        F.col("o_custkey").cast("string").alias("startmetal"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("tweakdefs1"),
        (F.col("o_totalprice") / 1000).alias("multiplier_buildpower"),
        F.when(status != "F", "1").alias("unit_restrictions_noair"),
        F.when(status == "P", "3").alias("evocomlevelcap"),
        F.when(status == "O", "epic").otherwise("easy").alias("raptor_difficulty"),
    )
    typed = cast_settings(raw)
    return typed.select(
        "id",
        F.unix_timestamp("startTime").alias("started"),
        F.col("startmetal").cast("bigint").alias("startmetal"),
        "tweakdefs1",
        "multiplier_buildpower",
        F.col("unit_restrictions_noair").cast("int").alias("noair"),
        F.col("evocomlevelcap").cast("int").alias("levelcap"),
        "raptor_difficulty",
    )


@query("reorder_columns", "select o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def reorder_columns(spark, sf):
    orders = table(spark, sf, "orders").drop("o_orderdate")
    return co.reorder_column(co.reorder_column(orders, 0, "o_totalprice"), 3, "absent")


@query(
    "cast_strings",
    "select cast(p_partkey as varchar) p_partkey, cast(p_size as varchar) p_size, p_type from part",
)
def cast_strings(spark, sf):
    return co.cast_strings(table(spark, sf, "part").select("p_partkey", "p_size", "p_type"), ["p_partkey", "p_size", "absent"])
