"""The command log: its schema, validation, and replay as a fold in the order of seq.

Rows with a null seq, and those of other verbs, are left out; a seq that comes twice counts once. Reading commands change nothing.
An empty log gives the state it starts from. validate() finds blank keys and members; replay takes what it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import bloom

SCHEMA = (
    "seq bigint, ts_ms bigint, command string, key string, value string, ttl_ms bigint, not_exists boolean, bf_n int, bf_p double, z_score double, z_member string, z_idx int, "
    "z_start int, z_stop int, z_min double, z_max double, geo_member string, geo_member2 string, geo_lat double, geo_lon double, geo_radius double, h_field string, limit_n int"
)

# The commands and the arguments that may not be blank.
COMMANDS = {
    "PUT": ("key", "value"), "GET": ("key",), "DELETE": ("key",), "EXISTS": ("key",), "CLEAR": (), "LST_KEY": (),
    "BF_INIT": ("key",), "BF_ADD": ("key", "value"), "BF_EXISTS": ("key",), "BF_RM": ("key",), "BF_RS": ("key",),
    "Z_ADD": ("key", "value", "z_member"), "Z_INCR": ("key", "z_member"), "Z_SCR": ("key", "z_member"), "Z_RANK": ("key", "z_member"), "Z_POS": ("key",),
    "Z_RANGE": ("key",), "Z_RSCR": ("key",), "Z_TOP": ("key",), "Z_RM": ("key", "z_member"), "Z_DEL": ("key",),
    "GEO_ADD": ("key", "geo_member"), "GEO_SEARCH": ("key",), "GEO_DIST": ("key",), "GEO_GET": ("key", "geo_member"), "GEO_NB": ("key", "geo_member"),
    "GEO_EXISTS": ("key", "geo_member"), "GEO_ENCODE": ("key", "geo_member"), "GEO_RM": ("key", "geo_member"), "GEO_DEL": ("key",),
    "H_SET": ("key", "value", "h_field"), "H_GET": ("key", "h_field"), "H_ALL": ("key",), "H_RM": ("key", "h_field"), "H_DEL": ("key",),
}
PRESENT = {"GEO_DIST": ("geo_member", "geo_member2")}


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def reason() -> Column:
    """Why a command is refused; null if it is valid."""
    out = F.when(~F.coalesce(F.col("command").isin(list(COMMANDS)), F.lit(False)), "unknown command")
    for name in ("key", "value", "z_member", "geo_member", "h_field"):
        needing = [c for c, need in COMMANDS.items() if name in need]
        out = out.when(F.col("command").isin(needing) & _blank(name), f"blank {name}")
    for command, names in PRESENT.items():
        for name in names:
            out = out.when((F.col("command") == command) & F.col(name).isNull(), f"missing {name}")
    return out


def validate(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with the column reason)."""
    judged = commands.withColumn("reason", reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


#: What comes before every command: the seq of a state without one, and of a key that was never dropped.
FIRST = -(2**63) + 1


def _ordered(commands: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """The commands of some verbs after the last CLEAR, each seq once: of rows of one seq that differ, the greatest."""
    rows = commands.where(F.col("command").isin(*verbs, "CLEAR") & F.col("seq").isNotNull())
    names = [c for c in rows.columns if c != "seq"]
    rows = rows.groupBy("seq").agg(F.max(F.struct(*names)).alias("x")).select("seq", "x.*")
    cleared = rows.where("command = 'CLEAR'").agg(F.coalesce(F.max("seq"), F.lit(FIRST - 1)).alias("cleared"))
    return rows.where("command <> 'CLEAR'").crossJoin(F.broadcast(cleared)).where("seq > cleared").drop("cleared")  # one row


def _with_state(rows: DataFrame, commands: DataFrame, state: DataFrame | None, verb: str, names: dict[str, str]) -> DataFrame:
    """rows, preceded by the rows of a state (its columns by the log's names) as commands, unless a CLEAR is among the commands."""
    if state is None:
        return rows
    clear = commands.where("command = 'CLEAR'").agg(F.count("*").alias("clears"))
    old = state.crossJoin(F.broadcast(clear)).where("clears = 0")  # one row
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    back = {log: own for own, log in names.items()}
    columns = [F.lit(verb) if c == "command" else F.col(back[c]) if c in back else F.lit(FIRST) if c == "seq" else F.lit(None) for c in kinds]
    return rows.unionByName(old.select(*[x.cast(kinds[c]).alias(c) for x, c in zip(columns, kinds, strict=True)]))


def replay_kv(commands: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """kv(key, value, expire_at, seq) after PUT, DELETE and CLEAR commands, in the order of seq.

    What precedes a key's last unconditional command can't matter. Of the
    conditional puts after it, those that can't take effect are left out by
    pre-aggregated minima: all, if it put a pair without expiry; all but the
    first, if that finds no pair and puts one without expiry. Others are folded.
    """
    expiry = F.when(F.coalesce("ttl_ms", F.lit(0)) > 0, F.col("ts_ms") + F.col("ttl_ms"))
    rows = _ordered(commands.where("key is not null or command = 'CLEAR'"), ("PUT", "DELETE"))
    rows = rows.select("seq", "ts_ms", "command", "key", "value", expiry.alias("expire_at"), F.coalesce("not_exists", F.lit(False)).alias("nx"))
    if state is not None:
        names = {"key": "key", "value": "value", "expire_at": "expire_at", "seq": "seq"}
        rows = _with_state(rows, commands, state, "PUT", names).fillna({"nx": False, "ts_ms": 0})
    sure = ~F.col("nx") | (F.col("command") == "DELETE")
    last = rows.where(sure).groupBy("key").agg(F.max("seq").alias("base"), F.max_by(F.struct("command", "expire_at"), "seq").alias("b"))
    rows = rows.join(last, "key", "left").where(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
    first = rows.where(~sure).groupBy("key").agg(F.min("seq").alias("nx1"), F.min_by(F.struct("expire_at"), "seq").alias("n"))
    rows = rows.join(first, "key", "left")
    put = F.coalesce(F.col("b.command") == "PUT", F.lit(False))
    vain = F.when(put, F.col("b.expire_at").isNull()).otherwise(F.col("n.expire_at").isNull() & (F.col("seq") > F.col("nx1")))
    kept = rows.where(sure | ~F.coalesce(vain, F.lit(False)))
    steps = F.array_sort(F.collect_list(F.struct("seq", "ts_ms", "command", "value", "expire_at", "nx")))
    start = F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("expire_at"), F.lit(None).cast("bigint").alias("seq"))

    def step(a: Column, x: Column) -> Column:
        put = F.struct(F.lit(True).alias("on"), x["value"].alias("value"), x["expire_at"].alias("expire_at"), x["seq"].alias("seq"))
        lives = a["on"] & (a["expire_at"].isNull() | (x["ts_ms"] < a["expire_at"]))
        return F.when(x["command"] == "DELETE", start).when(x["nx"] & lives, a).otherwise(put)

    folded = kept.groupBy("key").agg(F.aggregate(steps, start, step).alias("x"))
    return folded.where("x.on").select("key", "x.value", "x.expire_at", "x.seq")


def _after_drops(rows: DataFrame, drop: str, remove: str, member: str) -> DataFrame:
    """The rows that set something, after the last drop of their key and the last removal of their member (pre-aggregated)."""
    dropped = rows.where(F.col("command") == drop).groupBy("key").agg(F.max("seq").alias("dropped"))
    gone = rows.where(F.col("command") == remove).groupBy("key", member).agg(F.max("seq").alias("gone"))
    left = rows.where(~F.col("command").isin(drop, remove)).join(dropped, "key", "left").join(gone, ["key", member], "left")
    return left.where("(dropped is null or seq > dropped) and (gone is null or seq > gone)").drop("dropped", "gone")


def replay_zset(commands: DataFrame, state: DataFrame | None = None, keep_equal: bool = True) -> DataFrame:
    """zset(key, member, score, value) after Z_ADD, Z_INCR, Z_RM, Z_DEL and CLEAR commands, in the order of seq.

    The increments of members that are never added are sums, pre-aggregated.
    Those of others are summed between the adds, over a sorted window and not
    in lists; an add of the score that is there leaves the value, or with
    keep_equal=False replaces it like any other add.
    """
    rows = _ordered(commands.select("seq", "command", "key", "z_member", "z_score", "value"), ("Z_ADD", "Z_INCR", "Z_RM", "Z_DEL"))
    rows = _with_state(rows, commands, state, "Z_ADD", {"key": "key", "member": "z_member", "score": "z_score", "value": "value"})
    rows = _after_drops(rows, "Z_DEL", "Z_RM", "z_member").withColumnRenamed("z_member", "member")
    of = ["key", "member"]
    added = rows.where("command = 'Z_ADD'").select(*of).distinct().withColumn("added", F.lit(True))
    rows = rows.join(added, of, "left")
    counters = rows.where("added is null").groupBy(*of).agg(F.sum("z_score").alias("score")).withColumn("value", F.col("member"))
    add = F.col("command") == "Z_ADD"
    order = W.partitionBy(*of).orderBy("seq")
    stretch = F.count_if(add).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))  # an add and the increments after it
    each = rows.where("added").withColumn("stretch", stretch).groupBy(*of, "stretch")
    each = each.agg(F.max(F.when(add, F.struct("z_score", "value"))).alias("a"), F.sum(F.when(~add, F.col("z_score"))).alias("more"))
    end = F.coalesce("a.z_score", F.when(F.col("a").isNull(), F.lit(0.0))) + F.coalesce("more", F.lit(0.0))
    each = each.withColumn("score", F.when(F.col("a").isNotNull() & F.col("more").isNull(), F.col("a.z_score")).otherwise(end))
    moved = F.col("a").isNotNull()
    if keep_equal:
        moved &= ~F.col("a.z_score").eqNullSafe(F.lag("score").over(W.partitionBy(*of).orderBy("stretch")))
    each = each.withColumn("moved", moved)
    out = each.groupBy(*of).agg(F.max_by("score", "stretch").alias("score"), F.max(F.when(F.col("moved"), F.struct("stretch", "a.value"))).alias("v"))
    return counters.select(*of, "score", "value").unionByName(out.select(*of, "score", F.when(F.col("v").isNotNull(), F.col("v.value")).otherwise(F.col("member")).alias("value")))


def replay_hash(commands: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """fields(key, field, value) after H_SET, H_RM, H_DEL and CLEAR commands, in the order of seq: the last write of each field after its last removal."""
    rows = _ordered(commands.select("seq", "command", "key", "h_field", "value"), ("H_SET", "H_RM", "H_DEL"))
    rows = _with_state(rows, commands, state, "H_SET", {"key": "key", "field": "h_field", "value": "value"})
    left = _after_drops(rows, "H_DEL", "H_RM", "h_field")
    return left.groupBy("key", F.col("h_field").alias("field")).agg(F.max_by("value", "seq").alias("value"))


def replay_geo(commands: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """geo(key, member, lat, lon, geohash) after GEO_ADD, GEO_RM, GEO_DEL and CLEAR commands, in the order of seq. Points out of bounds are refused."""
    rows = _ordered(commands.select("seq", "command", "key", "geo_member", "geo_lat", "geo_lon"), ("GEO_ADD", "GEO_RM", "GEO_DEL"))
    rows = rows.where((F.col("command") != "GEO_ADD") | geo.in_bounds(F.col("geo_lat"), F.col("geo_lon")))
    rows = _with_state(rows, commands, state, "GEO_ADD", {"key": "key", "member": "geo_member", "lat": "geo_lat", "lon": "geo_lon"})
    left = _after_drops(rows, "GEO_DEL", "GEO_RM", "geo_member")
    out = left.groupBy("key", F.col("geo_member").alias("member")).agg(F.max_by(F.struct(F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon")), "seq").alias("x"))
    return out.select("key", "member", "x.lat", "x.lon", geo.encode(F.col("x.lat"), F.col("x.lon")).alias("geohash"))


def replay_bloom(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, bits) after BF_INIT, BF_ADD, BF_RM, BF_RS and CLEAR commands, in the order of seq.

    A valid BF_INIT makes an empty filter, in place of one that is there; values
    count that are added after the last of it and of BF_RS.
    """
    rows = _ordered(commands.select("seq", "command", "key", "value", "bf_n", "bf_p"), ("BF_INIT", "BF_ADD", "BF_RM", "BF_RS"))
    rows = rows.where("command <> 'BF_INIT' or (bf_n > 0 and bf_p > 0 and bf_p < 1)")
    last = rows.where("command <> 'BF_ADD'").groupBy("key").agg(
        F.max_by(F.struct(F.col("bf_n").alias("n"), F.col("bf_p").alias("p"), "seq"), F.when(F.col("command") == "BF_INIT", F.col("seq"))).alias("x"),
        F.max(F.when(F.col("command") == "BF_RM", F.col("seq"))).alias("gone"),
        F.max(F.when(F.col("command") == "BF_RS", F.col("seq"))).alias("emptied"),
    )
    there = last.where("x.seq is not null and (gone is null or x.seq > gone)").select("key", "x.n", "x.p", F.greatest("x.seq", "emptied").alias("since"))
    defs = bloom.init(there)
    values = rows.where("command = 'BF_ADD'").join(there.select("key", "since"), "key").where("seq > since").select("key", "value").distinct()
    return defs, bloom.add(defs, None, values)
