"""Golden vectors, edge cases and replay."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import geo as g
from keyloom.functions import hashing as h
from keyloom.operators import batches, bloom, fields, geoset, keyspace, kv, zset
from keyloom.plans.commands import SCHEMA, replay_bloom, replay_geo, replay_hash, replay_kv, replay_zset
from keyloom.sources import binary, codec
from keyloom.streaming.replay import Replay


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_string_hash(spark):
    known = {"": 0, "a": 97, "abc": 96354, "Customer#000000001": 478928364, "salt_thread_safe": 194965049, "Supplier#000000000": -102676903, "old rod": -1380939698}
    got = column(spark, [*known, None]).select("x", h.string_hash(F.col("x")).alias("h")).collect()
    assert {r.x: r.h for r in got} == known | {None: None}
    # a character beyond the basic plane counts as its two surrogates
    assert column(spark, ["\U0001f600"]).select(h.string_hash(F.col("x"))).first()[0] == 0xD83D * 31 + 0xDE00


def test_bloom_positions(spark):
    known = {"Customer#000000001": [2218, 4286, 8938, 4004, 8656, 3722, 8374], "Supplier#000000000": [5745, 2402, 6061, 134, 3793, 7452, 1525], "old rod": [7292, 5624, 3956, 2288, 620, 1536, 9454]}
    rows = column(spark, list(known)).select("x", h.bloom_positions(h.string_hash(F.col("x")), F.lit(9586), F.lit(7)).alias("p"))
    assert {r.x: list(r.p) for r in rows.collect()} == known
    made = bloom.init(spark.createDataFrame([("a", 1000, 0.01), ("b", 100, 0.05), ("c", 0, 0.1), ("d", 5, 1.0)], "key string, n int, p double"))
    assert sorted(map(tuple, made.collect())) == [("a", 9586, 7), ("b", 624, 5)]


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_bloom_blank_and_missing(spark, monkeypatch, most):
    defs = bloom.init(spark.createDataFrame([("a", 100, 0.05)], "key string, n int, p double"))
    bits = bloom.add(defs, None, spark.createDataFrame([("a", "x"), ("none", "x")], "key string, value string"))
    probes = spark.createDataFrame([("a", "x"), ("a", ""), ("a", None), ("none", "x"), ("none", "")], "key string, value string")
    assert all(r.flag == 0 for r in bloom.exists(defs.where("false"), bits.where("false"), probes).collect())
    monkeypatch.setattr(bloom, "BROADCAST_BITS", most)  # 0: the filters aren't broadcast
    assert {(r.key, r.value): r.flag for r in bloom.exists(defs, bits, probes).collect()} == {("a", "x"): 1, ("a", ""): 1, ("a", None): 1, ("none", "x"): 0, ("none", ""): 0}


def test_geo_golden(spark):
    known = {
        (21.0285, 105.8542): (3973593206939044, "w7gq8fbev90", 21.028499, 105.854198),
        (10.8231, 106.6297): (3967773008410538, "w65c4kvmgbh", 10.823099, 106.629695),
        (0.0, 0.0): (1125899906842623, "7zzzzzzzzzs", -0.000001, -0.000003),
        (85.05112878, 180.0): (4503599627370495, "zzzzzzzzzzs", 85.051129, 180.0),
    }
    df = spark.createDataFrame(list(known), "lat double, lon double").withColumn("h", g.encode(F.col("lat"), F.col("lon")))
    lat, lon = g.decode(F.col("h"))
    rows = df.select("lat", "lon", "h", g.base32(F.col("h")), F.round(lat, 6), F.round(lon, 6)).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in rows} == known
    near = df.where("lat > 20 and lat < 22").select(F.explode(g.neighbours(F.col("h"))).alias("x")).select("x.*").collect()
    expected = {"N": 45, "S": 41, "E": 46, "W": 22, "NE": 47, "NW": 23, "SE": 43, "SW": 19, "CT": 44}
    assert {r.dir: r.geohash - 3973593206939000 for r in near} == expected


def test_geo_search_everywhere(spark):
    """Box and cells lose nothing: at poles, the antimeridian and large radii."""
    points = spark.range(400).selectExpr("'k' as key", "concat('m', id) as member", "-85 + (id * 7919 % 17000) / 100.0D as lat", "-180 + (id * 104729 % 36000) / 100.0D as lon")
    centres = spark.createDataFrame([(0, 0.0, 179.9), (1, 84.9, 10.0), (2, -84.0, -179.0), (3, 21.0, 105.0)], "centre int, lat0 double, lon0 double")
    d = g.distance_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    for radius in (300_000, 2_000_000, 9_000_000):
        brute = {(r.centre, r.member) for r in points.crossJoin(centres).where(d <= radius).collect()}
        assert {(r.centre, r.member) for r in geoset.search_many(points, centres, radius).collect()} == brute
        for c in centres.collect():
            assert {r.member for r in geoset.search(points, c.lat0, c.lon0, radius).collect()} == {m for k, m in brute if k == c.centre}
    assert geoset.search(points, 0, 0, 0).count() == geoset.search(points, 0, 0, -5).count() == 0


def test_zset_fixture(spark):
    z = spark.createDataFrame([("z", "m1", 10.0, "A"), ("z", "m2", 5.0, "B"), ("z", "m3", 10.0, "C"), ("z", "m4", 7.0, "D")], "key string, member string, score double, value string")
    assert [r.value for r in zset.top(z, 2).orderBy("rn").collect()] == ["B", "D"]
    asked = spark.createDataFrame([("z", "m1"), ("z", "no")], "key string, member string")
    assert {r.member: r["rank"] for r in zset.rank(z, asked).collect()} == {"m1": 3, "no": -1}
    assert zset.rank_of(z, "z", "m1").first()[0] == 3
    assert zset.at(z, 4).first().value == "C" and zset.at(z, 5).count() == 0
    assert [r.value for r in zset.positions(z, 2, 9).orderBy("rn").collect()] == ["D", "A", "C"]
    assert zset.positions(z, 0, 2).count() == 0
    new = spark.createDataFrame([("z", "m1", 10.0, "X"), ("z", "m2", 6.0, "Y")], "key string, member string, score double, value string")
    assert {r.member: (r.score, r.value) for r in zset.add(z, new).collect()} == {"m1": (10.0, "A"), "m2": (6.0, "Y"), "m3": (10.0, "C"), "m4": (7.0, "D")}
    more = spark.createDataFrame([("z", "m2", 20.0), ("z", "n", 1.0)], "key string, member string, inc double")
    assert {r.member: (r.score, r.value) for r in zset.incr(z, more).collect()}["n"] == (1.0, "n")


def log(spark, rows):
    names = "seq ts_ms command key value ttl_ms not_exists".split()
    return spark.createDataFrame(rows, ", ".join(f for f in SCHEMA.split(", ") if f.split(" ")[0] in names))


ROWS = [
    (1, 0, "PUT", "a", "1", 100, False), (2, 50, "PUT", "a", "2", 0, True), (3, 100, "PUT", "a", "3", 0, True), (4, 100, "PUT", "b", "x", 100, False),
    (5, 150, "DELETE", "c", None, None, None), (6, 201, "PUT", "b", "y", 0, True), (7, 210, "DELETE", "a", None, None, None), (8, 220, "PUT", "a", "9", 50, True),
]


def test_replay(spark):
    got = {r.key: (r.value, r.expire_at) for r in replay_kv(log(spark, ROWS)).collect()}
    assert got == {"a": ("9", 270), "b": ("y", None)}
    state = replay_kv(log(spark, ROWS[:4]))
    assert {r.key: r.value for r in kv.get(state, spark.createDataFrame([("b",)], "key string"), 200).collect()} == {"b": "x"}
    assert {r.key: r.value for r in kv.get(state, spark.createDataFrame([("b",)], "key string"), 201).collect()} == {"b": None}
    cleared = [*ROWS, (9, 300, "CLEAR", None, None, None, None), (10, 301, "PUT", "n", "v", 0, False)]
    assert {r.key for r in replay_kv(log(spark, cleared)).collect()} == {"n"}


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((ROWS[:3], ROWS[3:6], ROWS[5:])):  # seq 6 comes twice
        log(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    replay = Replay(spark, f"file://{tmp_path}/state")
    for i in range(3):
        replay.apply(spark.read.parquet(f"{tmp_path}/in/{i}"), i)
    replay.apply(spark.read.parquet(f"{tmp_path}/in/2"), 2)  # delivered again
    assert {tuple(r) for r in replay.state().collect()} == {tuple(r) for r in replay_kv(log(spark, ROWS)).collect()}
    other = Replay(spark, f"file://{tmp_path}/other")
    commands = spark.readStream.schema(log(spark, ROWS).schema).parquet(f"{tmp_path}/in/*")
    other.start(commands, f"{tmp_path}/checkpoint").awaitTermination(60)
    assert {tuple(r) for r in other.state().collect()} == {tuple(r) for r in replay_kv(log(spark, ROWS)).collect()}
    assert [r.seq for r in replay.late(2).collect()] == [6]
    with pytest.raises(ValueError, match="another batch"):  # a new checkpoint on an old folder
        replay.apply(spark.read.parquet(f"{tmp_path}/in/0"), 2)
    with pytest.raises(ValueError, match="missing"):
        replay.apply(spark.read.parquet(f"{tmp_path}/in/0"), 7)
    assert Replay(spark, f"file://{tmp_path}/none").state() is None


def random_log(rng, n):
    """Commands of all structures, with repeats and CLEARs."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    verbs = "PUT PUT DELETE Z_ADD Z_ADD Z_INCR Z_INCR Z_RM Z_DEL H_SET H_SET H_RM H_DEL GEO_ADD GEO_ADD GEO_RM GEO_DEL BF_INIT BF_ADD BF_ADD BF_RM BF_RS GET".split()
    out = []
    for seq in range(n):
        c = rng.choice(verbs) if rng.random() > 0.02 else "CLEAR"
        row = {"seq": seq, "ts_ms": 10 * seq, "command": c, "key": rng.choice("ab"), "value": rng.choice("uvw"), "ttl_ms": rng.choice([0, 0, 35]), "not_exists": rng.random() < 0.6, "z_member": rng.choice("mn"), "z_score": float(rng.randrange(3)),
               "h_field": rng.choice("fg"), "geo_member": rng.choice("pq"), "geo_lat": rng.choice([1.0, 2.0, 89.0]), "geo_lon": float(rng.randrange(5)), "bf_n": rng.choice([0, 20]), "bf_p": 0.1}
        out.append(tuple(row.get(x) for x in names))
    return out


def walked(rows):
    """The state of all structures after commands, one after another."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    s = {"kv": {}, "zset": {}, "hash": {}, "geo": {}, "bloom": {}}
    for r in (dict(zip(names, x, strict=True)) for x in rows):
        c, k = r["command"], r["key"]
        if c == "CLEAR":
            s = {kind: {} for kind in s}
        elif c == "PUT":
            held = s["kv"].get(k)
            if not (r["not_exists"] and held and (held[1] is None or r["ts_ms"] < held[1])):
                s["kv"][k] = (r["value"], r["ts_ms"] + r["ttl_ms"] if r["ttl_ms"] else None)
        elif c == "DELETE":
            s["kv"].pop(k, None)
        elif c == "Z_ADD":
            if s["zset"].get((k, r["z_member"]), (None,))[0] != r["z_score"]:
                s["zset"][k, r["z_member"]] = (r["z_score"], r["value"])
        elif c == "Z_INCR":
            held = s["zset"].get((k, r["z_member"]), (0.0, r["z_member"]))
            s["zset"][k, r["z_member"]] = (held[0] + r["z_score"], held[1])
        elif c == "H_SET":
            s["hash"][k, r["h_field"]] = r["value"]
        elif c == "GEO_ADD" and r["geo_lat"] < 85:
            s["geo"][k, r["geo_member"]] = (r["geo_lat"], r["geo_lon"])
        elif c in ("Z_RM", "H_RM", "GEO_RM"):
            s[{"Z": "zset", "H": "hash", "G": "geo"}[c[0]]].pop((k, r[{"Z": "z_member", "H": "h_field", "G": "geo_member"}[c[0]]]), None)
        elif c in ("Z_DEL", "H_DEL", "GEO_DEL"):
            kind = {"Z": "zset", "H": "hash", "G": "geo"}[c[0]]
            s[kind] = {x: v for x, v in s[kind].items() if x[0] != k}
        elif c == "BF_INIT" and r["bf_n"]:
            s["bloom"][k] = set()
        elif c == "BF_ADD" and k in s["bloom"]:
            s["bloom"][k].add(r["value"])
        elif c == "BF_RM":
            s["bloom"].pop(k, None)
        elif c == "BF_RS" and k in s["bloom"]:
            s["bloom"][k] = set()
    return s


def states(frames):
    """The rows of replayed frames, as walked() has them."""
    kv_, z, h, p = (frames[k].collect() for k in ("kv", "zset", "hash", "geo"))
    return {"kv": {r.key: (r.value, r.expire_at) for r in kv_}, "zset": {(r.key, r.member): (r.score, r.value) for r in z}, "hash": {(r.key, r.field): r.value for r in h}, "geo": {(r.key, r.member): (r.lat, r.lon) for r in p}}


FOLDS = {"kv": replay_kv, "zset": replay_zset, "hash": replay_hash, "geo": replay_geo}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_of_all(spark, tmp_path, seed):
    """Replay of random logs, at once and as a stream, against a walk through the commands."""
    rows = random_log(random.Random(seed), 90)
    expected = walked(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert states({k: f(df.union(df.limit(5))) for k, f in FOLDS.items()}) == {k: expected[k] for k in FOLDS}
    defs, bits = replay_bloom(df)
    again = bloom.init(spark.createDataFrame([(k, 20, 0.1) for k in expected["bloom"]], "key string, n int, p double"))
    values = spark.createDataFrame([(k, v) for k, vs in expected["bloom"].items() for v in vs], "key string, value string")
    assert sorted(map(tuple, defs.collect())) == sorted(map(tuple, again.collect())) and sorted(map(tuple, bits.collect())) == sorted(map(tuple, bloom.add(again, None, values).collect()))
    streams = {k: Replay(spark, f"file://{tmp_path}/{k}", k, buckets=3) for k in FOLDS}
    for version, a in enumerate(range(0, 90, 45)):
        for stream in streams.values():
            stream.apply(spark.createDataFrame(rows[max(0, a - 3) : a + 45], SCHEMA), version)  # three of each batch are repeats
    assert states({k: s.state() for k, s in streams.items()}) == {k: expected[k] for k in FOLDS}
    assert all(f(df.where("false")).count() == 0 for f in FOLDS.values())


def test_batches(spark):
    """Repeated rows of a batch, null keys and empty tables."""
    new = spark.createDataFrame([("a", "x", 1.0, "1", 5), ("a", "x", 2.0, "2", 6), ("a", "x", 2.0, "3", 7), (None, "x", 1.0, "n", 8), ("a", None, 1.0, "n", 9)], "key string, member string, score double, value string, seq int")
    z = spark.createDataFrame([("a", "x", 2.0, "0")], "key string, member string, score double, value string")
    assert [tuple(r) for r in zset.add(z, new).collect()] == [("a", "x", 2.0, "2")]
    assert [tuple(r) for r in zset.add(z, new.where("seq > 5")).collect()] == [("a", "x", 2.0, "0")]
    assert [tuple(r) for r in zset.add(z.where("false"), new.drop("seq").where("score = 1")).collect()] == [("a", "x", 1.0, "1")]
    sets = new.selectExpr("key", "member as field", "value", "seq")
    assert [tuple(r) for r in fields.set_(sets.drop("seq").where("false"), sets).collect()] == [("a", "x", "3")]
    assert fields.all_json(fields.set_(sets.drop("seq").where("false"), sets)).first().json == '{"x":"3"}'
    points = new.selectExpr("key", "member", "score as lat", "cast(seq as double) as lon", "seq")
    none = points.drop("seq").withColumn("geohash", F.lit(1).cast("bigint")).where("false")
    assert [(r.lat, r.lon) for r in geoset.add(none, points).collect()] == [(2.0, 7.0)]
    pairs = spark.createDataFrame([("a", "1", None, 1)], "key string, value string, expire_at bigint, seq int")
    asked = spark.createDataFrame([("b", 1), ("b", 2), ("a", 3), (None, 4), ("a", 5)], "key string, seq int")
    assert sorted((r.seq, r.flag) for r in kv.put_if_absent(pairs, asked, 0).collect()) == [(1, "OK"), (2, "FAIL"), (3, "FAIL"), (4, "FAIL"), (5, "FAIL")]
    assert sorted((r.seq, r.flag) for r in kv.delete_flags(pairs, asked, 0).collect()) == [(1, 0), (2, 0), (3, 1), (5, 0)] or sorted((r.seq, r.flag) for r in kv.delete_flags(pairs, asked, 0).collect()) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 0)]
    assert kv.put(pairs.where("false"), pairs.where("false")).count() == kv.put_if_absent(pairs, asked.where("false"), 0).count() == 0
    assert zset.rank_of(z.where("false"), "a", "x").first()[0] == -1
    cleared = keyspace.clear({"kv": pairs, "zset": z})
    assert all(df.count() == 0 for df in cleared.values())


def test_hot_keys(spark):
    """One key with all rows: ranked and evicted in parts, of which none has most, with ties of score."""
    z = spark.range(20_000).selectExpr("'hot' as key", "concat('m', id) as member", "floor(id * 7919 % 20000 / 3) as score", "'v' as value").withColumn("score", F.col("score").cast("double"))
    plain = {(r.member, r.rn) for r in zset.ranked(z).collect()}
    assert {(r.member, r.rn) for r in zset.all_ranked(z).collect()} == plain
    sizes = [r["count"] for r in batches.parted(z, ["key"], F.col("score")).groupBy("part").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 1000
    cold = spark.range(5000).selectExpr("concat('k', id) as key", "cast(1 + id % 3 as bigint) as bytes", "cast(if(id < 10, 2, 1) as bigint) as freq", "id * 31 % 5000 as seq")
    rows, freed, gone = sorted(cold.collect(), key=lambda r: (r.freq, r.seq, r.key)), 0, set()
    over = sum(r.bytes for r in rows) - 4000
    for r in rows:
        if freed >= over:
            break
        gone.add(r.key)
        freed += r.bytes
    assert {r.key for r in keyspace.evict(cold, 4000).collect()} == gone


def test_ageing(spark):
    """Counts that are halved over many epochs, against halving step by step."""
    rng = random.Random(4)
    ops = [(f"k{rng.randrange(4)}" if op < 700 or op > 2600 else "z", op) for op in range(1, 3001)]
    got = {r.cell: r.cnt for r in keyspace.aged(spark.createDataFrame(ops, "key string, op bigint"), 10).collect()}
    keys = column(spark, sorted({k for k, _ in ops})).select("x", h.sketch_cells(h.string_hash(F.col("x"))).alias("c")).collect()
    cells, counts = {r.x: list(r.c) for r in keys}, {}
    for key, op in ops:
        for c in cells[key]:
            counts[c] = counts.get(c, 0) + 1
        if op % 10 == 0:
            counts = {c: n >> 1 for c, n in counts.items()}
    assert got == counts


def test_segment_count():
    assert [keyspace.segment_count(c) for c in (1, 4, 5, 8, 33, 1000)] == [16, 16, 32, 32, 256, 256]


def test_zset_replay(spark):
    rows = [(1, "Z_ADD", "z", "m", 5.0, "v"), (2, "Z_INCR", "z", "m", 2.0, None), (3, "Z_ADD", "z", "m", 7.0, "w"), (4, "Z_INCR", "z", "n", 1.0, None), (5, "Z_RM", "z", "n", None, None), (6, "Z_INCR", "z", "o", 3.0, None)]
    df = spark.createDataFrame(rows, "seq bigint, command string, key string, z_member string, z_score double, value string")
    assert {r.member: (r.score, r.value) for r in replay_zset(df).collect()} == {"m": (7.0, "v"), "o": (3.0, "o")}


def test_codec(spark):
    lists = [["SET", "k|1", "v|", ""], ["GET", "ключ"], ["NOPE"]]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>").select("t", codec.request(F.col("t")).alias("text"))
    assert all(r.t == r.back for r in df.select("t", codec.tokens(F.col("text")).alias("back")).collect())
    assert [r.x for r in column(spark, ["2|3|GET", "x", ""]).select(codec.tokens(F.col("x")).alias("x")).collect()] == [None, None, None]
    assert column(spark, ['SET k "a b" c']).select(codec.cli_tokens(F.col("x"))).first()[0] == ["SET", "k", "a b", "c"]
    lines = ['SET k "a b" c', '"abc', 'a "b c', 'x"y z"w  " "', "", '""']
    words = [["SET", "k", "a b", "c"], ['"abc'], ["a", '"b', "c"], ['x"y z"w', " "], [], [""]]
    assert [r[0] for r in column(spark, lines).select(codec.cli_tokens(F.col("x"))).collect()] == words
    bad = [(1, "Z_ADD|k|v|0|false|0|0.0|1.5|m|||"), (2, "Z_ADD|k|v|0|false|0|0.0|1.5|m||1|2|f"), (3, "NOPE|k|v|0|false|0|0.0|1.5|m||1|2|f"), (4, "PUT|k|v|x|false|0|0.0|1.5|m||1|2|f"), (5, None)]
    assert {r.seq: r.command for r in codec.from_replicated(spark.createDataFrame(bad, "seq int, text string")).collect()} == {1: None, 2: "Z_ADD", 3: None, 4: None, 5: None}
    huge = ["2000000000|1|a", "1|2000000000|a", "1|-1|a", "-1|", "0|", "2|1|a|1|", None]
    assert [r[0] for r in column(spark, huge).select(codec.tokens(F.col("x"))).collect()] == [None, None, None, None, [], None, None]
    replies = [("GET", "42"), ("DELETE", "1"), ("H_GET", "42"), ("Z_RANK", "-1"), ("GET", None)]
    assert [r[0] for r in spark.createDataFrame(replies, "c string, v string").select(codec.reply(F.col("c"), F.col("v"))).collect()] == ["D|2|42", "I|1", "S|42", "I|-1", "N|"]


def test_text_commands(spark):
    texts = ["5|5|Z.ADD|1|k|3|1.5|1|m|1|v", "5|5|z.add|1|k|1|x|1|m|1|v", "2|3|SET|1|k", "3|3|set|1|k|1|v", "5|3|SET|1|k|1|v|1|1|2|50", "3|3|GET|1|k|1|x", "1|5|CLEAR", "4|7|BF.INIT|1|b|3|100|4|0.05", "x", None]
    rows = codec.commands(spark.createDataFrame(list(enumerate(texts)), "seq bigint, text string")).orderBy("seq").collect()
    assert rows[0].asDict().keys() == {f.split(" ")[0] for f in SCHEMA.split(", ")}
    assert [r.command for r in rows] == ["Z_ADD", None, None, "PUT", "PUT", None, "CLEAR", "BF_INIT", None, None]
    assert (rows[0].key, rows[0].z_score, rows[0].z_member, rows[0].value) == ("k", 1.5, "m", "v") and rows[1].key is None
    assert (rows[4].not_exists, rows[4].ttl_ms, rows[3].not_exists) == (True, 50, None) and (rows[7].bf_n, rows[7].bf_p) == (100, 0.05)


def test_binary_commands(spark):
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    full = {"seq": 1, "command": "GEO_ADD", "key": "ключ", "value": "v" * 70_000, "ttl_ms": 9, "not_exists": True, "geo_lat": 1.25, "geo_member": "m", "z_idx": -3}
    rows = [{n: full.get(n) for n in kinds}, {n: {"seq": 2, "command": "NOPE"}.get(n) for n in kinds}]
    frames = binary.encode(spark.createDataFrame(rows, SCHEMA)).collect()
    assert frames[1].frame is None
    whole = bytes(frames[0].frame)
    bad = [(1, None, whole), (2, None, whole[:-1]), (3, None, whole + b"x"), (4, None, b"N" + whole[1:]), (5, None, b""), (6, 7, None), (7, None, whole[:1] + b"\xee" + whole[2:])]
    back = {r.seq: r for r in binary.decode(spark.createDataFrame(bad, "seq bigint, ts_ms bigint, frame binary")).collect()}
    assert {n: back[1][n] for n in full} == full and back[1].h_field == ""
    assert [back[i].command for i in range(2, 8)] == [None] * 6 and back[6].ts_ms == 7


def test_evict_is_exact(spark):
    rows = [("a", 10, 1, 5), ("b", 20, 1, 3), ("c", 30, 2, 1), ("d", 40, 9, 9)]
    df = spark.createDataFrame(rows, "key string, bytes bigint, freq bigint, seq bigint")
    for budget, gone in ((100, set()), (95, {"b"}), (79, {"b", "a"}), (60, {"b", "a", "c"}), (0, {"a", "b", "c", "d"})):
        assert {r.key for r in keyspace.evict(df, budget).collect()} == gone
