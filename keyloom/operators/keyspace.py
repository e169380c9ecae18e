"""What spans all structures: the list of keys, sizes, segments, access counts and eviction.

Null keys count as keys of sizes and lists, and have no cells. Empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import segment_id, sketch_cells, string_hash
from .batches import before, parted
from .kv import size_bytes

# Prefixes of listed keys, and the estimated bytes of a node.
PREFIXES = {"kv": "", "bloom": "bf_", "zset": "zs_", "geo": "geo_", "hash": "hs_"}
NODE_BYTES, POINT_BYTES = 48 + 128, 48 + 16 + 128
AGEING_OPS = 100_000
#: Halvings that are taken at once.
BLOCK = 32


def keys(structures: dict[str, DataFrame]) -> DataFrame:
    """(kind, name) of all keys, expired pairs included; names have the prefix of their kind."""
    parts = [df.select(F.lit(kind).alias("kind"), F.concat(F.lit(PREFIXES[kind]), "key").alias("name")).distinct() for kind, df in structures.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def memory(structures: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, bytes), from the state and not from running totals."""
    size = {
        "kv": lambda: F.sum(size_bytes(F.col("key"), F.col("value"), F.col("expire_at"))),
        "bloom": lambda: F.max(F.ceil(F.col("m") / 64) * 8 + F.octet_length("key")),
        "zset": lambda: F.sum(F.octet_length("member") + F.octet_length("value") + NODE_BYTES),
        "geo": lambda: F.sum(F.octet_length("member") + POINT_BYTES),
        "hash": lambda: F.sum(F.octet_length("field") + F.octet_length("value")),
    }
    parts = [df.groupBy("key").agg(size[kind]().cast("long").alias("bytes")).select(F.lit(kind).alias("kind"), "key", "bytes") for kind, df in structures.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def segments(kv: DataFrame, n: int = 16) -> DataFrame:
    """(segment, n_keys, bytes)."""
    sized = kv.select(segment_id(string_hash(F.col("key")), n).alias("segment"), size_bytes(F.col("key"), F.col("value"), F.col("expire_at")).alias("b"))
    return sized.groupBy("segment").agg(F.count("*").alias("n_keys"), F.sum("b").alias("bytes"))


def segment_count(cores: int) -> int:
    """The segments of a store on so many cores: a power of two, four times the cores or more, from 16 to 256."""
    return min(256, max(16, 1 << max(0, 4 * cores - 1).bit_length()))


def clear(structures: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All structures without any key."""
    return {kind: df.where("false") for kind, df in structures.items()}


def evicted(structures: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The structures without the keys (kind, key) that evict() chose."""
    return {kind: df.join(gone.where(F.col("kind") == kind).select("key"), "key", "left_anti") for kind, df in structures.items()}


def admitted(sized: DataFrame, candidates: DataFrame, budget: int) -> DataFrame:
    """candidates (key, bytes, freq, seq) with flag: 1 if the key stays when all of them and the stored keys are held within a budget.

    A candidate is admitted if it is used oftener than what has to go for it; of equal frequencies the later used stays.
    """
    both = sized.select("key", "bytes", "freq", "seq").unionByName(candidates.select("key", "bytes", "freq", "seq"))
    out = evict(both, budget).select("key", F.lit(0).alias("flag"))
    return candidates.join(out, "key", "left").withColumn("flag", F.coalesce("flag", F.lit(1)))


def sketch(accesses: DataFrame) -> DataFrame:
    """(cell, cnt) of accesses (key). Keys are counted before they are hashed."""
    counted = accesses.groupBy("key").agg(F.count("*").alias("n"))
    return counted.select(F.explode(sketch_cells(string_hash(F.col("key")))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("cnt"))


def aged(accesses: DataFrame, every: int = AGEING_OPS) -> DataFrame:
    """(cell, cnt) of accesses (key, op: 1, 2, ...) when all cells are halved after every so many operations."""
    epochs = accesses.groupBy("key", F.floor((F.col("op") - 1) / every).alias("epoch")).agg(F.count("*").alias("n"))
    total = F.lit(accesses.agg(F.coalesce(F.floor(F.max("op") / every), F.lit(0).cast("long")).alias("n")).first()["n"])
    cells = epochs.select("epoch", F.explode(sketch_cells(string_hash(F.col("key")))).alias("cell"), "n").groupBy("cell", "epoch").agg(F.sum("n").alias("n"))
    # halving rounds down at each step, which equals rounding down once: a block of epochs is one sum of shifted counts
    block = F.floor((total - F.col("epoch") - 1) / BLOCK)  # from the last halving back; -1 is what comes after it
    weight = F.expr(f"cast(power(2, {BLOCK} - 1 - pmod(__total - epoch - 1, {BLOCK})) as decimal(19, 0))")
    sums = cells.withColumn("__total", total).withColumn("block", block)
    sums = sums.groupBy("cell", "block").agg(F.sum(F.col("n") * F.when(F.col("block") < 0, F.lit(1).cast("decimal(19, 0)")).otherwise(weight)).cast("decimal(38, 0)").alias("n"))
    blocks = sums.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("block", "n")), asc=False).alias("b"))  # a 32nd of the epochs at most
    start = F.struct(F.lit(None).cast("bigint").alias("block"), F.lit(0).cast("decimal(38, 0)").alias("a"))

    def step(a, x):
        gap = F.coalesce(a["block"] - x["block"] - 1, F.lit(0))  # blocks without a count
        idle = F.when(gap > 1, F.lit(0).cast("decimal(38, 0)")).when(gap == 1, _halved(a["a"])).otherwise(a["a"])
        return F.struct(x["block"].alias("block"), F.when(x["block"] < 0, idle + x["n"]).otherwise(_halved(idle + x["n"])).cast("decimal(38, 0)").alias("a"))

    last = F.aggregate("b", start, step)
    rest = F.coalesce(last["block"], F.lit(-1).cast("bigint"))  # blocks that are left
    return blocks.select("cell", F.when(rest > 1, 0).when(rest == 1, _halved(last["a"])).otherwise(last["a"]).cast("long").alias("cnt"))


def _halved(a):
    """A count after BLOCK halvings."""
    whole = F.lit(1 << BLOCK).cast("decimal(19, 0)")
    return ((a - a % whole) / whole).cast("decimal(38, 0)")


def frequency(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, freq): the lesser of the two cells of each key."""
    probe = asked.select("key").distinct().withColumn("cell", F.explode(sketch_cells(string_hash(F.col("key")))))
    return probe.join(cells, "cell", "left").groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0).cast("long"))).alias("freq"))


def evict(sized: DataFrame, budget: int) -> DataFrame:
    """Keys (key, bytes, freq, seq) that go so that the rest is within a budget: the least often, then least lately used first.

    Freed bytes add up in order of (freq, seq, key). Sums by frequency bound how far the order must be
    followed, so only one frequency, in which the budget is met, is ranked, and not all keys.
    """
    over = sized.agg((F.sum("bytes") - budget).alias("over"))
    by_freq = sized.groupBy("freq").agg(F.sum("bytes").alias("b"))
    ahead = by_freq.withColumn("ahead", F.sum("b").over(W.orderBy("freq")) - F.col("b"))  # a row a frequency
    marked = sized.join(ahead, "freq").crossJoin(F.broadcast(over)).where("ahead < over")  # one row
    whole = marked.where("ahead + b <= over").select("key", "bytes", "freq")
    edge = parted(marked.where("ahead + b > over"), ["freq"], F.col("seq"))  # one frequency may have nearly all keys
    run = F.sum("bytes").over(W.partitionBy("freq", "part").orderBy("seq", "key").rowsBetween(W.unboundedPreceding, -1))
    edge = edge.withColumn("run", F.coalesce(run, F.lit(0))).join(before(edge, ["freq"], F.col("bytes")), ["freq", "part"])
    part = edge.where("ahead + before + run < over").select("key", "bytes", "freq")
    return whole.unionByName(part)
