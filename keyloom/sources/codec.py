"""The length-prefixed text form of requests and replies, as column expressions. A null text has no tokens and no command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.commands import SCHEMA

# Text verbs of the commands.
VERBS = {
    "SET": "PUT", "GET": "GET", "DEL": "DELETE", "EXISTS": "EXISTS", "CLEAR": "CLEAR", "KEYS": "LST_KEY",
    "BF.INIT": "BF_INIT", "BF.ADD": "BF_ADD", "BF.EXISTS": "BF_EXISTS", "BF.RM": "BF_RM", "BF.RS": "BF_RS",
    "Z.ADD": "Z_ADD", "Z.INCR": "Z_INCR", "Z.SCR": "Z_SCR", "Z.RANK": "Z_RANK", "Z.POS": "Z_POS", "Z.RANGE": "Z_RANGE", "Z.RSCR": "Z_RSCR", "Z.TOP": "Z_TOP", "Z.RM": "Z_RM", "Z.DEL": "Z_DEL",
    "GEO.ADD": "GEO_ADD", "GEO.SEARCH": "GEO_SEARCH", "GEO.DIST": "GEO_DIST", "GEO.GET": "GEO_GET", "GEO.NB": "GEO_NB", "GEO.EXISTS": "GEO_EXISTS", "GEO.ENCODE": "GEO_ENCODE", "GEO.RM": "GEO_RM", "GEO.DEL": "GEO_DEL",
    "H.SET": "H_SET", "H.GET": "H_GET", "H.ALL": "H_ALL", "H.RM": "H_RM", "H.DEL": "H_DEL",
}


def request(tokens: Column) -> Column:
    """The text of an array of tokens: their number, then the length and text of each, by bars."""
    return F.concat_ws("|", F.size(tokens).cast("string"), F.array_join(F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit("|"), t)), "|"))


def tokens(text: Column) -> Column:
    """The tokens of a request. They may hold bars, so lengths are followed; null where the text breaks off.

    A token takes two characters or more, so a number of tokens beyond half the text's length breaks off too.
    """
    head = F.substring_index(text, "|", 1)
    n = head.try_cast("int")
    some = F.when((n > 0) & (n <= F.length(text)), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    start = F.struct((F.length(head) + 2).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        bar = F.call_function("locate", F.lit("|"), text, a["at"])
        length = F.when(bar > 0, F.substr(text, a["at"], bar - a["at"]).try_cast("int"))
        token = F.when(length >= 0, F.substr(text, bar + 1, length))
        return F.struct((bar + 2 + F.coalesce(length, F.lit(0))).alias("at"), F.concat(a["out"], F.array(F.when(F.length(token) == length, token))).alias("out"))

    out = F.aggregate(some, start, step)["out"]
    return F.when((F.size(out) == n) & ~F.exists(out, lambda t: t.isNull()), out)


def cli_tokens(line: Column) -> Column:
    """The words of a typed line. A quoted stretch belongs to its word, white space included; a word in quotes loses them.

    A quote that none follows is a character like others.
    """
    word = r'((?:"[^"]*"|[^"\s]|"(?=[^"]*$))+)'
    quoted = lambda t: (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    return F.transform(F.regexp_extract_all(line, F.lit(word), F.lit(1)), lambda t: F.when(quoted(t), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))


# Tokens of a request (least and most; None: any) and what those after the verb are.
ARGUMENTS = {
    "PUT": (3, None, "key value not_exists ttl_ms"), "GET": (2, 2, "key"), "DELETE": (2, 2, "key"), "EXISTS": (2, 2, "key"), "CLEAR": (1, None, ""), "LST_KEY": (1, None, ""),
    "BF_INIT": (4, None, "key bf_n bf_p"), "BF_ADD": (3, 3, "key value"), "BF_EXISTS": (2, None, "key value"), "BF_RM": (2, 2, "key"), "BF_RS": (2, 2, "key"),
    "Z_ADD": (5, 5, "key z_score z_member value"), "Z_INCR": (4, 4, "key z_member z_score"), "Z_SCR": (3, 3, "key z_member"), "Z_RANK": (3, 3, "key z_member"), "Z_POS": (3, 3, "key z_idx"),
    "Z_RANGE": (4, 4, "key z_start z_stop"), "Z_RSCR": (4, 4, "key z_min z_max"), "Z_TOP": (3, 3, "key z_start"), "Z_RM": (3, 3, "key z_member"), "Z_DEL": (2, 2, "key"),
    "GEO_ADD": (5, 5, "key geo_member geo_lat geo_lon"), "GEO_SEARCH": (5, None, "key geo_lat geo_lon geo_radius limit_n"), "GEO_DIST": (4, 4, "key geo_member geo_member2"), "GEO_GET": (3, 3, "key geo_member"),
    "GEO_NB": (3, 3, "key geo_member"), "GEO_EXISTS": (3, 3, "key geo_member"), "GEO_ENCODE": (3, 3, "key geo_member"), "GEO_RM": (3, 3, "key geo_member"), "GEO_DEL": (2, 2, "key"),
    "H_SET": (4, 4, "key h_field value"), "H_GET": (3, 3, "key h_field"), "H_ALL": (2, 2, "key"), "H_RM": (3, 3, "key h_field"), "H_DEL": (2, 2, "key"),
}

# The form of each command's reply; all others are whole numbers.
TEXTS = "PUT BF_ADD BF_INIT Z_POS Z_ADD Z_SCR GEO_ADD GEO_ENCODE H_GET H_SET".split()
SIZED = "GET LST_KEY Z_RANGE Z_TOP Z_RSCR GEO_SEARCH GEO_DIST GEO_GET GEO_NB H_ALL".split()


def _tokenised(requests: DataFrame, column: str) -> DataFrame:
    """requests with __t, the tokens. They are made behind a generator of one row, else each use of them would make them anew."""
    return requests.select("*", F.explode(F.array(F.col(column))).alias("__x")).select(*requests.columns, F.explode(F.array(tokens(F.col("__x")))).alias("__t"))


def parse(requests: DataFrame, column: str = "text") -> DataFrame:
    """requests with command (null if unknown), key and args (array)."""
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    return _tokenised(requests, column).withColumns({"command": F.try_element_at(verbs, F.upper(F.get("__t", F.lit(0)))), "key": F.get("__t", F.lit(1)), "args": F.slice("__t", 3, F.greatest(F.size("__t") - 2, F.lit(0)))}).drop("__t")


def commands(requests: DataFrame, column: str = "text") -> DataFrame:
    """requests as rows of the command schema; the columns seq and ts_ms of requests are kept, null if there are none.

    The command is null, and so are its arguments, for an unknown verb, a wrong number of tokens, or an argument that isn't of its type.
    """
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    forms = [(F.lit(c), F.struct(F.lit(least).alias("least"), F.lit(most if most is not None else 1 << 30).alias("most"), F.array(*map(F.lit, names.split())).cast("array<string>").alias("names"))) for c, (least, most, names) in ARGUMENTS.items()]
    rows = _tokenised(requests, column).withColumn("__c", F.try_element_at(verbs, F.upper(F.get("__t", F.lit(0)))))
    rows = rows.withColumn("__f", F.explode(F.array(F.try_element_at(F.create_map(*[x for pair in forms for x in pair]), F.col("__c")))))
    found: dict[str, Column] = {}
    sound = F.size("__t").between(F.col("__f.least"), F.col("__f.most"))
    for name in dict.fromkeys(n for _, _, names in ARGUMENTS.values() for n in names.split()):
        at = F.array_position("__f.names", F.lit(name)).cast("int")
        token = F.when(at > 0, F.get("__t", at))
        found[name] = token if kinds[name] == "string" else token.try_cast("int") == 1 if name == "not_exists" else token.try_cast(kinds[name])
        if kinds[name] != "string":
            sound &= token.isNull() | found[name].isNotNull()
    rows = rows.withColumn("__ok", F.coalesce(sound, F.lit(False)))
    out = {"command": F.col("__c")} | found
    kept = [F.col(c).cast("bigint").alias(c) if c in requests.columns else F.lit(None).cast("bigint").alias(c) for c in ("seq", "ts_ms")]
    return rows.select(*kept, *[F.when(F.col("__ok"), out[c]).cast(k).alias(c) if c in out else F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in ("seq", "ts_ms")])


def reply(command: Column, value: Column) -> Column:
    """The text of a command's reply: N| for none, else S|, D| with the length, or I|, as the command has it."""
    sized = F.concat(F.lit("D|"), F.length(value).cast("string"), F.lit("|"), value)
    return F.when(value.isNull(), F.lit("N|")).when(command.isin(TEXTS), F.concat(F.lit("S|"), value)).when(command.isin(SIZED), sized).otherwise(F.concat(F.lit("I|"), value))


# The fields of a replicated write, in order.
REPLICATED = "command key value ttl_ms not_exists bf_n bf_p z_score z_member geo_member geo_lat geo_lon h_field".split()


def replicated(commands_: DataFrame) -> DataFrame:
    """(seq, text) of rows of the command schema: the fields by bars, decimals with six places, nulls as 0, false or nothing. Texts that hold bars can't be told apart."""
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))

    def field(name: str) -> Column:
        kind = kinds[name]
        if kind == "double":
            return F.format_string("%.6f", F.coalesce(F.col(name), F.lit(0.0)))
        return F.coalesce(F.col(name).cast("string"), F.lit({"string": "", "boolean": "false"}.get(kind, "0")))

    return commands_.select("seq", F.concat_ws("|", *map(field, REPLICATED)).alias("text"))


def from_replicated(rows: DataFrame) -> DataFrame:
    """Rows of the command schema of (seq, ts_ms, text); the command is null where fields are missing, too many or of another type."""
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    parts = rows.select(*[F.col(c).cast("bigint").alias(c) if c in rows.columns else F.lit(None).cast("bigint").alias(c) for c in ("seq", "ts_ms")], F.split("text", r"\|", -1).alias("p"))
    made = {n: F.get("p", F.lit(i)).try_cast(kinds[n]) for i, n in enumerate(REPLICATED)}
    good = F.size("p") == len(REPLICATED)
    for value in made.values():
        good &= value.isNotNull()
    good = F.coalesce(good & made["command"].isin(list(VERBS.values())), F.lit(False))
    return parts.select("seq", "ts_ms", *[F.when(good, made[c]).alias(c) if c in made else F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in ("seq", "ts_ms")])
