"""The binary form of requests: frames to rows of the command schema and back, by Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.commands import SCHEMA

# The first byte of a frame, the codes of commands, and the fields after key and value in order.
MAGIC = 0x4D
CODES = {
    "GET": 0x02, "PUT": 0x03, "DELETE": 0x04, "LST_KEY": 0x05, "EXISTS": 0x06, "CLEAR": 0x07, "BF_INIT": 0x08, "BF_ADD": 0x09, "BF_EXISTS": 0x10, "BF_RM": 0x11, "BF_RS": 0x12,
    "Z_ADD": 0x13, "Z_POS": 0x14, "Z_RANGE": 0x15, "Z_RANK": 0x16, "Z_INCR": 0x17, "Z_RSCR": 0x18, "Z_RM": 0x19, "Z_DEL": 0x20, "Z_SCR": 0x21, "Z_TOP": 0x29,
    "GEO_ADD": 0x22, "GEO_SEARCH": 0x23, "GEO_DIST": 0x24, "GEO_DEL": 0x25, "GEO_RM": 0x26, "GEO_GET": 0x27, "GEO_NB": 0x28, "GEO_EXISTS": 0x30, "GEO_ENCODE": 0x31,
    "H_SET": 0x32, "H_GET": 0x33, "H_ALL": 0x34, "H_RM": 0x35, "H_DEL": 0x36,
}
FIELDS = "not_exists:h ttl_ms:i bf_n:i bf_p:d z_score:d z_min:d z_max:d z_idx:i z_start:i z_stop:i z_member:s geo_member:s geo_lat:d geo_lon:d geo_member2:s geo_radius:d limit_n:i h_field:s".split()

_COMMANDS = {code: name for name, code in CODES.items()}
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _frame(command: dict) -> bytes | None:
    if command["command"] not in CODES:
        return None
    key, value = ((command[n] or "").encode() for n in ("key", "value"))
    out = [struct.pack(">BBhi", MAGIC, CODES[command["command"]], len(key), len(value)), key, value]
    for name, kind in (f.split(":") for f in FIELDS):
        x = command[name]
        if kind == "s":
            raw = (x or "").encode()
            out.append(struct.pack(">H", len(raw)) + raw)
        else:
            out.append(struct.pack(">" + kind, x or 0))
    return b"".join(out)


def _command(frame: bytes | None) -> dict | None:
    """The fields of a frame; None if it is cut short, longer, or of no command. Fields that a request hasn't are 0 or empty, as they were sent."""
    try:
        magic, code, n_key, n_value = struct.unpack_from(">BBhi", frame or b"")
        if magic != MAGIC or code not in _COMMANDS or min(n_key, n_value) < 0 or 8 + n_key + n_value > len(frame):
            return None
        at = 8 + n_key + n_value
        out = {"command": _COMMANDS[code], "key": frame[8 : 8 + n_key].decode("utf-8", "replace"), "value": frame[8 + n_key : at].decode("utf-8", "replace")}
        for name, kind in (f.split(":") for f in FIELDS):
            if kind == "s":
                (n,) = struct.unpack_from(">H", frame, at)
                raw = frame[at + 2 : at + 2 + n]
                if len(raw) < n:
                    return None
                out[name], at = raw.decode("utf-8", "replace"), at + 2 + n
            else:
                (out[name],) = struct.unpack_from(">" + kind, frame, at)
                at += struct.calcsize(">" + kind)
        return out | {"not_exists": out["not_exists"] == 1} if at == len(frame) else None
    except struct.error:
        return None


def encode(commands: DataFrame) -> DataFrame:
    """(seq, frame) of rows of the command schema; null for an unknown command. Nulls are sent as 0 or an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [_frame(x) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(frames, pa.binary())], names=["seq", "frame"])

    return commands.select(*[f.split(" ")[0] for f in SCHEMA.split(", ")]).mapInArrow(rows, "seq bigint, frame binary")


def decode(frames: DataFrame) -> DataFrame:
    """Rows of the command schema of frames (seq, ts_ms, frame: binary); all but seq and ts_ms are null where the frame isn't sound."""
    kinds = [f.split(" ") for f in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_command(x) or {} for x in batch.column("frame").to_pylist()]
            columns = [batch.column(n) if n in ("seq", "ts_ms") else pa.array([x.get(n) for x in made], _KINDS[k]) for n, k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kinds])

    return frames.selectExpr("cast(seq as bigint) as seq", "cast(ts_ms as bigint) as ts_ms", "frame").mapInArrow(rows, SCHEMA)
