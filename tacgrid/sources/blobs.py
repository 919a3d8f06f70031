"""Packed snapshots, tokens and flight paths of older libraries, read into nested columns and written from them.

Fixed values of the formats, little-endian. Snapshot: 10 slots. Version 3 has a byte 3, then slots of 18 bytes: int16 x y
z, flags (1 alive, 2 CT, 4 present), health, place, node, yaw (255 for 360 degrees), armour, uint16 money, flash (tenths),
primary, secondary (255 none), utility bits. Version 2 has no byte before and float32 x y z, then flags to yaw and a
spare byte; version 1 the same without yaw and spare. Path: a byte 2, then uint16 hundredths and int16 x y z for each
sample; version 1 has float32 t x y z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, NONE, PRESENT, CT, ALIVE = 10, 255, 4, 2, 1
V3 = np.dtype([("x", "<i2"), ("y", "<i2"), ("z", "<i2"), ("flags", "u1"), ("health", "u1"), ("place", "u1"), ("node", "u1"), ("yaw", "u1"), ("armor", "u1"), ("money", "<u2"), ("flash", "u1"), ("primary", "u1"), ("secondary", "u1"), ("util", "u1")])
V2 = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("flags", "u1"), ("health", "u1"), ("place", "u1"), ("node", "u1"), ("yaw", "u1"), ("spare", "u1")])
V1 = np.dtype(V2.descr[:7])
PATH = np.dtype([("t", "<u2"), ("x", "<i2"), ("y", "<i2"), ("z", "<i2")])

PLAYER = "slot:int,side:string,alive:boolean,x:double,y:double,z:double,health:int,place:int,node:int,yaw:double,armor:int,money:int,flash_s:double,primary:int,secondary:int,util:int"
PLAYERS = f"array<struct<{PLAYER}>>"
FIELDS = [f.split(":")[0] for f in PLAYER.split(",")]
POINTS = "array<struct<t:double,x:double,y:double,z:double>>"


def unpack_snapshot(blob: bytes | None) -> list[tuple] | None:
    """Present players by slot; fields that a version lacks are null. None for null or a length of no version."""
    if blob is None:
        return None
    kinds = {SLOTS * V2.itemsize: V2, SLOTS * V1.itemsize: V1}
    if len(blob) == 1 + SLOTS * V3.itemsize and blob[0] == 3:
        rows = np.frombuffer(blob, V3, offset=1)
    elif len(blob) in kinds:
        rows = np.frombuffer(blob, kinds[len(blob)])
    else:
        return None
    has = set(rows.dtype.names)
    known = lambda v: None if v == NONE else int(v)
    out = []
    for k, r in enumerate(rows):
        if r["flags"] & PRESENT:
            new = (int(r["armor"]), int(r["money"]), int(r["flash"]) / 10, known(r["primary"]), known(r["secondary"]), int(r["util"])) if "armor" in has else (None,) * 6
            yaw = float(r["yaw"]) / 255 * 360 if "yaw" in has else None
            out.append((k, "CT" if r["flags"] & CT else "T", bool(r["flags"] & ALIVE), float(r["x"]), float(r["y"]), float(r["z"]), int(r["health"]), known(r["place"]), known(r["node"]), yaw, *new))
    return out


def pack_snapshot(players: list[dict] | None) -> bytes | None:
    """Version 3 of players (FIELDS); values saturate, coordinates go to the nearest whole, halves to even."""
    if players is None:
        return None
    rows = np.zeros(SLOTS, V3)
    for name in ("place", "node", "primary", "secondary"):
        rows[name] = NONE
    for p in players:
        r = rows[p["slot"]]
        for c in "xyz":
            r[c] = int(np.clip(np.round(p[c]), -32768, 32767))
        r["flags"] = PRESENT | (CT if p["side"] == "CT" else 0) | (ALIVE if p["alive"] else 0)
        r["yaw"] = int(np.round((p.get("yaw") or 0.0) % 360 / 360 * 255))
        r["money"] = int(np.clip(p.get("money") or 0, 0, 65535))
        r["flash"] = int(np.clip((p.get("flash_s") or 0) * 10, 0, 255))
        for c in ("health", "armor", "util"):
            r[c] = int(np.clip(p.get(c) or 0, 0, 255))
        for c in ("place", "node", "primary", "secondary"):
            r[c] = NONE if p.get(c) is None else int(p[c])
    return bytes([3]) + rows.tobytes()


def unpack_path(blob: bytes | None) -> list[tuple] | None:
    """(t, x, y, z) of each sample; values of version 1 are rounded to tenths."""
    if not blob:
        return None
    if blob[0] == 2 and (len(blob) - 1) % PATH.itemsize == 0:
        return [(int(r["t"]) / 100, float(r["x"]), float(r["y"]), float(r["z"])) for r in np.frombuffer(blob, PATH, offset=1)]
    if len(blob) % 16:
        return None
    return [tuple(round(float(v), 1) for v in r) for r in np.frombuffer(blob, "<f4").reshape(-1, 4)]


def pack_path(points: list[dict] | None) -> bytes | None:
    if points is None:
        return None
    rows = np.zeros(len(points), PATH)
    for r, p in zip(rows, points, strict=True):
        r["t"] = int(np.clip(np.round(p["t"] * 100), 0, 65535))
        for c in "xyz":
            r[c] = int(np.clip(np.round(p[c]), -32768, 32767))
    return b"\x02" + rows.tobytes()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, where each value begins, and how long it is (-1: null)."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return data, offsets[:-1], np.where(known, np.diff(offsets), -1)


def _cut(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of several values, one after another."""
    before = np.cumsum(length) - length
    return data[np.repeat(begin - before, length) + np.arange(int(length.sum()))]


def _lists(values: pa.StructArray, count: np.ndarray, known: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~known, False)), values)


def unpack_snapshots(column: pa.Array) -> pa.Array:
    """unpack_snapshot of a whole column: each version's blobs are one structured array."""
    data, begin, length = _bytes(column)
    first = np.where(length > 0, data[np.minimum(begin, max(len(data) - 1, 0))] if len(data) else 0, 0)
    n = len(length)
    values = {c: np.zeros((n, SLOTS)) for c in ("x", "y", "z", "yaw", "flash")} | {c: np.zeros((n, SLOTS), np.int64) for c in V3.names if c not in ("x", "y", "z", "yaw", "flash")}
    there = {c: np.zeros((n, SLOTS), bool) for c in V3.names}
    known = np.zeros(n, bool)
    whole = 1 + SLOTS * V3.itemsize
    for kind, skip, own in ((V3, 1, (length == whole) & (first == 3)), (V2, 0, length == SLOTS * V2.itemsize), (V1, 0, length == SLOTS * V1.itemsize)):
        at = np.flatnonzero(own & ~known)
        known[at] = True
        if len(at):
            rows = np.frombuffer(_cut(data, begin[at] + skip, length[at] - skip).tobytes(), kind).reshape(len(at), SLOTS)
            for c in kind.names:
                if c in values:
                    values[c][at], there[c][at] = rows[c], True
    flags = values["flags"]
    present = (flags & PRESENT > 0) & known[:, None]
    slot = np.broadcast_to(np.arange(SLOTS), (n, SLOTS))
    for c in ("place", "node", "primary", "secondary"):
        there[c] &= values[c] != NONE
    column_of = {
        "slot": (slot, None, pa.int32()), "side": (np.where(flags & CT, "CT", "T"), None, pa.string()), "alive": (flags & ALIVE > 0, None, pa.bool_()),
        **{c: (values[c], None, pa.float64()) for c in "xyz"}, "health": (values["health"], None, pa.int32()),
        **{c: (values[c], there[c], pa.int32()) for c in ("place", "node")}, "yaw": (values["yaw"] / 255 * 360, there["yaw"], pa.float64()),
        **{c: (values[c], there[c], pa.int32()) for c in ("armor", "money")}, "flash_s": (values["flash"] / 10, there["flash"], pa.float64()),
        **{c: (values[c], there[c], pa.int32()) for c in ("primary", "secondary", "util")},
    }
    fields = [pa.array(v[present], kind, mask=None if ok is None else ~ok[present]) for v, ok, kind in (column_of[f] for f in FIELDS)]
    return _lists(pa.StructArray.from_arrays(fields, FIELDS), present.sum(1), known)


def unpack_paths(column: pa.Array) -> pa.Array:
    """unpack_path of a whole column: each version's blobs are one array."""
    data, begin, length = _bytes(column)
    first = np.where(length > 0, data[np.minimum(begin, max(len(data) - 1, 0))] if len(data) else 0, 0)
    new = (length > 0) & (first == 2) & ((length - 1) % PATH.itemsize == 0)
    old = (length > 0) & ~new & (length % 16 == 0)
    count = np.where(new, (length - 1) // PATH.itemsize, np.where(old, length // 16, 0))
    out = np.zeros((int(count.sum()), 4))
    owner_new = np.repeat(new, count)
    rows = np.frombuffer(_cut(data, begin[new] + 1, length[new] - 1).tobytes(), PATH)
    out[owner_new] = np.column_stack([rows["t"] / 100, rows["x"], rows["y"], rows["z"]])
    out[~owner_new] = np.round(np.frombuffer(_cut(data, begin[old], length[old]).tobytes(), "<f4").reshape(-1, 4).astype(np.float64), 1)
    return _lists(pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(4)], list("txyz")), count, new | old)


def players_of(blob: Column) -> Column:
    """PLAYERS of a packed snapshot column."""
    return F.arrow_udf(unpack_snapshots, PLAYERS)(blob)


def path_of(blob: Column) -> Column:
    """POINTS of a packed path column."""
    return F.arrow_udf(unpack_paths, POINTS)(blob)


def token_of(blob: Column) -> list[Column]:
    """The ten nodes of a packed token (five of CT, five of T), null for padding."""
    byte = lambda k: F.conv(F.hex(F.substring(blob, k + 1, 1)), 16, 10).cast("int")
    return [F.when(byte(k) != NONE, byte(k)) for k in range(10)]
