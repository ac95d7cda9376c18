"""Sketch states as bytes: a name, JSON and named arrays, little-endian, arrays sorted by name."""

from __future__ import annotations

import json
import struct
from typing import Any

import numpy as np
import pyarrow as pa

from ..errors import IndistinguishableBudgetError, SerializationError

MAGIC = b"TW1"
#: Codes of array types. Fixed values.
DTYPES = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "bool")


def pack(name: str, meta: dict[str, Any], arrays: dict[str, np.ndarray]) -> bytes:
    head, text = name.encode(), json.dumps(meta, sort_keys=True, separators=(",", ":")).encode()
    out = [MAGIC, struct.pack("<B", len(head)), head, struct.pack("<I", len(text)), text, struct.pack("<H", len(arrays))]
    for key in sorted(arrays):
        a = np.ascontiguousarray(arrays[key])
        if a.dtype.name not in DTYPES:
            raise SerializationError("no code for this type of array", array=key, dtype=a.dtype.name)
        label, raw = key.encode(), a.tobytes()
        out += [struct.pack("<B", len(label)), label, struct.pack(f"<BB{a.ndim}QQ", DTYPES.index(a.dtype.name), a.ndim, *a.shape, len(raw)), raw]
    return b"".join(out)


def unpack(data: bytes) -> tuple[str, dict[str, Any], dict[str, np.ndarray]]:
    """What ``pack`` was given; arrays are copies that can be written to."""
    if not isinstance(data, (bytes, bytearray)) or bytes(data[:3]) != MAGIC:
        raise SerializationError("not a packed state")
    at = 3

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return found

    def text(n: int) -> bytes:
        nonlocal at
        at += n
        return bytes(data[at - n : at])

    try:
        name = text(*take("B")).decode()
        meta = json.loads(text(*take("I")))
        arrays = {}
        for _ in range(*take("H")):
            key = text(*take("B")).decode()
            code, dims = take("BB")
            *shape, n = take(f"{dims}QQ")
            arrays[key] = np.frombuffer(text(n), DTYPES[code]).reshape(shape).copy()
    except (struct.error, IndexError, ValueError) as e:
        raise SerializationError("broken state", reason=str(e)) from e
    return name, meta, arrays


def pack_table(name: str, meta: dict[str, Any], table: pa.Table) -> bytes:
    """A small table as bytes: numeric columns as arrays, others as the bytes of their values laid end to end, and their lengths."""
    arrays, kinds = {}, {}
    for field in table.schema:
        values = table[field.name].combine_chunks()
        kinds[field.name] = str(field.type)
        numeric = pa.types.is_integer(field.type) or pa.types.is_floating(field.type)
        if numeric and not values.null_count:
            arrays[f"v.{field.name}"] = values.to_numpy(zero_copy_only=False)
            continue
        if values.null_count:
            arrays[f"n.{field.name}"] = values.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0) if numeric else values.fill_null(b"" if pa.types.is_binary(field.type) else "")
        if numeric:
            arrays[f"v.{field.name}"] = values.to_numpy(zero_copy_only=False)
        elif pa.types.is_binary(field.type) or pa.types.is_string(field.type):
            parts = [x if isinstance(x, bytes) else x.encode() for x in values.to_pylist()]
            arrays[f"v.{field.name}"] = np.frombuffer(b"".join(parts), np.uint8)
            arrays[f"l.{field.name}"] = np.fromiter(map(len, parts), np.int64, len(parts))
        else:
            raise SerializationError("no code for this type of column", column=field.name, type=str(field.type))
    return pack(name, {**meta, "columns": list(kinds), "types": list(kinds.values()), "rows": table.num_rows}, arrays)


def unpack_table(data: bytes) -> tuple[str, dict[str, Any], pa.Table]:
    """What ``pack_table`` was given."""
    name, meta, arrays = unpack(data)
    try:
        columns = []
        for column, kind in zip(meta["columns"], meta["types"], strict=True):
            values = arrays[f"v.{column}"]
            none = arrays.get(f"n.{column}", np.zeros(meta["rows"], bool))
            if (lengths := arrays.get(f"l.{column}")) is not None:
                raw, ends = values.tobytes(), np.cumsum(lengths)
                parts = [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                values = [None if x else p if kind == "binary" else p.decode() for p, x in zip(parts, none.tolist(), strict=True)]
                columns.append(pa.array(values, kind))
            else:
                columns.append(pa.array(values, mask=none).cast(kind))
        return name, meta, pa.table(columns, meta["columns"])
    except (KeyError, TypeError, pa.ArrowException) as e:
        raise SerializationError("broken state", reason=str(e)) from e


def pack_rows(name: str, meta: dict[str, Any], state) -> bytes:
    """A relational state (bounded by its sketch's size parameter) as bytes."""
    return pack_table(name, meta, state.toArrow())


def check_size(payload: bytes, declared: int, tolerance: float = 0.02) -> None:
    """A declared size that is off by more than the tolerance is an error."""
    if abs(len(payload) - declared) > tolerance * max(1, len(payload)):
        raise IndistinguishableBudgetError("declared size is not the real one", declared=declared, real=len(payload))
