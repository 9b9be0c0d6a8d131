"""Schemas of the plan's tables, their checks, and the published JSON Schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

D, S, L, I, B = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()  # noqa: E741


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEASUREMENT = struct(id=S, kind=S, value=D, unit=S, ci_low=D, ci_high=D, method=S, tier=S)
POINT = T.ArrayType(D)
SE2 = struct(x=D, y=D, theta=D)

TABLES = {
    "captures": struct(capture_id=S, tier=S, device=S, ios=S, captured_at=S, rooms_expected=I),
    "frames": struct(capture_id=S, idx=I, timestamp=D, depth_ref=S, confidence_ref=S, pose=T.ArrayType(D), k=T.ArrayType(D)),
    "points": struct(capture_id=S, pid=L, x=D, y=D, z=D),
    "camera_path": struct(capture_id=S, seq=L, x=D, y=D, z=D),
    "wall_cells": struct(capture_id=S, x=D, z=D, support=L),
    "floor_cells": struct(capture_id=S, x=D, z=D),
    "free_cells": struct(capture_id=S, x=D, z=D),
    "walls": struct(capture_id=S, axis=I, offset=D, start=D, end=D, kind=S, provenance=S, rule=S, ci=D, extension=D, support=L, coverage=D, thickness=D, merged_from=L, strength=D),
    "graph_nodes": struct(capture_id=S, id=S, u=D, v=D, type=S, inferred=B),
    "graph_edges": struct(capture_id=S, id=S, node_a=S, node_b=S, length=D, ci=D, provenance=S),
    "rooms": struct(capture_id=S, id=S, ring=T.ArrayType(POINT), area=MEASUREMENT, ceiling=MEASUREMENT, observed=D, perimeter=D),
    "surfaces": struct(capture_id=S, id=S, room_id=S, type=S, a=POINT, b=POINT, nx=D, nz=D, d=D),
    "openings": struct(capture_id=S, id=S, room_id=S, surface_id=S, kind=S, width=MEASUREMENT, height=MEASUREMENT),
    "damages": struct(capture_id=S, id=S, surface_id=S, kind=S, area=D, length=D),
    "concealed": struct(capture_id=S, surface_id=S, flag=S),
    "scope": struct(capture_id=S, id=S, surface_id=S, task=S, quantity=D, low=D, high=D),
    "invariants": struct(capture_id=S, name=S, ok=B, detail=S),
}
#: Table, column, parent table: all must refer to an `id` of the same capture.
REFERENCES = [
    ("surfaces", "room_id", "rooms"),
    ("openings", "room_id", "rooms"),
    ("openings", "surface_id", "surfaces"),
    ("damages", "surface_id", "surfaces"),
    ("concealed", "surface_id", "surfaces"),
    ("scope", "surface_id", "surfaces"),
]
#: Closed sets of strings.
ENUMS = {("openings", "kind"): ("door", "window", "passage"), ("captures", "tier"): ("lidar", "photos", "video"), ("damages", "kind"): ("mold", "water_stain", "crack", "peeling_paint")}


def json_schema(kind: T.DataType) -> dict:
    """JSON Schema of a Spark type; structs are closed."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType) for f in kind}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number"}
    return {"type": [names.get(type(kind), "integer"), "null"]}


def plan_schema() -> dict:
    props = {k: {"type": "array", "items": json_schema(v)} for k, v in TABLES.items()}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "plan", "type": "object", "properties": props, "additionalProperties": False}


def checks(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Violations of references, closed sets and measurement intervals: capture_id, check, message."""
    found = []
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables:
            known = tables[parent].select("capture_id", F.col("id").alias(column))
            lost = tables[child].where(F.col(column).isNotNull()).join(known, ["capture_id", column], "left_anti")
            found.append(lost.select("capture_id", F.lit(f"{child}.{column}").alias("check"), F.format_string(f"{child} refers to unknown {parent} %s", column).alias("message")))
    for (name, column), allowed in ENUMS.items():
        if name in tables:
            bad = tables[name].where(~F.col(column).isin(*allowed))
            found.append(bad.select("capture_id", F.lit(f"{name}.{column}").alias("check"), F.format_string("%s is not allowed", column).alias("message")))
    for name, df in tables.items():
        for f in TABLES.get(name, T.StructType()):
            if f.dataType == MEASUREMENT:
                m = F.col(f.name)
                bad = df.where(m.isNotNull() & ~F.coalesce((m["ci_low"] <= m["value"]) & (m["value"] <= m["ci_high"]), F.lit(False)))
                found.append(bad.select("capture_id", F.lit(f"{name}.{f.name}").alias("check"), F.format_string("interval of %s doesn't hold its value", m["id"]).alias("message")))
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out
