"""Schemas of vertices and edges. Text that is absent is '', and a width that is unknown is (0, 0); neither is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds that a graph may have.
VERTEX_KINDS = ("SIGNAL", "REG", "WIRE", "PORT_IN", "PORT_OUT", "PORT_INOUT", "CONST", "PARAM", "INSTANTIATED_MODULE")
EDGE_KINDS = ("DRIVER", "CLOCK", "RESET", "CONNECTION", "BIT_SELECT")

VERTEX_DEFAULTS = {"id": "", "name": "", "module": "", "kind": "SIGNAL", "width_msb": 0, "width_lsb": 0, "is_clock": False, "is_reset": False, "is_enable": False, "is_port": False}
EDGE_DEFAULTS = {"src": "", "dst": "", "kind": "DRIVER", "assign_type": "", "condition": "", "clock_domain": "", "expression": "", "edge_seq": 0}


def _schema(defaults: dict) -> T.StructType:
    kind = {str: T.StringType(), bool: T.BooleanType(), int: T.IntegerType()}
    return T.StructType([T.StructField(k, T.LongType() if k == "edge_seq" else kind[type(v)]) for k, v in defaults.items()])


VERTICES, EDGES = _schema(VERTEX_DEFAULTS), _schema(EDGE_DEFAULTS)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: those that are absent or null get their default; other columns go."""
    defaults = VERTEX_DEFAULTS if schema is VERTICES else EDGE_DEFAULTS
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f.name).cast(f.dataType), F.lit(defaults[f.name]).cast(f.dataType)) if f.name in have else F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) for f in schema])
