"""Label spaces and the tables between them.

Internal labels are 0 unknown, 1 road, 2 sidewalk, 3 building, 4 vegetation, 5 dynamic, 6 other.
Components differ in how they read raw ids, so a mode names the table.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw id to internal label, in the order of the ids; ids that a table lacks have its default.
CORE = {0: 0, 10: 5, 11: 5, 13: 5, 15: 5, 18: 5, 20: 5, 30: 5, 31: 5, 32: 5, 40: 1, 44: 1, 48: 2, 49: 2, 50: 3, 70: 4, 71: 4, 72: 4, 80: 4, 81: 4}
VOXEL = {0: 0, 10: 5, 11: 5, 13: 5, 15: 5, 16: 5, 18: 5, 20: 5, 30: 5, 31: 5, 32: 5, 40: 1, 44: 1, 48: 2, 49: 1, 50: 3, 51: 3, 52: 3, 70: 4, 71: 4, 72: 2, 80: 4, 81: 4, 99: 6, 252: 5, 253: 5, 254: 5, 255: 5, 256: 5, 257: 5, 258: 5, 259: 5}
GRAPH = {0: 0, 10: 5, 11: 5, 12: 5, 13: 5, 14: 5, 15: 5, 16: 5, 17: 5, 18: 5, 40: 1, 44: 1, 48: 2, 49: 2, 50: 3, 51: 3, 52: 3, 70: 4, 71: 4, 72: 4, 80: 4, 81: 4, 252: 5, 253: 5, 254: 5, 255: 5, 256: 5, 257: 5, 258: 5, 259: 5}
BRIDGE = {10: 5, 11: 5, 13: 5, 15: 5, 16: 5, 18: 5, 20: 5, 30: 5, 31: 5, 32: 5, 40: 1, 44: 1, 48: 2, 49: 2, 50: 3, 51: 3, 52: 3, 60: 1, 70: 4, 71: 4, 72: 2, 80: 4, 81: 4, 99: 6, 252: 5, 253: 5, 254: 5, 255: 5, 256: 5, 257: 5, 258: 5, 259: 5}
CAMERA = {0: 0, 1: 1, 2: 3, 3: 4, 4: 4, 5: 5}
INTERNAL = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
# Learning id to raw id, internal label to raw id.
LEARNING_TO_RAW = {0: 0, 1: 10, 2: 11, 3: 15, 4: 18, 5: 20, 6: 30, 7: 31, 8: 32, 9: 40, 10: 44, 11: 48, 12: 49, 13: 50, 14: 51, 15: 70, 16: 71, 17: 72, 18: 80, 19: 81, 20: 99}
INTERNAL_TO_RAW = {0: 0, 1: 40, 2: 48, 3: 50, 4: 70, 5: 10, 6: 99}

#: Table and default of each mode.
MODES = {"semantic_kitti": (CORE, 6), "voxel": (VOXEL, 0), "graph": (GRAPH, 6), "range": (VOXEL, 0), "bridge": (BRIDGE, 0), "sam3": (CAMERA, 6), "learning_to_raw": (LEARNING_TO_RAW, 0), "internal_to_raw": (INTERNAL_TO_RAW, 0)}


def convert(label: Column, mode: str) -> Column:
    """A label in the space that a mode leads to; null stays null. "internal" holds labels inside 0 to 6."""
    if mode == "internal":
        return F.when(label.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(6), label)).cast("int"))
    if mode not in MODES:
        raise ValueError(f"no label mode {mode}")
    table, default = MODES[mode]
    known = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.when(label.isNotNull(), F.coalesce(F.try_element_at(known, label.cast("int")), F.lit(default)))
