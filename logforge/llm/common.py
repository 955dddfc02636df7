"""Helpers shared by the operators: reading tables, what a worker keeps, cutting lineage, connected components."""

from __future__ import annotations

import time

from logforge.functions.lineage import materialise, scratch_dir
from logforge.functions.skew import hot_keys, spread_join
from logforge.operators.graph import connected_components
from logforge.sources.tables import read_table

__all__ = ["connected_components", "hot_keys", "materialise", "once", "read_table", "release", "scratch_dir", "spread_join"]

#: Seconds after which a worker drops what no task has asked for.
IDLE = 20.0
_MADE: dict = {}


def release(kept=None, alone: bool = False) -> None:
    """Drops what other operators left in this worker and no task has asked for in IDLE seconds; with alone, also at once
    what was made for another key than `kept` of the same first member."""
    now = time.monotonic()
    for key in [k for k, (at, _) in _MADE.items() if k != kept and (now - at > IDLE or (alone and k[0] == kept[0]))]:
        del _MADE[key]


def once(key: tuple, make, alone: bool = False):
    """What make() gives, made once in each worker process: tasks that follow in the same process find it. A worker that
    goes from stage to stage holds what the last ones need, see release()."""
    release(key, alone)
    found = _MADE[key][1] if key in _MADE else make()
    _MADE[key] = time.monotonic(), found
    return found
