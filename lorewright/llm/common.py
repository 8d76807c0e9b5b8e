"""What the training-data operators share: the library's lineage cuts and joins, and what a worker keeps."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import functions as F

from lorewright.shared import anti_join, bound_batches, checked, checked_lists, connected_components, discard, materialize, semi_join, shared_dir

__all__ = ["anti_join", "bound_batches", "checked", "checked_lists", "connected_components", "crc32_mod", "discard", "materialize", "semi_join", "shared_dir", "worker_state"]

#: What the operator that ran last in this worker keeps: memos and tables.
_kept: dict = {}


def worker_state(key, make):
    """make()'s result, kept in this worker for calls with the same key until another operator asks for its own.

    Workers serve many stages; without this each operator's memo would stay beside the next one's.
    """
    if key not in _kept:
        if others := [k for k in _kept if k[0] != key[0]]:
            for other in others:
                del _kept[other]
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _kept[key] = make()
    return _kept[key]


def crc32_mod(column: str, modulus: int):
    """crc32 of the column's decimal text, modulo modulus."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
