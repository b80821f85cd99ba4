"""What the corpus operators share: words, table access, written tables, range dealing."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, stash, table, unstash  # noqa: F401

#: A word is a run without ASCII white space. The pattern text suits Java, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: a worker holds the texts of few rows as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run: Callable) -> Callable:
    """run, a function of mapInArrow; what a task freed goes back to the system when it ends, as idle workers stay for the next stages."""

    def rows(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return rows


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
