"""Query rows of a search in blocks of bounded size: written once, sent to all tasks block by block.

The rows searched stay where they are: a task reads its part once a block, and what leaves it is bounded by
the block. A block of thousands of queries is long work for each row that is read, so reading anew costs little.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Scratch


def query_blocks(queries: DataFrame, tmp: Scratch, name: str, rows: int) -> Iterator[pa.Table]:
    """``queries`` as Arrow tables of at most ``rows`` rows; only one is held at a time."""
    written = tmp.table(queries, f"{name}-all")
    parts = max(1, -(-written.count() // rows))
    # no file holds more than a block, whatever the hash of its rows
    written.repartition(parts).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(tmp.path(name))
    for file in sorted(queries.sparkSession.read.schema(written.schema).parquet(tmp.path(name)).inputFiles()):
        block = queries.sparkSession.read.schema(written.schema).parquet(file).toArrow()
        if len(block):
            yield block
