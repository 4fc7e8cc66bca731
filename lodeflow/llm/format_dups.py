"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining.

Canonical form of a text
    * letters and digits only, lower case (white space, control and invisible characters, punctuation, symbols go);
    * where the whole text is one JSON object, or two or more ``label: value`` lines with different labels, the same of
      each field, the fields in order of label and value, those of objects within too. The notation therefore does not
      matter.

Defined results
    NULL, empty, blank and all-symbol texts have no canonical form and take no part, nor do rows without an id. A broken
    JSON object is plain text, unless each of its lines has a label. A dialogue keeps its order: labels that repeat, have one sign, or name a speaker. Rows that repeat id and text make no
    pair, as a pair has two ids. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm import canon
from lodeflow.operators.batches import spread, text_slices
from lodeflow.operators.skew import join_hot_split
from lodeflow.session import materialize


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts = part.column("text").to_pylist()
            found = canon.digests(texts, *canon.flatten(texts))
            table = pa.table({
                "id": part.column("id"),
                "h": pa.array([d and d[:16] for d in found], pa.binary()),
                "check": pa.array([d and int.from_bytes(d[16:], "little", signed=True) for d in found], pa.int64()),
            })
            yield from table.filter(pc.is_valid(table["h"])).to_batches()


def keyed(table: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``h``: 128-bit hash, ``check``: 64 further bits) of every row that has a canonical form."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows.where("id IS NOT NULL AND text IS NOT NULL")).mapInArrow(_hashed, "id BIGINT, h BINARY, check BIGINT")


def format_groups(keys: DataFrame) -> DataFrame:
    """One row per distinct record: ``h``, ``check``, ``keep`` (smallest id), ``copies``.

    Grouping by the hash and the check together is the collision check: two forms that share the 128 bits but are not
    the same come out as two groups. A hot group costs each task one partial row.
    """
    return keys.groupBy("h", "check").agg(F.min("id").alias("keep"), F.count("*").alias("copies"))


def collapse_format_duplicates(table: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """The id of the record kept of each set, and its number of copies, itself included."""
    groups = format_groups(keyed(table, id_col, text_col))
    return groups.select(F.col("keep").alias(id_col), "copies")


def format_duplicate_pairs(table: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(``<id>_a``, ``<id>_b``): the smallest id of each set and every other member.

    The texts are read once; what is written and joined are keys of 32 bytes. The join back splits hot groups.
    """
    keys = materialize(keyed(table, id_col, text_col), "format-keys")
    groups = materialize(format_groups(keys).where("copies > 1"), "format-groups")
    joined = join_hot_split(keys, groups, ["h", "check"], "copies", keys.count())
    return joined.where("id <> keep").select(F.col("keep").alias(f"{id_col}_a"), F.col("id").alias(f"{id_col}_b")).distinct()


def hash_collisions(keys: DataFrame) -> DataFrame:
    """128-bit hashes that different records share; empty unless a collision happened."""
    return format_groups(keys).groupBy("h").agg(F.count("*").alias("forms")).where("forms > 1")
