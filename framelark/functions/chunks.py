"""Lists of items as chunks: many rows' items as numbers into one dictionary of the chunk.

To look every item up in another table, only the distinct items of a chunk are dealt
out, not each item of each row; the rows themselves move once, as integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from framelark.functions.storage import write_through

CHUNK_ITEMS = 1 << 19


def tidying():
    """A function for the tasks: freed memory of a worker, which outlives its task, goes back to the system."""
    def tidy():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return tidy


def pack(df: DataFrame, items: str, name: str, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``chunk, rows, sizes, items, dictionary``: stored rows of up to ``chunk_items`` items (or one longer list).

    ``rows`` are the other columns, ``items`` the places of all their items in ``dictionary``, as compressed bytes. Strings hold no zero character.
    """
    others = [f for f in df.schema.fields if f.name != items]
    kind = df.schema[items].dataType.elementType.simpleString()
    rows, joined, tidy = StructType(others).simpleString(), kind == "string", tidying()

    def cut(batch, number):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        lists = batch.column(batch.schema.get_field_index(items))
        sizes = pc.fill_null(batch.column(batch.schema.get_field_index("_size")) if joined else pc.list_value_length(lists), 0)
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
        start = 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + chunk_items, "right")) - 1)
            flat, held = lists.slice(start, stop - start), sizes.slice(start, stop - start)
            if joined:
                flat = pc.split_pattern(flat.filter(pc.greater(held, 0)), "\0")
            coded = flat.flatten().dictionary_encode()
            if len(coded) != ends[stop] - ends[start]:
                raise ValueError("an item holds a zero character")
            keys = [batch.column(batch.schema.get_field_index(f.name)).slice(start, stop - start) for f in others]
            keys = pa.StructArray.from_arrays(keys, names=[f.name for f in others])
            places = pa.compress(coded.indices.cast(pa.int32()).to_numpy().tobytes(), codec="zstd", asbytes=True)
            columns = [one(keys), one(held.cast(pa.int32())), pa.array([places], pa.binary()), one(coded.dictionary)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=["chunk", "rows", "sizes", "items", "dictionary"])
            number, start = number + 1, stop

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for out in cut(batch, number):
                yield out
                number += 1
            batch = out = None
            tidy()

    schema = f"chunk bigint, rows array<{rows}>, sizes array<int>, items binary, dictionary array<{kind}>"
    if joined:  # a list of strings takes nearly twice the memory of a batch of texts
        df = df.withColumn("_size", F.size(items)).withColumn(items, F.array_join(items, "\0"))
    return write_through(df.mapInArrow(run, schema), name, compression="zstd")


def look_up(packed: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """One row per chunk with ``found``: the ``value`` of each dictionary item, ``default`` where ``table`` has none. Keys are unique."""
    asked = packed.select("chunk", F.posexplode("dictionary").alias("place", key))
    met = asked.join(table.select(key, value), key, "left").select("chunk", "place", F.coalesce(value, F.lit(default)).alias("v"))
    found = met.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("f"))
    found = found.select("chunk", F.transform("f", lambda x: x["v"]).alias("found"))
    return packed.select("chunk", "rows", "sizes", "items").join(found, "chunk", "left")


def unpack(looked: DataFrame, out: str) -> DataFrame:
    """The rows again, with the values of their items as the list ``out``."""
    rows: StructType = looked.schema["rows"].dataType.elementType
    kind: DataType = looked.schema["found"].dataType
    names = rows.fieldNames()

    tidy = tidying()

    def rows_of(at, r: int):
        import numpy as np
        import pyarrow as pa

        keys = at["rows"][r].values
        ends = np.concatenate([[0], np.cumsum(at["sizes"][r].values.to_numpy())]).astype("int32")
        places = pa.decompress(at["items"][r].as_py(), 4 * int(ends[-1]), codec="zstd", asbytes=True)
        values = at["found"][r].values
        taken = values.take(pa.array(np.frombuffer(places, np.int32))) if values is not None else pa.array([], at["found"].type.value_type)
        return pa.RecordBatch.from_arrays([*keys.flatten(), pa.ListArray.from_arrays(pa.array(ends), taken)], names=[*names, out])

    def run(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in ("rows", "sizes", "items", "found")}
            for r in range(batch.num_rows):
                yield rows_of(at, r)
            batch = at = None
            tidy()

    return looked.mapInArrow(run, StructType([*rows.fields, StructField(out, ArrayType(kind.elementType))]))
