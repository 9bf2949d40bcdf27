"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and a lost executor costs one task, not the whole plan. All tables of an application lie in one folder, see ``clear``."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def _scratch(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/tidelog-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more: all that was made of them has been written itself."""
    for df in tables:
        ref, path = _written.pop(id(df))
        if ref() is not df:
            raise ValueError("not a table of materialize()")
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables of this application from the shared folder, once the results that read them have been written."""
    _written.clear()
    _delete(spark, _scratch(spark))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACES, " ")


def fingerprint(value: Column) -> list[Column]:
    """128 bits as two longs of different seeds; at 10^12 distinct values a collision has odds below 10^-14."""
    return [F.xxhash64(value), F.xxhash64(F.lit(7), value)]


#: Up to so many keys of rows (some 100 bytes each in a hashed relation) are broadcast to filter texts before their shuffle; beyond, all texts are shuffled.
MOST_BROADCAST = 200_000


def with_listed(texts: DataFrame, lists: DataFrame, on: Column | list[str], *keys: str, once: bool = False) -> DataFrame:
    """``texts`` joined to ``lists``, a materialized table with one row a key. Where its keys are few enough, texts without one stay out of the shuffle. ``once``: of rows with one key (then ``on`` is a list) one is taken, before the shuffle already."""
    if lists.count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(lists.select(*keys)), on, "left_semi")
    return (texts.dropDuplicates(on) if once else texts).join(lists, on)


def without_listed(texts: DataFrame, lists: DataFrame, on: Column | list[str]) -> DataFrame:
    """``texts`` without the rows that ``lists``, a materialized table of keys, has. Few keys are broadcast, so that no text is shuffled."""
    return texts.join(F.broadcast(lists) if lists.count() <= MOST_BROADCAST else lists, on, "left_anti")


#: A key is hot when it has more than one of so many rows; so there are at most so many hot keys.
HOT = 1000


def join_split(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, a materialized table with one row for each key and ``size``, the number of ``rows`` that have it. Rows of hot keys, of which there are at most HOT, meet a broadcast of them where they are; only the others are shuffled. ``size`` is that of the table."""
    total = table.agg(F.sum("size")).first()[0] or 0
    least = max(total // HOT, 1)
    table = table.withColumnRenamed("size", "key_size")
    hot, rows = F.broadcast(table.filter(F.col("key_size") > least)), rows.drop("size")
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("key_size") <= least), key)
    return near.unionByName(far).withColumnRenamed("key_size", "size")


def map_texts(docs: DataFrame, function, schema: str, columns: tuple[str, ...] = ("doc_id", "text"), max_bytes: int = 2 << 20) -> DataFrame:
    """Apply ``function`` (a dict of column lists to a dict of column lists) to slices of about ``max_bytes`` of text, so that a worker's memory doesn't follow the batch size. Null texts come as empty ones. One text is never split."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                stop, room = start + 1, max_bytes - sizes[start]
                while stop < batch.num_rows and room >= sizes[stop]:
                    room -= sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                out = function({c: [x or "" for x in part.column(c).to_pylist()] if c == "text" else part.column(c).to_pylist() for c in columns})
                yield pa.RecordBatch.from_arrays([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], type=types[c]) for c in names], names=names)
                start = stop

    types = _arrow_types(docs.sparkSession, schema)
    return docs.select(*columns).mapInArrow(run, schema)


def _arrow_types(spark: SparkSession, schema: str) -> dict:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}


def hashed_part(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About 1.5 times ``most`` of the rows, those whose keys hash lowest, or all if there are fewer: what an ``orderBy(hash).limit(most)`` behind it needs, so that its tasks don't each send ``most`` rows to the driver."""
    share = min(1.0, 1.5 * most / max(rows.count(), 1))
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))
