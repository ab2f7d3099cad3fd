"""Intermediate tables in the shared folder.

A loop writes the state of each round as a parquet table and reads on from it.
The plan then has the same size in every round, a lost executor costs tasks of
the current round only, and Spark knows the size of what it reads, so that it
can broadcast a small table and shuffle a large one.

Operators that go through their input several times write it once.  Spark reuses
a shuffle only where both readers need exactly the same columns, so without the
table the joins behind an edge list would run again for every reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowloom.sources.sinks import forget, known_paths, scratch_path

# Frames that only scan a written table.
_scans: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _scans[out] = path
    return out, path


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    forget(path)


def clear(spark: SparkSession) -> int:
    """Remove what this process has written to the shared folder; frames that read it end here."""
    paths = known_paths()
    for path in paths:
        _remove(spark, path)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was written to the shared folder inside.

    Results that read such tables have to be used up before the end.
    """
    before = set(known_paths())
    try:
        yield
    finally:
        for path in known_paths():
            if path not in before:
                _remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table and return a scan of it, unless it is such a scan already."""
    return df if df in _scans else _written(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to a new table; a scan of it and its rows, counted while they are written."""
    seen = Observation()
    out = _written(df.observe(seen, F.count(F.lit(1)).alias("n")))[0]
    return out, seen.get["n"]


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table of buckets by ``keys``; joins and groups on them do not shuffle its scan.

    A bucketed table needs a name while it is written. It has its own path, so the name
    goes from the catalog again and the files stay until they are removed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    name = f"flowloom_{path.rpartition('-')[2]}"
    # Dealt by the same hash before, so that a bucket is one file.
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class Levels:
    """A growing table of rows numbered by ``level``; a round adds rows and rewrites none."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self._spark, self._schema, self._paths = spark, schema, []

    def append(self, df: DataFrame) -> int:
        """Write the rows of the next level and return how many there are."""
        seen = Observation()
        self._paths.append(_written(df.observe(seen, F.count(F.lit(1)).alias("n")))[1])
        return seen.get["n"]

    def rows(self, level: int | None = None) -> DataFrame:
        """The rows of one level, or all."""
        paths = self._paths if level is None else [self._paths[level]]
        return self._spark.read.schema(self._schema).parquet(*paths)


class Rounds:
    """The state of a loop; writing the next state removes the one before.

    ``facts`` holds the figures asked for with the last step.  They are
    gathered while the state is written, so they cost no further job.
    """

    def __init__(self) -> None:
        self._path: str | None = None
        self.facts: dict[str, object] = {}

    def step(self, df: DataFrame, **facts: Column) -> DataFrame:
        seen = Observation()
        if facts:
            df = df.observe(seen, *[c.alias(name) for name, c in facts.items()])
        out, path = _written(df)
        self.facts = seen.get if facts else {}
        if self._path is not None:
            _remove(df.sparkSession, self._path)
        self._path = path
        return out

    def drop(self, spark: SparkSession) -> None:
        """Remove the last state, once nothing reads it any more."""
        if self._path is not None:
            _remove(spark, self._path)
            self._path = None
