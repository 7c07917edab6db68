"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything that is not ASCII white space; the word of every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: The complement of ``WORD``.
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine
    gets a folder of its own; on a cluster there is none that would do."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="colstride-"))
    return place.rstrip("/")


_own: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots as ``__``) for the tables that are written within it."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet. Its shuffle files go once that is done, not when the driver collects garbage."""
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write(df, path)
    if (made := _scratch.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within it ``stored`` tables are noted, and at its end they are removed: for results that are written
    before it ends. It gives what stores a table that outlives it."""
    made: list[str] = []
    outer = _scratch.get()
    token = _scratch.set(made)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _scratch.set(outer)
        try:
            return stored(df, label)
        finally:
            _scratch.reset(inner)

    try:
        yield keep
    finally:
        _scratch.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


#: A key is hot when it has more than so many rows and more than this fraction of all rows.
HOT_ROWS, HOT_FRACTION = 10_000, 5_000


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """The hot keys of a table with a count ``n`` for each key, fewer than ``HOT_FRACTION``; None: no key is."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_FRACTION)
    return counts.where(F.col(n) > limit).select(key) if (most or 0) > limit else None


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key at most. The rows of hot keys stay
    where they are and the few rows of ``side`` for them are broadcast; the others are dealt by key."""
    if hot is None:
        return rows.join(side, key)
    few = F.broadcast(hot)
    dealt = rows.join(few, key, "left_anti").join(side, key)
    return dealt.unionByName(rows.join(F.broadcast(side.join(few, key, "left_semi")), key))


#: Rows of an Arrow batch between the JVM and its Python workers; texts are long, so it stays small.
BATCH_ROWS = 1000
#: What empties the memory that an operator keeps in a worker process, by operator.
CLEAR: dict[str, Callable[[], None]] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands at most ``BATCH_ROWS`` rows at a time to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def only(operator: str) -> None:
    """Empty what other operators keep in this worker process: workers outlive tasks and queries."""
    for name, clear in CLEAR.items():
        if name != operator:
            clear()


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Parts of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case."""
    known = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in known:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; null text: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols) -> Column:
    """A seeded uniform draw in [0, 1) from 52 bits of xxhash64."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12) / F.lit(float(1 << 52))


def crc_fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4 (null id: fold of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
