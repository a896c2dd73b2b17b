"""What the corpus operators share: Arrow maps that keep other columns, and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Paths of the tables written within each open ``scratch``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def slices(columns: list[pa.Array], rows: int, size: int) -> Iterator[tuple[int, int]]:
    """[from, to) of at most ``rows`` rows with ``size`` bytes of strings each, or of one row that is larger."""
    n = len(columns[0]) if columns else 0
    weight = np.zeros(n, dtype=np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(weight)
    a = 0
    while a < n:
        before = int(ends[a - 1]) if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield a, b
        a = b


def append_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str | T.StructType,
    start: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
    rows: int = 1000,
    size: int = 4 << 20,
) -> DataFrame:
    """``df`` with columns computed batch by batch in tasks, without a shuffle.

    At most ``rows`` rows of an Arrow batch with ``size`` bytes of text are worked on at a time (a longer
    text alone), so that what is made of them need not fit into memory as a whole.

    ``start()`` is called once per task and returns a function that maps the Arrow columns
    ``inputs`` of a batch to the Arrow arrays (or lists) of ``outputs``. ``keep`` names the columns
    of ``df`` that pass through (all by default). An input column that has the name of an output
    is replaced by the output. An empty table gives an empty table.
    """
    new = outputs if isinstance(outputs, T.StructType) else T._parse_datatype_string(outputs)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(new))
    n = len(kept)
    source = df.select(*[df[c] for c in kept], *[df[c].alias(unused(kept, f"__in{i}_")) for i, c in enumerate(inputs)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new]
    titles = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            for a, b in slices(whole.columns[n:], rows, size):
                batch = whole.slice(a, b - a)
                work = work or start()
                made = work(*batch.columns[n:])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(list(batch.columns[:n]) + arrays, names=titles)
        pa.default_memory_pool().release_unused()  # a worker is used for the next task and stage

    return source.mapInArrow(run, schema)


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session uses a folder below its warehouse; a cluster is refused,
    as the driver's own folders need not be seen by executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/sitegauge-{uuid.uuid4().hex}"


def write_out(df: DataFrame, outlive: bool = False, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends at durable files.

    The files are deleted when the innermost open ``scratch`` ends, those that ``outlive`` it with the next one.
    With a ``path`` of the caller they are the caller's.
    """
    scopes = _scopes.get()[: -1 if outlive else None]
    if scopes and path is None:
        scopes[-1].append(path := shared_folder(df.sparkSession))
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``write_out`` wrote within, at the end; only tables that outlive it may be read then."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def texts(column: pa.Array) -> Iterable[str]:
    """The strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, convert: Callable[[pa.Table], tuple]) -> Iterator[tuple]:
    """Slices of ``convert``'s sequences, one set for each run of equal ``key`` in a sorted task's batches.

    Groups may span batches; what is held is one batch and one group.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        keys = held.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            made = convert(held)
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield tuple(x[a:b] for x in made)
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield tuple(convert(held))
