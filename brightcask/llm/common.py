"""What the operators share: the word pattern, the documents table and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space only, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Whether Spark drops a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}
_lock = threading.Lock()
_writing: dict[str, tuple[int, str | None]] = {}  # by application: writes under way, and the session's own setting


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine, where the session names none, a temporary one; elsewhere that is an
    error, for executors would write to disks of their own."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="brightcask-")
    return _folders[app]


class _Cleanup:
    """Turns CLEANUP on while any table is written, also by several threads at once, and back when none is."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.app = spark, spark.sparkContext.applicationId

    def __enter__(self) -> None:
        with _lock:
            n, before = _writing.get(self.app, (0, None))
            if n == 0:
                before = self.spark.conf.get(CLEANUP, None)
                self.spark.conf.set(CLEANUP, "true")
            _writing[self.app] = (n + 1, before)

    def __exit__(self, *_: object) -> None:
        with _lock:
            n, before = _writing[self.app]
            _writing[self.app] = (n - 1, before)
            if n > 1:
                return
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs no recomputation.

    When it is written, Spark drops the shuffle files of the job, which nothing needs any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _Cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(df: DataFrame, **more: Column) -> DataFrame:
    """The row as one struct column beside computed columns, so that no name of the caller's can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def text_mark(text: Column) -> Column:
    """A text's 64-bit hash, null being the empty text. With the id it names a row: ids may be null or come again with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_order(id_col: str, mark: str) -> Column:
    """(none, id, mark): by id, rows without one last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(mark).alias("mark"))


def only_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that named has (id, mark) of, one for each."""
    rows = whole_row(docs, key=docs[id_col], text=text_mark(docs[text_col]))
    met = rows.join(named, F.col("key").eqNullSafe(F.col("id")) & (F.col("text") == F.col("mark")))
    return met.dropDuplicates(["key", "text"]).select("row.*")
