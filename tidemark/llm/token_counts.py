"""Token counts as delta-maintained rollups.

``count_tokens`` counts every document's tokens under several tokenizer
versions. ``changes`` turns two states of those counts into signed deltas:
+n for an insert, -n for a delete, and -old +new for a revised count or a
document that moved to another source or language. ``Rollup`` keeps additive
totals by source, language and tokenizer version: a batch's deltas are summed
per key, written aside, and committed by one rename under the batch's id that
fails where that id exists, so a batch that is sent again changes nothing, of
two writers of one batch one succeeds, and a failed batch leaves nothing.
The store must rename folders atomically (HDFS does).
``compact`` folds the committed batches into one set of totals and keeps their
ids, so that later reads list few files and old batches still can't come again.

Defined cases: a null or empty text has no tokens but counts as a document; a
null source or language is a group of its own; a null doc_id matches a null
doc_id; repeated rows count as often as they stand there; empty batches can be
committed; an empty rollup has no totals; other columns are ignored; texts of
any length are counted whole; ties can't matter, as sums have no order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, Callable[[], Callable[[str], int]]]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row per document and version.

    tokenizers: by version name, a function that makes a counter on the executor.
    """
    require(docs, "doc_id", "text", "source", "lang")
    names = list(tokenizers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [tokenizers[n]() for n in names]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            for name, counter in zip(names, counters, strict=True):
                n = pa.array([counter(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([name] * len(texts), pa.string()), n], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return plain.mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def words() -> Callable[[str], int]:
    """Counts runs of characters other than ASCII white space."""
    return lambda text: len(text.encode().split())


def vocabulary(path: str) -> Callable[[], Callable[[str], int]]:
    """Counts the ids that a tokenizer file gives."""

    def make() -> Callable[[str], int]:
        from .packing import encoder

        encode = encoder(path)
        return lambda text: len(encode(text)) // 4

    return make


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as deltas: sign 1 inserts them, -1 deletes them."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col("n_tokens")).cast("long").alias("tokens"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The deltas that turn the totals of old into those of new; unchanged rows cancel before anything is written."""
    return summed(signed(old, -1).unionByName(signed(new, 1)))


def summed(deltas: DataFrame) -> DataFrame:
    total = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return total.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


class Rollup:
    """Totals kept as a folder of committed batches in a store that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def _settle(self, aside: str, done: str) -> bool:
        """Renames a folder; False, and the folder goes, if the name is taken."""
        from py4j.protocol import Py4JJavaError

        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE  # an existing name is an error
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(done).toUri(), self.spark._jsc.hadoopConfiguration()) if self._at(done).toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(done).getParent())
        try:
            files.rename(self._at(aside), self._at(done), how)
        except Py4JJavaError:
            if not self._fs.exists(self._at(done)):
                raise
            self._fs.delete(self._at(aside), True)
            return False
        return True

    def _state(self) -> tuple[str | None, list[str]]:
        """The last compaction's folder, and the batches that it doesn't hold."""
        last = max((int(n) for n in self._names("compactions")), default=None)
        if last is None:
            return None, self._names("committed")
        at = f"{self.path}/compactions/{last}"
        # The ids of this rollup's own batches: a row per batch, however large the batches were.
        held = {r["batch"] for r in self.spark.read.parquet(f"{at}/batches").collect()}
        return at, [b for b in self._names("committed") if b not in held]

    def batches(self) -> list[str]:
        """The ids of all committed batches."""
        return self._names("committed")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch once. False if it had been committed before; then nothing is computed."""
        if self._fs.exists(self._at(f"committed/{batch}")):
            return False
        aside = f"staged/{batch}-{uuid.uuid4().hex}"
        summed(deltas).write.parquet(f"{self.path}/{aside}")  # a row per key at most
        return self._settle(aside, f"committed/{batch}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; keys whose sums are 0 are left out."""
        base, rest = self._state()
        found = ([f"{base}/totals"] if base else []) + [f"{self.path}/committed/{b}" for b in rest]
        rows = self.spark.read.schema(DELTA).parquet(*found) if found else self.spark.createDataFrame([], DELTA)
        return summed(rows)

    def compact(self) -> bool:
        """Folds all batches committed so far into one set of totals. Their folders stay, as empty names, so that their ids are known."""
        base, rest = self._state()
        if not rest:
            return False
        number = int(base.rsplit("/", 1)[1]) + 1 if base else 0
        aside = f"staged/compaction-{uuid.uuid4().hex}"
        found = ([f"{base}/totals"] if base else []) + [f"{self.path}/committed/{b}" for b in rest]
        summed(self.spark.read.schema(DELTA).parquet(*found)).write.parquet(f"{self.path}/{aside}/totals")
        ids = self.spark.createDataFrame([(b,) for b in rest], "batch string")
        if base:
            ids = ids.unionByName(self.spark.read.parquet(f"{base}/batches"))
        ids.coalesce(1).write.parquet(f"{self.path}/{aside}/batches")
        if not self._settle(aside, f"compactions/{number}"):
            return False  # another writer was first
        for batch in rest:
            for status in self._fs.listStatus(self._at(f"committed/{batch}")):
                self._fs.delete(status.getPath(), True)
        return True
