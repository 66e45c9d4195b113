"""Token counts as a delta-maintained rollup.

The rollup holds additive totals (documents, tokens) by source, language and
tokenizer version. A batch of changes is counted into signed deltas: an
insert adds a document's counts, a delete takes them off, a revision takes
the old counts off and adds the new ones. Deltas of a batch are aggregated
per key (map-side first, so a hot source is one row per task) and written as
the batch's own table. Totals are the sum of the committed batches; no
document is counted again for them.

Commits are idempotent and serial. A batch writes its tables to a folder of
its own try and counts once its commit, the next numbered file of the ledger,
is there; committing the same id again does nothing, and what a failed try
left is never read. Of two writers at once one gets the number; the other
sees that and takes its deletes and revisions off the new state. The ledger
needs a file system that renames without overwriting (HDFS and alike).

Counts of each document are kept beside the totals per batch, so that a
delete or revision needs only the id, not the old text.

Within a batch deletes come first, then revisions, then inserts: an id that is
deleted and inserted is there afterwards, as inserted. A revision says what
the document is now: of several revisions of one id in a batch one counts,
repeated rows once, of different rows the one with the greatest hash of text,
source and language. Repeated inserts add up, and a delete or revision takes
off all rows of its id.

Edge cases: null and empty texts are documents with 0 tokens; null source or
language is a key of its own; deletes and revisions of ids that are not
there change nothing (a revision then inserts); a null id names no document:
deletes of null change nothing, inserts and revisions with a null id add the
document; an empty batch commits; totals of zero documents are left out; extra
columns are ignored. Ids have one type for good, that of the first batch with
documents; whole numbers are cast to it, other types are refused.
"""
from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from .common import text_blocks, word_spans
from .tokens import WordTokens, tokenizer_path

KEY = ["source", "lang", "version"]
_FACTS = "{id}, source string, lang string, version string, tokens long"


def _words(data, offsets):
    return np.diff(np.searchsorted(word_spans(data, offsets)[0], offsets))


def _count(versions):
    def rows(batches):
        known = {v: WordTokens(path) for v, path in versions.items() if path}
        for block, data, offsets in text_blocks(batches, "text"):
            for version, tokens in [*known.items(), *((v, None) for v in versions if v not in known)]:
                n = np.diff(tokens.encode(data, offsets)[1]) if tokens else _words(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1), block.column(2), pa.array([version] * len(n), pa.string()),
                     pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "version", "tokens"])
    return rows


def default_versions() -> dict[str, str | None]:
    """Tokenizer versions: the path of a ``tokenizers`` file, or None for
    ASCII white-space words."""
    return {"words-1": None, "word_bpe_49k-1": tokenizer_path("word_bpe_49k.json")}


def count_tokens(docs: DataFrame, versions: dict[str, str | None] | None = None) -> DataFrame:
    """doc_id, source, lang, version and tokens of each document and version."""
    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(_count(versions or default_versions()), _FACTS.format(id=f"doc_id {dict(rows.dtypes)['doc_id']}"))


class TokenRollup:
    """A rollup in ``folder`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str | None] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = versions or default_versions()

    # -- the ledger of batches

    def _path(self, name):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _ledger(self) -> list[tuple[str, str | None]]:
        """(batch, folder of its tables or None) in the order of the commits."""
        fs, top = self._files(), self._path("commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
        out = []
        for name in names:
            stream = fs.open(self._path(f"commits/{name}"))
            out.append(tuple(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            stream.close()
        return out

    def committed(self) -> list[str]:
        """Ids of the committed batches, in the order of their commits."""
        return [batch for batch, _ in self._ledger()]

    def _mark(self, entry) -> bool:
        """Commit (number, batch, folder); False if the number is taken."""
        number, batch, folder = entry
        fs, jvm = self._files(), self.spark._jvm
        # written whole beside the ledger, then renamed: a reader never sees half
        ready = self._path(f"ready/{uuid.uuid4().hex}")
        stream = fs.create(ready, False)
        stream.write(bytearray(json.dumps([batch, folder]).encode()))
        stream.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        never_over[0] = kinds.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(ready.toUri(), self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path("commits"))
        try:
            files.rename(ready, self._path(f"commits/{number:012d}"), never_over)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            fs.delete(ready, False)
            return False

    def _read(self, kind, ledger):
        paths = [f"{folder}/{kind}" for _, folder in ledger if folder]
        return self.spark.read.parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else None

    # -- changes

    def documents(self) -> DataFrame | None:
        """Counts of the documents that are there, summed over their facts."""
        return self._there(self._read("facts", self._ledger()))

    @staticmethod
    def _there(facts):
        if facts is None:
            return None
        totals = facts.groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return totals.where("docs <> 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, revisions: DataFrame | None = None,
               deletes: DataFrame | None = None) -> bool:
        """Commit a batch: ``inserts`` and ``revisions`` hold documents,
        ``deletes`` ids (column doc_id). False if it was committed before."""
        if not batch or "/" in batch:
            raise ValueError("a batch id names a folder")
        while True:
            ledger = self._ledger()
            if batch in (b for b, _ in ledger):
                return False
            folder = self._write(batch, self._signed(self._read("facts", ledger), inserts, revisions, deletes))
            if self._mark((len(ledger), batch, folder)):
                return True

    def _signed(self, facts, inserts, revisions, deletes):
        """The batch's signed counts of documents, or None without any."""
        parts = []
        if inserts is not None:
            parts.append(count_tokens(inserts, self.versions))
        if revisions is not None:
            parts.append(self._one_each(revisions))
        parts = [p.select("doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens") for p in parts]
        gone = [d.select("doc_id") for d in (revisions, deletes) if d is not None]
        if facts is not None:
            kind = facts.schema["doc_id"].dataType
            for frame in (inserts, revisions, deletes):
                own = kind if frame is None else frame.schema["doc_id"].dataType
                if own != kind and not (isinstance(own, (IntegralType, NullType)) and isinstance(kind, IntegralType)):
                    raise ValueError(f"ids are {kind.simpleString()} here, not {own.simpleString()}")
            parts = [p.withColumn("doc_id", F.col("doc_id").cast(kind)) for p in parts]
            if gone:
                ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
                old = self._there(facts.join(ids.distinct(), "doc_id", "left_semi"))
                parts.append(old.select("doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        if not parts:
            return None
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _one_each(self, revisions):
        """Counts of one revision per id; every revision without id."""
        own = F.struct("text", "source", "lang")
        rows = revisions.select(F.struct(
            F.col("doc_id").alias("id"), F.xxhash64(F.lit(1), own).alias("a"), F.xxhash64(F.lit(2), own).alias("b")).alias("doc_id"),
            "text", "source", "lang")
        facts = count_tokens(rows, self.versions).select("doc_id.*", *KEY, "tokens")
        named = facts.where("id is not null").groupBy("id", "version").agg(
            F.max_by(F.struct("source", "lang", "tokens"), F.struct("a", "b")).alias("x")).select("id", "version", "x.*")
        return named.unionByName(facts.where("id is null").select(named.columns)).withColumnRenamed("id", "doc_id")

    def _write(self, batch, signed) -> str | None:
        if signed is None:
            return None
        folder = f"batch-{batch}-{uuid.uuid4().hex}"
        path = f"{self.folder}/{folder}"
        signed.write.parquet(f"{path}/facts")
        deltas = self.spark.read.parquet(f"{path}/facts").groupBy(*KEY).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.parquet(f"{path}/deltas")
        return folder

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens over all committed batches."""
        deltas = self._read("deltas", self._ledger())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        sums = deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")
