"""An append-only log of batches that can be written again without harm.

A batch is written to a folder of its own attempt and becomes part of the log
when its marker, an empty file ``commits/<batch>.<attempt>``, is there.
Readers list the markers and read only the folders they name. So

* an attempt that died leaves files that nobody reads;
* a batch that is already committed is not written again (``commit`` returns
  False);
* two writers of the same batch at once may both set a marker; readers take
  the attempt that comes first by name, so the batch counts once.

No rename and no exclusive create is needed, only that a created file is
listed, which object stores give too. ``compact`` rewrites many small batches
as one: its marker ``compacted/<n>.<attempt>`` holds the batches that it
replaces. Batch ids are any non-empty strings.
"""
from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """The log of rows of one ``schema`` under ``path``.

    Reading a log without batches gives an empty table. Rows of a batch must
    have the columns of the schema, in any order; others are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    # -- files -----------------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, name: str, content: str = "") -> None:
        fs, at = self._fs(f"{self.path}/{name}")
        stream = fs.create(at, True)
        stream.write(bytearray(content.encode()))
        stream.close()

    def _read(self, name: str) -> str:
        fs, at = self._fs(f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # -- batches ---------------------------------------------------------------

    def _committed(self) -> dict[str, str]:
        """Batch -> folder, the first attempt by name; compacted batches are
        the folder they were rewritten to."""
        found: dict[str, str] = {}
        for name in self._names("commits"):
            batch, attempt = name.rsplit(".", 1)
            found.setdefault(unquote(batch), f"{self.path}/data/{batch}.{attempt}")
        # in the order of their numbers: a later one contains the earlier ones
        for name in sorted(self._names("compacted"), key=lambda n: (int(n.split(".")[0]), n), reverse=True):
            folder = f"{self.path}/data/compacted.{name}"
            try:
                replaced = json.loads(self._read(f"compacted/{name}"))
            except ValueError:  # its writer died
                continue
            return {**found, **dict.fromkeys(replaced, folder)}
        return found

    def batches(self) -> list[str]:
        """The committed batches, sorted."""
        return sorted(self._committed())

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Append ``rows`` as batch ``batch_id`` unless it is already there."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        if batch_id in self._committed():
            return False
        name = f"{quote(batch_id, safe='')}.{uuid.uuid4().hex}"
        rows.select(*(rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in self.schema)) \
            .write.parquet(f"{self.path}/data/{name}")
        self._mark(f"commits/{name}")
        return True

    def read(self, batches=None) -> DataFrame:
        """The rows of all committed batches, or of those named."""
        committed = self._committed()
        if batches is not None:
            missing = set(batches) - set(committed)
            if missing:
                raise KeyError(f"not committed: {sorted(missing)}")
            chosen = {committed[b] for b in batches}
            whole = {f for f in chosen if "/data/compacted." in f}
            if any(f in whole and b not in batches for b, f in committed.items()):
                raise KeyError("some of these batches were compacted with others")
            folders = sorted(chosen)
        else:
            folders = sorted(set(committed.values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def compact(self, merge=None) -> bool:
        """Rewrite all committed batches as one; ``merge`` (DataFrame ->
        DataFrame of the same columns) may combine their rows. Readers that
        started before go on with the old files, which ``vacuum`` removes."""
        committed = self._committed()
        if len(set(committed.values())) < 2:
            return False
        rows = self.read()
        rows = rows if merge is None else merge(rows).select(*self.schema.names)
        last = max((int(n.split(".")[0]) for n in self._names("compacted")), default=-1)
        name = f"{last + 1}.{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/compacted.{name}")
        self._mark(f"compacted/{name}", json.dumps(sorted(committed)))
        return True

    def vacuum(self) -> int:
        """Remove the folders that no reader would read from now on (attempts
        that died, batches that were compacted); number of folders. Only
        when no writer and no older reader is at work."""
        used = set(self._committed().values())
        gone = [n for n in self._names("data") if f"{self.path}/data/{n}" not in used]
        for n in gone:
            fs, at = self._fs(f"{self.path}/data/{n}")
            fs.delete(at, True)
        return len(gone)
