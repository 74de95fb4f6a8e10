"""A ledger of keyed records that several writers may append to at once.

A ledger is a folder of data files and a log of numbered entries.  A writer writes its rows to a folder of their own, then adds
a log entry that names it; an entry's number can be taken once, so of two writers one goes first, and the other looks at
what has come, leaves out what the first one wrote, and tries the next number.  Readers see the folders that the log names:
what a writer has written but not entered (a crash between the two) is never seen, and vacuum() removes it.

A record has a key; several records of one key are its history, of which the one with the greatest entry stands.  compact()
rewrites the folders into few files and enters the exchange like any other writer.

Numbers are taken by creating a file that must not exist: hard links on a local disk, renames without overwriting on HDFS
and the like.  Object stores without either need a catalog and are refused.  A null key is a key.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has taken the number."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        scheme = self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs", "abfs", "abfss", "ofs"):
            raise ValueError(f"{scheme}: has no create that fails where a file is")
        self._local = re.sub("^file:/*", "/", self.path) if scheme == "file" else None

    # ------------------------------------------------------------ log

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _list(self, name: str) -> list[str]:
        folder = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def entries(self) -> list[dict]:
        """The log: entries with their numbers, in order."""
        names = [n for n in self._list("log") if re.fullmatch(r"\d{12}\.json", n)]
        if not names:
            return []
        rows = self.spark.read.text([f"{self.path}/log/{n}" for n in names], wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["number"])

    def _enter(self, entry: dict) -> None:
        """Add an entry under its number, or raise Conflict."""
        text, name = json.dumps(entry), f"{entry['number']:012d}.json"
        if self._local:
            os.makedirs(f"{self._local}/log", exist_ok=True)
            draft = f"{self._local}/log/.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(text)
            try:
                os.link(draft, f"{self._local}/log/{name}")
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                os.unlink(draft)
            return
        draft = self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(draft, self._path(f"log/{name}"), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(f"log/{name}")):
                raise Conflict(name) from e
            raise

    # ------------------------------------------------------------ reading

    def _live(self, entries: list[dict]) -> dict[str, int]:
        """Folders that stand, and the number of the entry that added each."""
        out: dict[str, int] = {}
        for e in entries:
            for folder in e["remove"]:
                out.pop(folder, None)
            out |= {folder: e["number"] for folder in e["add"]}
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{self.schema}, entry long")
        return self.spark.read.schema(f"{self.schema}, entry long").parquet(*[f"{self.path}/data/{f}" for f in folders])

    def history(self) -> DataFrame:
        """All records, with the number of the entry that brought each."""
        return self._read(sorted(self._live(self.entries())))

    def latest(self) -> DataFrame:
        """The record of each key with the greatest entry; of one entry, the greatest record."""
        rows = self.history()
        names = [c for c in rows.columns if c != "entry"]
        best = rows.groupBy(self.key).agg(F.max(F.struct("entry", *names)).alias("r"))
        return best.select(*[F.col("r")[c].alias(c) for c in names])

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, number: int) -> str:
        folder = uuid.uuid4().hex
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        rows = rows.select(*columns, F.lit(number).cast("long").alias("entry") if "entry" not in rows.columns else F.col("entry").cast("long"))
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def append(self, rows: DataFrame, batch: str | None = None, again: Column | None = None, tries: int = 20) -> int:
        """Add the rows whose keys the ledger does not hold (one a key), and return the entry's number; 0 if nothing was added.

        again: of which of the ledger's latest records the keys may be written once more (rejected ones, to reopen them).  batch: a name that is
        entered once; a batch that comes again is not added again.
        """
        wanted = rows.dropDuplicates([self.key])
        for _ in range(tries):
            entries = self.entries()
            if batch is not None and any(e.get("batch") == batch for e in entries):
                return 0
            held = self.latest()
            held = held.where(~F.coalesce(again, F.lit(False))) if again is not None else held
            new = wanted.join(held.select(F.col(self.key).alias("_held")), F.col(self.key).eqNullSafe(F.col("_held")), "left_anti")
            number = (entries[-1]["number"] if entries else 0) + 1
            folder = self._write(new, number)
            if batch is None and self._read([folder]).isEmpty():
                self._fs.delete(self._path(f"data/{folder}"), True)
                return 0
            try:
                self._enter({"number": number, "add": [folder], "remove": [], "batch": batch})
                return number
            except Conflict:  # what has come meanwhile may hold some of these keys
                self._fs.delete(self._path(f"data/{folder}"), True)
        raise Conflict(f"{tries} tries")

    def compact(self, files: int = 1, tries: int = 20) -> int:
        """Rewrite what stands into so many files and return the entry's number; 0 if one folder or none stands."""
        for _ in range(tries):
            entries = self.entries()
            live = sorted(self._live(entries))
            if len(live) < 2:
                return 0
            folder = self._write(self._read(live).repartition(files), 0)
            number = entries[-1]["number"] + 1
            while True:
                try:
                    self._enter({"number": number, "add": [folder], "remove": live, "batch": None})
                    return number
                except Conflict:  # records that were added meanwhile stay beside; another rewrite of these folders rules this one out
                    seen = self.entries()
                    if not set(live) <= set(self._live(seen)):
                        self._fs.delete(self._path(f"data/{folder}"), True)
                        break
                    number = seen[-1]["number"] + 1
        raise Conflict(f"{tries} tries")

    def vacuum(self, older_than_s: float = 24 * 3600) -> int:
        """Delete folders that no entry holds, if they are old enough to be no one's work in progress; return their number."""
        live = set(self._live(self.entries()))
        now = self._jvm.java.lang.System.currentTimeMillis()
        folder = self._path("data")
        gone = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName() not in live and now - s.getModificationTime() >= older_than_s * 1000] if self._fs.exists(folder) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    def write_stream(self, rows: DataFrame, checkpoint: str, name: str):
        """Append a stream; a batch that is run again after a crash is entered once."""
        return (
            rows.writeStream.foreachBatch(lambda batch, n: self.append(batch, batch=f"{name}/{n}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def pending(candidates: DataFrame, ledger: DataFrame, key: str, verified: str, retry: bool = False) -> DataFrame:
    """Candidates that the ledger's latest records do not settle: none of theirs, or with retry a rejected one."""
    settled = ledger.where(F.col(verified)) if retry else ledger
    return candidates.join(settled.select(key).distinct(), key, "left_anti")
