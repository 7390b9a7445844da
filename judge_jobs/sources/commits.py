"""Tables that grow by appends which happen once, however often a run is repeated.

A table is a folder of data folders and of versions. A version is a small file that lists the data folders and the runs that
they hold. An append writes a folder of its own and then takes the next version number by a rename that never
overwrites, so it is seen whole or not at all, and of two writers one starts over on what the other left. A run whose id
a version holds already changes nothing. Readers see the last version; what a lost writer left is in none.

The rename has to be atomic, as on HDFS and local disks; object stores need a committer that makes it so.
"""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Data folders of a version from which an append merges them, and files that a merge writes at most.
FOLDERS = 200
FILES = 64


class CommittedTable:
    """A table under ``path`` with a fixed schema, in any format that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet"):
        self.spark, self.path, self.schema, self.form = spark, path.rstrip("/"), schema, form

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> tuple[int, list[str], list[str]]:
        """The last version: its number, its data folders and its runs."""
        fs, p = self._fs("versions")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        last = max((n for n in names if n.isdigit()), default=None)
        if last is None:
            return 0, [], []
        lines = [r.value for r in self.spark.read.text(f"{self.path}/versions/{last}").collect()]
        held = json.loads("".join(lines))
        return int(last), held["folders"], held["runs"]

    def read(self) -> DataFrame:
        """All committed rows; an absent table is empty."""
        _, folders, _ = self.version()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.form).load([f"{self.path}/data/{f}" for f in folders])

    def holds(self, run_id: str) -> bool:
        return run_id in self.version()[2]

    def append(self, run_id: str, rows: DataFrame) -> bool:
        """Add the rows of a run; False, and nothing is computed or written, if the table holds that run already."""
        folder = None
        while True:
            number, folders, runs = self.version()
            if run_id in runs:
                return False
            if folder is None:
                folder = uuid.uuid4().hex
                rows.write.format(self.form).save(f"{self.path}/data/{folder}")
            if self._take(number + 1, [*folders, folder], [*runs, run_id]):
                if len(folders) + 1 >= FOLDERS:
                    self.compact()
                return True

    def compact(self, files: int = FILES) -> bool:
        """Merge the data folders into one of at most ``files`` files; False if another writer was first, or there is nothing to merge."""
        number, folders, runs = self.version()
        if len(folders) < 2:
            return False
        folder = uuid.uuid4().hex
        self.read().coalesce(files).write.format(self.form).save(f"{self.path}/data/{folder}")
        return self._take(number + 1, [folder], runs)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` versions lists, and older versions. Only while no append is under way; returns the folders deleted."""
        fs, p = self._fs("versions")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.isdigit()]
        kept = set()
        for n in names[-keep:]:
            kept |= set(json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{n}").collect()))["folders"])
        fs, p = self._fs("data")
        gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in kept] if fs.exists(p) else []
        for folder in gone:
            fs.delete(folder, True)
        for n in names[:-keep]:
            fs.delete(self._fs(f"versions/{n}")[1], False)
        return len(gone)

    def _take(self, number: int, folders: list[str], runs: list[str]) -> bool:
        """Make a version visible, unless another writer has its number."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        fs, draft = self._fs(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps({"folders": folders, "runs": runs}).encode())
        out.close()
        target = self._fs(f"versions/{number:012d}")[1]
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception).lower():
                raise
            fs.delete(draft, False)
            return False
        return True
