"""Token totals maintained by signed deltas, with batches that commit once.

A change is a row with a sign: an insert counts +1, a delete -1, and a revised count is a delete of the
old figure and an insert of the new one, so totals are sums and nothing is ever counted again from the
documents. A batch is summed by its keys before it meets the totals; what moves is one row for each key.

Totals live in a folder of immutable versions. A version is visible only once its marker exists, and
markers are renamed into place without overwriting, so a commit either happens whole or not at all and
two writers can't take the same number. The version lists the batches it holds: a batch that comes again (a retry,
a replay of the source) changes nothing.
"""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

KEYS = ("source", "lang", "tokenizer")

#: Countable without a vocabulary: name and version, and the pattern of one token (the same in Spark and in SQL).
PATTERNS = {
    "words@1": r"[^\x20\x09-\x0D]+",
    "pieces@2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


def counts(docs: DataFrame, counters: dict[str, Column] | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row for each document and counter.

    Null and empty texts have no tokens, null ids and keys are kept, repeated rows count each, a text of any length is counted whole,
    other columns aren't read, and an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    counters = counters or {name: F.regexp_count(text, F.lit(p)) for name, p in PATTERNS.items()}
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), n.cast("long").alias("n_tokens")) for name, n in counters.items()])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), docs[f"`{lang_col}`"].alias("lang"), each.alias("each"))
    return rows.select("doc_id", "source", "lang", F.inline("each"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that turn the counts ``old`` into ``new`` (both as from :func:`counts`): doc_id, source, lang, tokenizer, n_tokens, sign.

    Both sides are summed as one signed set, so nothing is joined: equal rows on both sides cancel, and a count that changed is a
    delete and an insert. Repeated rows count each (a sign of 2 is two inserts); nulls are values like others; empty tables have no changes.
    """
    columns = ["doc_id", "source", "lang", "tokenizer", "n_tokens"]
    signed = old.select(*columns, F.lit(-1).alias("sign")).union(new.select(*columns, F.lit(1).alias("sign")))
    return signed.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


class Totals:
    """The totals in one folder: n_docs and n_tokens by source, lang and tokenizer.

    A null source or language is a key of its own; a null n_tokens counts as 0, a null sign as an insert.
    Keys whose sums are all zero again leave the totals. Doc ids aren't looked at, so repeated change
    rows count each time, and extra columns are ignored. Without any commit the totals are empty.
    """

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _latest(self) -> tuple[int, str | None]:
        """The last committed version and its folder."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return 0, None
        names = [f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().startswith(".")]
        if not names:
            return 0, None
        last = max(names)
        return int(last), f"{self.path}/{self.spark.read.text(f'{self.path}/commits/{last}').first()[0]}"

    def read(self) -> DataFrame:
        _, folder = self._latest()
        if folder is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{folder}/totals")

    def batches(self) -> DataFrame:
        """The batches that the totals hold."""
        _, folder = self._latest()
        if folder is None:
            return self.spark.createDataFrame([], "batch_id string")
        return self.spark.read.schema("batch_id string").parquet(f"{folder}/batches")

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Add a batch of signed rows; False if the totals hold that batch already."""
        while True:
            version, _ = self._latest()
            held = self.batches()
            if held.where(F.col("batch_id") == batch_id).limit(1).count():
                return False
            sign = F.coalesce(F.col("sign"), F.lit(1)).cast("long")
            step = delta.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens"), F.lit(0))).alias("n_tokens"))
            summed = self.read().unionByName(step).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            folder = f"v{version + 1:09d}-{uuid.uuid4().hex}"
            summed.where("n_docs <> 0 or n_tokens <> 0").coalesce(1).write.parquet(f"{self.path}/{folder}/totals")
            held.union(self.spark.createDataFrame([(batch_id,)], "batch_id string")).coalesce(1).write.parquet(f"{self.path}/{folder}/batches")
            if self._mark(version + 1, folder):
                return True

    def _mark(self, version: int, folder: str) -> bool:
        """Make the version visible, unless another writer took its number: a rename that never overwrites."""
        fs, draft = self._fs(f"{self.path}/drafts/{folder}")
        out = fs.create(draft, False)
        out.write(folder.encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{version:09d}")
        fs.mkdirs(marker.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, marker, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception).lower():
                raise
            return False
        return True


def maintained(docs: DataFrame, path: str) -> DataFrame:
    """A history over a corpus: all documents come, some go, some are counted again, one batch comes twice.

    Batch 1 inserts every document under each counter. Batch 2 deletes those whose id ends in 3.
    Batch 3 revises every seventh of the rest (id modulo 7 is 1): a last word is put to the text, the whole text is
    counted anew, and :func:`changes` takes the old counts off for the new. Then batch 2
    is delivered again. Returns the totals. Null ids are never deleted or counted again; for the rest see :func:`counts`.
    """
    first = table(counts(docs), "counts")
    gone = F.coalesce(F.col("doc_id") % 10 == 3, F.lit(False))
    again = lambda i: F.coalesce((i % 7 == 1) & (i % 10 != 3), F.lit(False))
    totals = Totals(docs.sparkSession, path)
    deleted = first.where(gone).withColumn("sign", F.lit(-1))
    totals.commit("batch-1", first.withColumn("sign", F.lit(1)))
    totals.commit("batch-2", deleted)
    revised = docs.where(again(docs["doc_id"])).select("doc_id", "source", "lang", F.concat(text_or_empty(), F.lit(" end")).alias("text"))
    totals.commit("batch-3", changes(first.where(again(F.col("doc_id"))), counts(revised)))
    totals.commit("batch-2", deleted)
    return totals.read()
