"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separators of this subpackage.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Memo(dict):
    """What a function gives for a word, computed once. trim() starts a new generation once this one has grown over the cap; words
    of the last generation that come again are carried over, so that frequent words stay and memory is bounded."""

    def __init__(self, function, cap: int = 250_000) -> None:
        super().__init__()
        self.function, self.cap, self.old = function, cap, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.function(word)
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a written table: column pruning applies when it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_col(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null gives none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n (null ids count as empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


GRAIN = 1 << 62


def share(want: int, n: int) -> int:
    """Of GRAIN, how much draws about want of n rows: fine enough for any number of rows."""
    return GRAIN if n <= want else GRAIN * want // n


def drawn(salt: str, key: str, part: Column | int) -> Column:
    """Whether a row belongs to a sample of the given share() by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(GRAIN)) < part


def text_bytes(df: DataFrame) -> int:
    """Bytes of text: one aggregate, from which the number of chunks follows at any size."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
