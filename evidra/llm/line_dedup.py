"""Line deduplication over levelled sorted runs of line hashes.

The lines' hashes are computed once and written, dealt to batches by a hash of doc_id. A run is a Parquet table (line_hash, line_check,
n_docs, last_doc) sorted by the hashes in the shared folder, and no key is in two runs: a batch is counted and merge-joined with the runs, what
they lack (the anti-join) becomes a run of level 0, and what they hold goes to a log of increments. Once a level has FANOUT runs they
are merged into one of the next level, with the log's increments added, so that a batch meets a logarithmic number of runs. A key's
count is that of its run and the log. Lines are told apart by two independent 64-bit hashes. Only DataFrame functions run here.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of fewer than min_chars code points
never count. Null and empty texts are one empty line. Documents with the same doc_id count as one; each of their rows keeps or loses
lines alike. Rows with a null doc_id hold lines but their keys are not counted, and they lose every line that is kept elsewhere.
Ties cannot occur: one doc_id is the largest. Other columns are carried by the pipeline stage and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, WS, ascii_lower, scratch, stored, table

KEY = ["line_hash", "line_check"]  # two independent hashes, together 128 bits
RUN_SCHEMA = "line_hash long, line_check long, n_docs long, last_doc long"
BATCHES, FANOUT = 4, 2
HOT = 10_000  #: a key with so great a part of all lines is joined by broadcast; there are no more such keys than this


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def hashes_of(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("line_hash"), F.xxhash64(F.lit("check"), key).alias("line_check")]


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_key, pos, line_hash, line_check) of every line that can count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_key", "pos", *hashes_of(F.col("key")))


@dataclass
class LineRuns:
    """The levels of runs. A batch must hold all rows of its doc_ids, and a doc_id comes in one batch."""

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    root: str = ""

    def __post_init__(self) -> None:
        self.root = self.root or scratch(self.spark, "line-runs")
        self._n = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def _path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n:06d}"

    def runs(self) -> DataFrame:
        """(line_hash, line_check, n_docs, last_doc): every key once, as it was when its run was written."""
        return self._read([p for level in self.levels for p in level])

    def increments(self) -> DataFrame:
        return self._read(self.log).groupBy(*KEY).agg(F.sum("n_docs").alias("_n"), F.max("last_doc").alias("_last"))

    def add(self, keys: DataFrame) -> None:
        """keys: (doc_id, line_hash, line_check) of a batch. Its novel keys become a run, the others increments."""
        pairs = keys.where(F.col("doc_id").isNotNull()).select("doc_id", *KEY).distinct()
        counted = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not any(self.levels):
            counted.sortWithinPartitions(*KEY).write.parquet(path := self._path())
            return self._push(path, 0)
        # one merge of the sorted sides gives both the anti-join and its rest
        known = self.runs().select(*KEY, F.lit(True).alias("known"))
        marked = counted.hint("merge").join(known, KEY, "left").withColumn("known", F.coalesce("known", F.lit(False)))
        marked.sortWithinPartitions("known", *KEY).write.partitionBy("known").parquet(path := self._path())
        split = self.spark.read.schema(f"{RUN_SCHEMA}, known boolean").parquet(path)
        # a folder is missing where a batch has no such keys
        for kind in {r["known"] for r in split.select("known").distinct().collect()}:
            if kind:
                self.log.append(f"{path}/known=true")
            else:
                self._push(f"{path}/known=false", 0)
        return None

    def _push(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            paths, self.levels[level] = self.levels[level], []
            self._push(self._merge(paths), level + 1)

    def _merge(self, paths: list[str]) -> str:
        """One sorted run of several, with the increments of their keys; those of other keys stay in the log."""
        runs = self._read(paths)
        if self.log:
            runs, log = self._counted(runs), self.increments()
            left = log.hint("merge").join(self._read(paths).select(*KEY), KEY, "left_anti")
            left.select(*KEY, F.col("_n").alias("n_docs"), F.col("_last").alias("last_doc")).write.parquet(rest := self._path())
        else:
            rest = None
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        runs.repartition(partitions, *KEY).sortWithinPartitions(*KEY).write.parquet(path := self._path())
        self.log = [rest] if rest else []
        return path

    def _counted(self, runs: DataFrame) -> DataFrame:
        out = runs.hint("merge").join(self.increments(), KEY, "left")
        return out.select(*KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc"))

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys in at least min_docs documents, with the largest doc_id that holds them."""
        runs = self._counted(self.runs()) if self.log else self.runs()
        return runs.where(F.col("n_docs") >= min_docs).select(*KEY, "n_docs", "last_doc")


def drop_lines(docs: DataFrame, keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs (all columns) with kept_text, n_lines and n_dropped. keys: line_hashes() of docs; repeated: (line_hash, line_check, n_docs, last_doc)."""
    repeated = stored(repeated, "repeated")
    hot = F.col("n_docs") * HOT >= F.lit(keys.count())
    head = F.broadcast(repeated.where(hot).drop("n_docs"))
    rest = keys.join(F.broadcast(repeated.where(hot).select(*KEY)), KEY, "left_anti").join(repeated.where(~hot).drop("n_docs"), KEY)
    gone = keys.join(head, KEY).unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).agg(F.collect_list("pos").alias("_gone"))
    # equal rows share positions
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (text_key() == F.col("_gone_key")), "left").drop("_gone_id", "_gone_key")
    out = out.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i))))
    return out.withColumns(
        {"kept_text": F.array_join("_kept", "\n"), "n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long")}
    ).drop("_lines", "_kept", "_gone")


def dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All documents, fed to the runs in batches by a hash of doc_id."""
    spark = docs.sparkSession
    store = LineRuns(spark, fanout)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    line_hashes(docs.select("doc_id", "text"), min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path := scratch(spark, "line-keys"))
    keys = spark.read.schema("doc_id long, text_key long, pos int, line_hash long, line_check long, batch int").parquet(path)
    for i in range(batches):
        store.add(keys.where(F.col("batch") == i))
    return drop_lines(docs, keys, store.repeated(min_docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated lines dropped; one that had words and is left with none goes. n_chars follows the text."""
    out = dedup(docs.select(*DOC_COLUMNS))
    empty = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(WS)) == "")
    out = out.where(~empty).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*DOC_COLUMNS)


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, r.last_doc IS NOT NULL AND r.last_doc <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
