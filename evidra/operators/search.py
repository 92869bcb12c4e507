"""Free-text search by an inverted index of character trigrams, kept as tables.

A text contains a needle only if it contains all the needle's trigrams. The index holds, for each trigram and block of BLOCK
consecutive text numbers, the sorted numbers of the texts that have it, in Parquet sorted by trigram: a search reads only the row
groups that its trigrams can be in, intersects the lists of a block, reads the texts of the numbers that are left, and looks for the needle in
them. A frequent trigram is many short lists, never a long one. New texts become a run of their own; runs are merged once there are
FANOUT of them. A text that comes again under its key takes the place of the earlier one.

Texts are folded (case, marks and white space play no part). Null texts are not indexed. Needles of fewer than three characters, which
have no trigram, are looked for in all texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canon import fold, fold_text
from ..session import in_ranges

BLOCK = 4_096
FANOUT = 4
CHARS = 2_000_000  #: of texts whose trigrams are listed together; a longer text is taken in pieces
TEXTS = "no long, run long, kind string, id string, field string, text string, folded string"
LISTS = "gram string, block long, numbers array<long>"


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _listed(no: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of some texts, where each one's list ends, and the lists of numbers, one behind the other."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), lengths)
    inside = of[2:] == of[:-2]
    symbols, code = np.unique(points, return_inverse=True)
    n, code = len(symbols), code.astype(np.int64)
    keys, gram = np.unique(((code[:-2] * n + code[1:-1]) * n + code[2:])[inside], return_inverse=True)
    gram, at = np.divmod(np.unique(gram.astype(np.int64) * len(texts) + of[2:][inside]), len(texts))
    spelt = symbols[np.column_stack([keys // (n * n), keys // n % n, keys % n])].astype(np.uint32).tobytes().decode("utf-32-le")
    ends = np.cumsum(np.bincount(gram, minlength=len(keys)))
    return [spelt[i : i + 3] for i in range(0, len(spelt), 3)], ends, no[at]


def _lists(block: int, chars: int):
    """Of batches of (no, folded) parts of the lists (gram, block, places), each out of so many characters at most. A text's place in its
    block is its number less the block's first."""

    def part(held: list[tuple[int, str]]) -> pa.RecordBatch:
        grams, ends, places = _listed(np.array([no % block for no, _ in held], np.int32), [t for _, t in held])
        rows = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.full(len(grams), held[0][0] // block), pa.int64()), rows], names=["gram", "block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for no, text in zip(batch.column("no").to_pylist(), batch.column("folded")):
                whole = text.as_py()
                for i in range(0, len(whole) - 2, chars):
                    piece = whole[i : i + chars + 2]  # the next piece begins with its last two characters
                    if held and (size + len(piece) > chars + 2 or no // block != held[0][0] // block):
                        yield part(held)
                        held, size = [], 0
                    held.append((no, piece))
                    size += len(piece)
        if held:
            yield part(held)

    return run


class TextIndex:
    """An index in a folder. What counts is named by the newest record, so that a failed update changes nothing."""

    RECORD = "seq long, next long, run long, texts array<string>, lists array<string>"

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout

    def state(self) -> dict:
        try:
            rows = self.spark.read.schema(self.RECORD).json(f"{self.root}/records")
            row = rows.agg(F.max(F.struct("seq", "next", "run", "texts", "lists")).alias("r")).first()["r"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return row.asDict() if row else {"seq": 0, "next": 0, "run": 0, "texts": [], "lists": []}

    def _write(self, df: DataFrame, what: str) -> str:
        path = f"{self.root}/{what}/{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", 8_000_000).parquet(path)
        return path

    def add(self, texts: DataFrame) -> None:
        """texts: (kind, id, field, text), each key once."""
        was = self.state()
        rows = texts.where(F.col("text").isNotNull()).select("kind", F.col("id").cast("string").alias("id"), "field", "text")
        parted = in_ranges(rows.withColumn("_k", F.struct("kind", "id", "field")), "_k")
        counts = sorted((r["_p"], r["n"]) for r in parted.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
        starts, start = [], was["next"]
        for p, n in counts:
            starts.append((p, start))
            start += n
        if not starts:
            return
        first = F.broadcast(self.spark.createDataFrame(starts, "_p int, _start long"))
        nth = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
        run = was["run"] + 1
        numbered = parted.join(first, "_p").withColumn("no", F.col("_start") + nth - 1).withColumn("run", F.lit(run).cast("long"))
        # folded behind the sampling of ranges, which would fold all texts once more
        path = self._write(numbered.sortWithinPartitions("no").select("no", "run", "kind", "id", "field", "text", fold(F.col("text")).alias("folded")), "texts")
        stored = self.spark.read.schema(TEXTS).parquet(path)
        # the trigrams of a task's texts come as parts of lists, not as a row for each text and trigram; a list holds as many numbers as
        # a block at most
        parts = stored.select("no", "folded").mapInArrow(_lists(BLOCK, CHARS), "gram string, block long, places array<int>")
        places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))
        lists = parts.groupBy("gram", "block").agg(F.transform(places, lambda x: F.col("block") * BLOCK + x).alias("numbers"))
        kept = [*was["lists"], self._write(self._sorted(lists), "lists")]
        if len(kept) > self.fanout:  # runs share at most one block of numbers with the next
            merged = self.spark.read.schema(LISTS).parquet(*kept).groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"))
            kept = [self._write(self._sorted(merged), "lists")]
        row = (was["seq"] + 1, start, run, [*was["texts"], path], kept)
        self.spark.createDataFrame([row], self.RECORD).coalesce(1).write.mode("append").json(f"{self.root}/records")

    def _sorted(self, lists: DataFrame) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return lists.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block")

    def candidates(self, needle: str) -> DataFrame:
        """(no) of texts that have all trigrams of a folded needle."""
        grams, was = trigrams(needle), self.state()
        hits = self.spark.read.schema(LISTS).parquet(*was["lists"]).where(F.col("gram").isin(*grams))
        # a block's list may lie in two runs
        whole = hits.groupBy("gram", "block").agg(F.flatten(F.collect_list("numbers")).alias("numbers"))
        met = whole.groupBy("block").agg(F.collect_list("numbers").alias("x")).where(F.size("x") == len(grams))
        both = F.aggregate(F.slice("x", 2, len(grams)), F.col("x")[0], lambda a, b: F.array_intersect(a, b))
        return met.select(F.explode(both).alias("no"))

    def search(self, needle: str) -> DataFrame:
        """(kind, id, field, text) of the texts that contain the needle."""
        was, folded = self.state(), fold_text(needle)
        if not was["texts"]:
            return self.spark.createDataFrame([], "kind string, id string, field string, text string")
        texts = self.spark.read.schema(TEXTS).parquet(*was["texts"])
        found = texts.where(F.contains("folded", F.lit(folded)))
        if len(folded) >= 3:
            found = texts.join(self.candidates(folded), "no", "left_semi").where(F.contains("folded", F.lit(folded)))
        if len(was["texts"]) > 1:  # of a key that came again only the newest counts
            newest = texts.join(found.select("kind", "id", "field").distinct(), ["kind", "id", "field"], "left_semi")
            newest = newest.groupBy("kind", "id", "field").agg(F.max("run").alias("run"))
            found = found.join(newest, ["kind", "id", "field", "run"], "left_semi")
        return found.select("kind", "id", "field", "text")


def entity_texts(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(kind, id, field, text) of the text columns of several tables: kind -> (frame, id, columns)."""
    out = None
    for kind, (df, key, columns) in tables.items():
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])
        part = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.explode(cells).alias("x")).select("kind", "id", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def sentence_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, id, field, text) of the sentences of documents; the field is the sentence's number."""
    from .facts import sentences

    each = docs.select(F.col(key).cast("string").alias("id"), F.posexplode(sentences(F.coalesce(F.col(text), F.lit("")))).alias("no", "text"))
    return each.select(F.lit("sentence").alias("kind"), "id", F.col("no").cast("string").alias("field"), "text")
