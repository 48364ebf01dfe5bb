"""An inverted index kept up by batches: segments that are written once, marks for what is gone, and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ordering import checkpointed, removed, small_or_shuffled
from docloom.operators.search import _ranked, counted_terms, n_postings, once, postings_of, query_terms, write_sorted

#: Newest segments are merged as long as the next older one has at most so many times their rows together.
MERGE_FACTOR = 1.0


class SegmentIndex:
    """A full-text index in the folder ``index``: ``postings`` and ``documents`` of each segment, and numbered manifests.

    A segment covers the batches from ``low`` to ``high`` and is never changed. Its ``documents`` (doc, n_tokens, segment)
    hold what a batch put in, and rows without n_tokens for what it took out; the row of the newest segment counts.
    A manifest lists the segments that count, with the number and tokens of the documents that are in the index then;
    it is the last thing an update writes, so an update that fails leaves the index as it was, and readers go on with
    the manifest they read. Folders that a merge replaced go with the next update. One update runs at a time.
    """

    def __init__(self, spark: SparkSession, index: str, doc: str = "doc_id", text: str = "text"):
        self.spark, self.index, self.doc, self.text = spark, index, doc, text
        self.version, self.segments, self.totals = 0, [], Row(n_docs=0, n_tokens=0)
        self._load()

    def _load(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.index}/manifest/*/_SUCCESS")
        complete = found.getFileSystem(conf).globStatus(found)
        self.version = max((int(s.getPath().getParent().getName()) for s in complete), default=0)
        if self.version:
            rows = self.spark.read.parquet(f"{self.index}/manifest/{self.version}").orderBy("low").collect()  # logarithm of the batches
            self.segments, self.totals = [r for r in rows if r["low"] >= 0], next(r for r in rows if r["low"] < 0)

    def _commit(self, segments: list, n_docs: int, n_tokens: int) -> None:
        rows = [(-1, -1, 0, True, n_docs, n_tokens), *((s["low"], s["high"], s["n_rows"], s["counts"], 0, 0) for s in segments)]
        kind = "low long, high long, n_rows long, counts boolean, n_docs long, n_tokens long"
        self.version += 1
        self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{self.index}/manifest/{self.version}")
        if self.version > 2:
            removed(self.spark, f"{self.index}/manifest/{self.version - 2}")
        self._load()

    def _read(self, what: str, segments: list) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.index}/{what}/{s['low']}_{s['high']}" for s in segments])

    def _written(self, low: int, high: int, terms: DataFrame, most: int, documents: DataFrame) -> Row:
        stamp = F.lit(high).cast("long").alias("segment")
        write_sorted(terms.select("term", self.doc, "tf", stamp), most, f"{self.index}/postings/{low}_{high}", self.doc)
        documents.select(self.doc, "n_tokens", stamp).write.mode("overwrite").parquet(f"{self.index}/documents/{low}_{high}")
        n = self.spark.read.parquet(f"{self.index}/documents/{low}_{high}").count()
        return Row(low=low, high=high, n_rows=n, counts=True)

    def _counting(self) -> list:
        return [s for s in self.segments if s["counts"]]

    def _newest(self, documents: DataFrame) -> DataFrame:
        """(doc, n_tokens, segment) of each document's newest row."""
        return documents.groupBy(self.doc).agg(F.max(F.struct("segment", "n_tokens")).alias("_d")).select(self.doc, "_d.n_tokens", "_d.segment")

    def update(self, batch: int, put: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
        """Puts documents (doc, text) in, in place of those of the same id, and takes out the ids in ``gone`` (doc).

        Batches are numbered upwards from 0. One that was applied before changes nothing and gives false, so a stream's
        ``foreachBatch`` may call this again after a failure. Of rows with one id the one with the largest text stays;
        an id that is both put and gone is put. Null ids are left out; a null text is an empty one. What is written is
        in proportion to the batch, and once in a while to the segments that are merged with it.
        """
        if any(s["high"] >= batch for s in self.segments):
            return False
        for s in self.segments:
            if not s["counts"]:
                for what in ("postings", "documents"):
                    removed(self.spark, f"{self.index}/{what}/{s['low']}_{s['high']}")
        counting = self._counting()
        kind = next(d.schema[self.doc].dataType.simpleString() for d in (put, gone) if d is not None)
        put = self.spark.createDataFrame([], f"`{self.doc}` {kind}, `{self.text}` string") if put is None else put
        counted_terms(once(put.where(F.col(self.doc).isNotNull()), self.doc, self.text), self.doc, self.text).write.mode("overwrite").parquet(f"{self.index}/counted")
        new = self.spark.read.parquet(f"{self.index}/counted")
        documents = new.select(self.doc, F.col("n_tokens").cast("long").alias("n_tokens"))
        if gone is not None:
            out = gone.select(self.doc).where(F.col(self.doc).isNotNull()).distinct().join(new.select(self.doc), self.doc, "left_anti")
            documents = documents.unionByName(out.withColumn("n_tokens", F.lit(None).cast("long")))
        documents = checkpointed(documents)
        before = Row(n=0, t=0)
        if counting:
            touched = self._read("documents", counting).join(small_or_shuffled(documents.select(self.doc)), self.doc, "left_semi")
            before = self._newest(touched).agg(F.count("n_tokens").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
        added = documents.agg(F.count("n_tokens").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
        segments = [*counting, self._written(batch, batch, postings_of(new, self.doc), n_postings(new), documents)]
        removed(self.spark, f"{self.index}/counted")
        segments = [*self._merged(segments)]
        self._commit(segments, self.totals["n_docs"] - before["n"] + added["n"], self.totals["n_tokens"] - before["t"] + added["t"])
        return True

    def _merged(self, segments: list) -> list:
        """The segments after a merge of the newest, where they have grown enough; the replaced ones do not count any more."""
        j = len(segments) - 1
        rows = segments[j]["n_rows"]
        while j > 0 and segments[j - 1]["n_rows"] <= MERGE_FACTOR * rows:
            j -= 1
            rows += segments[j]["n_rows"]
        old = segments[j:]
        if len(old) < 2:
            return segments
        newest = checkpointed(self._newest(self._read("documents", old)))
        kept = newest if j else newest.where("n_tokens IS NOT NULL")  # marks are of use only to older segments
        terms = self._read("postings", old).join(newest.where("n_tokens IS NOT NULL").select(self.doc, "segment"), [self.doc, "segment"])
        merged = self._written(old[0]["low"], old[-1]["high"], terms, self._read("postings", old).count(), kept)
        return [*segments[:j], merged, *(Row(low=s["low"], high=s["high"], n_rows=s["n_rows"], counts=False) for s in old)]

    def search(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc, rank) as ``search.bm25`` gives them over the documents that are in the index now.

        The terms are pushed down to the postings' scans. Only documents that hold one of them are looked up among the
        segments' documents; the number and mean length of all come from the manifest.
        """
        counting, terms = self._counting(), query_terms(self.spark, query)
        if not counting or not terms or not self.totals["n_docs"]:
            return self.spark.createDataFrame([], f"`{self.doc}` {self._read('documents', counting).schema[self.doc].dataType.simpleString() if counting else 'long'}, rank double")
        names = [f"_c{i}" for i in range(len(terms))]
        own = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(c) for c, t in zip(names, terms, strict=True)]
        hits = checkpointed(self._read("postings", counting).where(F.col("term").isin(terms)).groupBy(self.doc, "segment").agg(*own))
        newest = self._newest(self._read("documents", counting).join(small_or_shuffled(hits.select(self.doc).distinct()), self.doc, "left_semi"))
        live = checkpointed(hits.join(newest.where("n_tokens IS NOT NULL"), [self.doc, "segment"]))
        found = live.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).first()
        totals = Row(n_all=self.totals["n_docs"], avg_tokens=self.totals["n_tokens"] / self.totals["n_docs"], **found.asDict())
        return _ranked(live.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in names])), names, totals, self.doc, k, k1, b)
