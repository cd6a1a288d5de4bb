"""The store of chunks: a corpus's upsert, prune and index become visible together, as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam import versions
from goldseam.config import EngineError, Settings
from goldseam.operators import embedding as N
from goldseam.operators import ingest as I
from goldseam.operators import vectors as V

SCHEMA = "corpus_id string, chunk_id string, source_doc string, chunk_index int, text string, start_char int, end_char int, vector array<double>"


class ChunkStore:
    """Versions of a chunk table and its vector index under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        return max(versions.commits(self.spark, self.root), default=0)

    def _path(self, number: int | None) -> str:
        number = self.version() if number is None else number
        if not number:
            raise EngineError(f"there is no store at {self.root}")
        return versions.folder(self.spark, self.root, number)

    def ensure(self, dims: int) -> int:
        """Make an empty store for vectors of so many numbers, unless there is one; EngineError if that has another number."""
        number = self.version()
        if number:
            there = self.spark.read.json(f"{self._path(number)}/meta").first()["dims"]
            if there != dims:
                raise EngineError(f"the store holds vectors of {there} numbers, not of {dims}")
            return number
        name, path = versions.staged(self.root)
        self._write(path, self.spark.createDataFrame([], SCHEMA), dims, 1)
        versions.commit(self.spark, self.root, 1, name)
        return 1

    def _write(self, path: str, chunks: DataFrame, dims: int, lists: int | None) -> None:
        """Chunks beside those that lie there already, then their index, which clusters what is there, then the facts about them."""
        chunks.write.mode("append").option("compression", "zstd").parquet(f"{path}/chunks")
        held = self.spark.read.schema(SCHEMA).parquet(f"{path}/chunks")
        V.build(held.select("chunk_id", "corpus_id", "vector"), lists, path=f"{path}/index")
        self.spark.createDataFrame([(dims,)], "dims int").coalesce(1).write.json(f"{path}/meta")

    def chunks(self, number: int | None = None) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self._path(number)}/chunks")

    def index(self, number: int | None = None) -> V.VectorIndex:
        return V.load(self.spark, f"{self._path(number)}/index")

    def ingest(self, docs: DataFrame, corpus: str, settings: Settings | None = None, embedder: N.Embedder = N.hashed, lists: int | None = None, dry_run: bool = False) -> DataFrame:
        """Make the corpus that of the documents (source_doc, text) and give the report of ingest_report().

        Chunks replace those of equal id, others are added, and chunks of the corpus
        that its documents no longer have go; other corpora stay.  A dry run reports
        and writes nothing.  What a failure leaves behind belongs to no version; a
        writer that another one has overtaken gets Conflict and may start again.
        """
        s = settings or Settings()
        cut = I.chunk_documents(docs, s.chunk_size, s.chunk_overlap)
        if dry_run:
            return I.ingest_report(cut)
        base = self.version()
        before = self.chunks(base)
        new = N.embed_chunks(cut, embedder).select(F.lit(corpus).alias("corpus_id"), "chunk_id", "source_doc", "chunk_index", "text", F.col("start_char").cast("int"), F.col("end_char").cast("int"), "vector")
        name, path = versions.staged(self.root)
        # sources have slugs of their own, so only one that comes twice has chunks of equal id
        twice = docs.groupBy("source_doc").count().where("count > 1").limit(1).count()
        at = f"{path}/new" if twice else f"{path}/chunks"
        new.where("chunk_id is not null").write.option("compression", "zstd").parquet(at)  # cut and embedded once
        new = self.spark.read.schema(SCHEMA).parquet(at)
        if taken := before.where(F.col("corpus_id") != corpus).join(new.select("chunk_id"), "chunk_id", "left_semi").first():
            raise EngineError(f"chunk {taken['chunk_id']} belongs to corpus {taken['corpus_id']}")
        dims = self.spark.read.json(f"{self._path(base)}/meta").first()["dims"]
        if other := new.where(F.size("vector") != dims).first():
            raise EngineError(f"chunk {other['chunk_id']} has a vector of {len(other['vector'])} numbers, not of {dims}")
        # what upsert and prune leave: of this corpus the new chunks, which lie there, and all of the others, none of whose ids is new
        others = before.where(F.col("corpus_id") != corpus)
        self._write(path, others.unionByName(new.dropDuplicates(["chunk_id"])) if twice else others, dims, lists)
        versions.commit(self.spark, self.root, base + 1, name)
        return I.ingest_report(self.chunks(base + 1).where(F.col("corpus_id") == corpus))
