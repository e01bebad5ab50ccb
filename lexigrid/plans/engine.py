"""The engine: build an index of a folder, ask questions, search, report.

``Generator``: ``generate(system, prompt) -> str``. Without one, an offline generator
quotes the best excerpt; it makes no claim to a model's answers.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.functions import answers as A
from lexigrid.functions.text import preview
from lexigrid.operators import blocks, cells, chunking, fusion, graph, lexical, reports, vector
from lexigrid.sources import files, store

RAW = "question_id int, question string, context string, raw string, error string"


class Generator(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


class ExcerptGenerator:
    """Quotes the first excerpt and names its source."""

    def generate(self, system: str, prompt: str) -> str:
        import json
        import re

        found = re.search(r"Source: (.*) \| Page: (\d+)\n(.*)", prompt)
        if not found:
            return "The excerpts hold no answer."
        source = {"document": found[1], "page": int(found[2]), "evidence": found[3][:300]}
        return f"{found[3][:300]} ({found[1]}, p.{found[2]})\n```json\n{json.dumps({'sources': [source]}, ensure_ascii=False)}\n```"


def select_generator(adapters: dict[str, Callable[[], Generator]], prefer_openai: bool = False) -> Generator:
    """OpenAI if asked for, then Gemini, else an error; adapters are made when chosen."""
    for name in (("openai",) if prefer_openai else ()) + ("gemini",):
        if name in adapters:
            return adapters[name]()
    raise LookupError("no generator is configured")


def _generate(make: Callable[[], Generator], workers: int):
    def run(batches):
        generator = make()

        def one(row):
            _, question, context = row
            try:
                return generator.generate(A.SYSTEM_PROMPT, f"DOCUMENT EXCERPTS:\n\n{context}\n\nQUESTION: {question}"), None
            except Exception as error:  # one question's failure leaves the others alone
                return None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                made = list(pool.map(one, rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())],
                    ["question_id", "question", "context", "raw", "error"],
                )

    return run


def generate_answers(contexts: DataFrame, make: Callable[[], Generator] = ExcerptGenerator, workers: int = 5, mode: str = "v2") -> DataFrame:
    """``question_id, question, answer, sources, raw, error`` from ``question_id, question, context``."""
    raw = contexts.select(F.col("question_id").cast("int"), "question", F.coalesce("context", F.lit("")).alias("context")).mapInArrow(_generate(make, workers), RAW)
    failed = F.col("error").isNotNull()
    return raw.select(
        "question_id",
        "question",
        F.when(failed, F.concat(F.lit("[ERROR] "), "error")).otherwise(A.strip_json(F.col("raw"))).alias("answer"),
        F.when(failed, F.array().cast(A.SOURCE)).otherwise(A.parse_sources(F.col("raw"), mode)).alias("sources"),
        "raw",
        "error",
    )


class Engine:
    """One index folder. ``build`` is skipped where a manifest says it is built.

    ``extractors``: kind of file -> ``bytes -> [(text, tables)]``, beside or instead of the
    own ones (a PDF reader, with OCR and tables, goes here). ``embedder``: column of texts ->
    column of vectors, known to the embedding cache by the name ``model``. ``make_encoder``:
    the encoder of token chunks. ``adapters``: embedders by name ("gemini", "openai", "local"),
    of which one is chosen where no ``embedder`` is given; its name is the model's.
    """

    def __init__(
        self,
        spark: SparkSession,
        index: str,
        config: EngineConfig | None = None,
        make_generator: Callable[[], Generator] = ExcerptGenerator,
        stopwords: tuple[str, ...] = (),
        extractors: dict | None = None,
        embedder: Callable | None = None,
        model: str = "hashed",
        make_encoder: Callable[[], object] = chunking.WordEncoder,
        adapters: dict[str, Callable] | None = None,
        prefer_openai: bool = False,
    ) -> None:
        if embedder is None and adapters:
            model, embedder = vector.select_embedder(adapters, prefer_openai)
        if (embedder is None) != (model == "hashed"):
            raise ValueError("an embedder has a model name of its own")
        self.extractors, self.embedder, self.model, self.make_encoder = extractors, embedder, model, make_encoder
        self.building = threading.Lock()
        self.told: list[str] = []
        self.spark, self.index, self.config = spark, index.rstrip("/"), config or EngineConfig()
        self.make_generator, self.stopwords = make_generator, stopwords
        self.timings: list[tuple[str, float]] = []

    def _timed(self, stage: str, work: Callable):
        self.told.append(f"{stage} ...")
        began = time.perf_counter()
        out = work()
        self.timings.append((stage, time.perf_counter() - began))
        self.told.append(f"{stage}: {self.timings[-1][1]:.1f} s")
        return out

    def _parts(self, kind: str) -> dict[str, DataFrame]:
        return store.load_tables(self.spark, f"{self.index}/{kind}", kind)

    def ready(self) -> bool:
        return all(store.read_manifest(self.spark, f"{self.index}/{kind}") for kind in ("corpus", "lexical", "dense"))

    def build(self, folder: str, strategy: str = "page", force: bool = False, fast: bool = False) -> dict:
        """Pages, chunks, postings, embeddings and the graph of a folder; refused while another build runs."""
        if not force and self.ready():
            return self.status()
        if not self.building.acquire(blocking=False):
            raise RuntimeError("a build is already running")
        self.told = []
        try:
            self._build(folder, strategy, fast)
            self.told.append("__DONE__")
        except BaseException as error:
            self.told += [f"{type(error).__name__}: {error}", "__ERROR__"]
            raise
        finally:
            self.building.release()
        return self.status()

    def _build(self, folder: str, strategy: str, fast: bool) -> None:
        began = time.perf_counter()
        pages, bad = files.ingest(self.spark, folder, self.config, self.extractors)
        self._timed("ingestion", lambda: store.save_tables(f"{self.index}/pages", "pages", {"pages": pages, "quarantine": bad}))
        pages = self._parts("pages")["pages"]
        chunks = chunking.chunk_all(pages, strategy, self.config, make_encoder=self.make_encoder)
        self._timed("chunking", lambda: store.save_tables(f"{self.index}/corpus", "corpus", {"chunks": chunks.withColumn("number", F.monotonically_increasing_id())}, strategy=strategy))
        chunks = self._parts("corpus")["chunks"]
        tokens = lexical.token_table(chunks, self.stopwords, number="number")
        tables = lexical.index_tables(tokens)
        if self.config.BLOCK_SEARCH:
            tables["blocks"] = blocks.block_table(tokens)
        self._timed("bm25_index", lambda: store.save_tables(f"{self.index}/lexical", "lexical", tables, stopwords=list(self.stopwords)))
        if not fast:
            self._timed("vector_index", lambda: self._embed(chunks, began))
        nodes, edges = graph.citation_graph(pages, number="page_number", order="corpus_ord")
        tables = {"nodes": graph.merge_nodes(nodes), "edges": graph.merge_edges(edges)}
        self._timed("graph", lambda: store.save_tables(f"{self.index}/graph", "graph", tables))

    def _embed(self, chunks: DataFrame, began: float) -> None:
        """Vectors of all chunks, in a folder of their own, so what the cache has is read while they are written."""
        dense, version, cached = f"{self.index}/dense", 0, None
        held = store.read_manifest(self.spark, dense)
        if held:
            version, cached = held["version"] + 1, self._dense()
        made = store.cached_embeddings(chunks, cached, self.model, lambda rows: vector.embed_texts(rows, dim=self.config.EMBEDDING_DIM, embedder=self.embedder))
        store.save_tables(f"{dense}/v{version}", "vectors", {"embeddings": made}, model=self.model)
        if self.config.VECTOR_CELLS:
            made = cells.index_tables(self._dense(version).select("chunk_id", "vec"), "chunk_id", "vec", max(0, self.config.VECTOR_CELLS) or None)
            store.save_tables(f"{dense}/v{version}/cells", "cells", made, model=self.model)
        facts = self.spark.createDataFrame([(version, self.model)], "version int, model string")
        store.save_tables(dense, "dense", {"versions": facts}, version=version, model=self.model, dim=self.config.EMBEDDING_DIM, cells=bool(self.config.VECTOR_CELLS), seconds=time.perf_counter() - began)
        if version > 1:  # searches that began before this build may still read the last one
            store.remove(self.spark, f"{dense}/v{version - 2}")

    def _dense(self, version: int | None = None) -> DataFrame:
        if version is None:
            version = store.read_manifest(self.spark, f"{self.index}/dense")["version"]
        return store.load_tables(self.spark, f"{self.index}/dense/v{version}", "vectors")["embeddings"]

    def _sparse_hits(self, questions: DataFrame, k: int) -> DataFrame:
        index = self._parts("lexical")
        search = blocks.search if "blocks" in index else lexical.indexed_search
        return search(index, questions, k, self.stopwords)

    def _dense_hits(self, asked: DataFrame, k: int) -> DataFrame:
        held = store.read_manifest(self.spark, f"{self.index}/dense")
        if not held.get("cells"):
            return vector.vector_search(self._dense().select("chunk_id", "vec"), asked, k, "chunk_id", "vec")
        index = store.load_tables(self.spark, f"{self.index}/dense/v{held['version']}/cells", "cells")
        return cells.search(index, asked, k, probes=self.config.VECTOR_PROBES or None)

    def build_events(self, folder: str, every: float = 0.2, ping: float = 30.0, **options) -> Iterator[str]:
        """Runs a build and tells its progress, line by line, with pings while it is silent; the last line is ``__DONE__`` or ``__ERROR__``."""
        if self.building.locked():
            raise RuntimeError("a build is already running")
        worker, at, quiet = threading.Thread(target=self._quietly, args=(folder, options), daemon=True), 0, time.monotonic()
        self.told = []
        worker.start()
        while worker.is_alive() or at < len(self.told):
            if at < len(self.told):
                line, at, quiet = self.told[at], at + 1, time.monotonic()
                yield line
                if line in ("__DONE__", "__ERROR__"):
                    return
            elif time.monotonic() - quiet >= ping:
                yield "__PING__"
                quiet = time.monotonic()
            else:
                worker.join(every)
        yield "__DONE__"  # there was nothing to build

    def _quietly(self, folder: str, options: dict) -> None:
        try:
            self.build(folder, **options)
        except Exception:  # the last line says so
            if not self.told or self.told[-1] != "__ERROR__":
                self.told.append("__ERROR__")

    def status(self) -> dict:
        dense = store.read_manifest(self.spark, f"{self.index}/dense")
        built = store.read_manifest(self.spark, f"{self.index}/corpus")
        if not built:
            return {"ready": False, "documents": 0, "chunks": 0, "build_seconds": None}
        return reports.index_status(self._parts("corpus")["chunks"], self.ready(), dense["seconds"] if dense else None).first().asDict()

    def documents(self, folder: str) -> DataFrame:
        return files.list_documents(self.spark, folder, self.config)

    def retrieve(self, questions: DataFrame, fast: bool = False) -> DataFrame:
        """Ranked chunks of ``question_id, question``; ``fast`` asks the lexical index alone."""
        chunks = self._parts("corpus")["chunks"].drop("corpus_ord", "number")
        if fast or not store.read_manifest(self.spark, f"{self.index}/dense"):
            return fusion.fetch_chunks(self._sparse_hits(questions, self.config.FINAL_TOPK), chunks)
        asked = vector.embed_texts(questions, "question_id", "question", self.config.EMBEDDING_DIM, self.embedder).select(F.col("chunk_id").alias("question_id"), F.col("vec").alias("query_vec"))
        dense, sparse = self._dense_hits(asked, self.config.ANN_TOPK), self._sparse_hits(questions, self.config.BM25_TOPK)
        return fusion.hybrid_retrieve(sparse, dense.withColumnRenamed("vec_id", "chunk_id"), chunks, self.config.RRF_K, self.config.FINAL_TOPK)

    def ask(self, questions: DataFrame, fast: bool = False, scorer: Callable | None = fusion.overlap_score, mode: str = "v2") -> DataFrame:
        """Answers with sources; a question whose text is blank is refused."""
        if questions.where(F.trim("question") == "").limit(1).count():
            raise ValueError("a question is empty")
        hits = fusion.rerank(self.retrieve(questions, fast), questions, self.config.RERANK_TOPK, scorer)
        context = A.build_context(hits, passages=self.config.LLM_CONTEXT_PASSAGES)
        return generate_answers(questions.join(context, "question_id", "left"), self.make_generator, self.config.LLM_CONCURRENCY, mode)

    def boolean(self, query: str) -> DataFrame:
        return lexical.indexed_boolean(self._parts("lexical"), query, self.stopwords).orderBy("corpus_ord")

    def proximity(self, first: str, second: str, distance: int = 10) -> DataFrame:
        return lexical.indexed_proximity(self._parts("lexical"), first, second, distance, self.stopwords).orderBy("corpus_ord")

    def answer_events(self, question: str, fast: bool = False) -> Iterator[dict]:
        """What a client of one question is told, in order; retrieval runs once."""
        try:
            if not question.strip():
                raise ValueError("the question is empty")
            asked = self.spark.createDataFrame([(1, question.strip())], "question_id int, question string")
            hits = self.retrieve(asked, fast).orderBy("rank").select("chunk_id", "doc", "page", "score", "rank", "text", preview(F.col("text")).alias("preview")).collect()
            for hit in hits:
                yield {"type": "chunk", **{k: v for k, v in hit.asDict().items() if k != "text"}}
            table = self.spark.createDataFrame([(1, *h[:3], h["rank"], h["text"]) for h in hits], "question_id int, chunk_id string, doc string, page int, rank int, text string")
            context = A.build_context(table, passages=self.config.LLM_CONTEXT_PASSAGES)
            answer = generate_answers(asked.join(context, "question_id", "left"), self.make_generator).first()
            if answer["error"]:
                raise RuntimeError(answer["error"])
            yield {"type": "answer", "text": answer["answer"]}
            yield {"type": "sources", "sources": [s.asDict() for s in answer["sources"]]}
            yield {"type": "done"}
        except Exception as error:
            yield {"type": "error", "message": str(error)}

    def report(self) -> DataFrame:
        timings = self.spark.createDataFrame(self.timings or [("none", 0.0)], "stage string, seconds double")
        return reports.bottleneck_report(timings, limit=self.config.RUNTIME_LIMIT_SECONDS)
