"""The document graph as two tables; every question about it is one hop.

``nodes``: ``id, kind, name, doc, number, text, entity_type``; ``edges``: ``src, dst,
relation, seq``. Adding again merges: later attributes win, and of edges between the same
two nodes the last relation stays. Nodes that only an edge names have no attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions.citations import raw_citations

NODE = ("id", "kind", "name", "doc", "number", "text", "entity_type")


def doc_id(name: Column) -> Column:
    return F.concat(F.lit("doc:"), name)


def page_id(doc: Column, number: Column) -> Column:
    return F.concat(F.lit("page:"), doc, F.lit(":"), number.cast("string"))


def entity_id(text: Column) -> Column:
    return F.concat(F.lit("entity:"), F.lower(text))


def _node(rows: DataFrame, id_: Column, kind: str, keep: tuple[str, ...] = (), **attributes: Column) -> DataFrame:
    given = {"kind": F.lit(kind), **attributes}
    kinds = {"number": "int"}
    columns = [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODE[1:]]
    return rows.select(id_.alias("id"), *columns, *keep)


def _edge(rows: DataFrame, src: Column, dst: Column, relation: str, seq: Column | None = None) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"))


def add_documents(rows: DataFrame, name: str = "name") -> DataFrame:
    return _node(rows, doc_id(F.col(name)), "doc", name=F.col(name))


def add_pages(rows: DataFrame, doc: str = "doc", number: str = "number") -> tuple[DataFrame, DataFrame]:
    page = page_id(F.col(doc), F.col(number))
    return _node(rows, page, "page", doc=F.col(doc), number=F.col(number)), _edge(rows, doc_id(F.col(doc)), page, "has_page")


def add_parties(rows: DataFrame, doc: str = "doc", party: str = "party", seq: Column | None = None) -> tuple[DataFrame, DataFrame]:
    entity = entity_id(F.col(party))
    return _node(rows, entity, "entity", text=F.col(party), entity_type=F.lit("party")), _edge(rows, doc_id(F.col(doc)), entity, "party", seq)


def add_document_citations(rows: DataFrame, doc: str = "doc", cited: str = "cited", seq: Column | None = None) -> DataFrame:
    return _edge(rows, doc_id(F.col(doc)), doc_id(F.col(cited)), "cites", seq)


def add_references(rows: DataFrame, doc: str = "doc", entity: str = "entity", number: Column | None = None, seq: Column | None = None) -> DataFrame:
    return _edge(rows, entity_id(F.col(entity)), page_id(F.col(doc), number if number is not None else F.lit(0)), "appears_on", seq)


def citation_graph(pages: DataFrame, doc: str = "doc_name", number: str | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the citations in pages; ``number``: the page column, else page 0.

    With ``order``, the pages' order, nodes have a ``seq`` (page and place in it), so that what
    was said last of a node stays when they are merged.
    """
    page, at = F.col(number) if number else F.lit(0), F.col(order).cast("long") if order else F.lit(0).cast("long")
    found = pages.select(F.col(doc).alias("doc"), page.alias("page"), at.alias("at"), F.posexplode(raw_citations(F.col("text"))).alias("seq", "entity"))
    edges = add_references(found, number=F.col("page"), seq=F.col("seq"))
    of_entity = {"text": F.col("entity"), "entity_type": F.lit("legal_citation")}
    if not order:
        return add_documents(pages, doc).unionByName(_node(found, entity_id(F.col("entity")), "entity", **of_entity)), edges
    # A node's columns are made by name, so its time rides along as one more.
    said = found.withColumn("_seq", F.struct("at", "seq"))
    docs = pages.withColumn("_seq", F.struct(at.alias("at"), F.lit(-1).alias("seq")))
    timed = [
        _node(docs, doc_id(F.col(doc)), "doc", keep=("_seq",), name=F.col(doc)),
        _node(said, entity_id(F.col("entity")), "entity", keep=("_seq",), **of_entity),
    ]
    return timed[0].unionByName(timed[1]).withColumnRenamed("_seq", "seq"), edges


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge between two nodes: the relation of the greatest ``seq``."""
    last = F.max_by("relation", F.struct("seq", "relation"))
    return edges.groupBy("src", "dst").agg(last.alias("relation"), F.max("seq").alias("seq"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id; of each attribute the value added last, by ``seq`` where there is one.

    Values that are null add nothing; of values added together the greatest stays.
    """
    if "seq" not in nodes.columns:
        return nodes.groupBy("id").agg(*[F.max(c).alias(c) for c in NODE[1:]])
    return nodes.groupBy("id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c) for c in NODE[1:]])


def documents_citing(edges: DataFrame, name: str | None = None) -> DataFrame:
    """``cited, doc``: documents with an edge to a document."""
    found = edges.where(F.col("src").startswith("doc:") & F.col("dst").startswith("doc:"))
    found = found if name is None else found.where(F.col("dst") == f"doc:{name}")
    return found.select(F.substring("dst", 5, 1 << 30).alias("cited"), F.substring("src", 5, 1 << 30).alias("doc")).distinct()


def co_parties(edges: DataFrame, entity: str | None = None) -> DataFrame:
    """``entity, doc``: documents with an edge to an entity."""
    found = edges.where(F.col("src").startswith("doc:") & F.col("dst").startswith("entity:"))
    found = found if entity is None else found.where(F.col("dst") == f"entity:{entity.lower()}")
    return found.select(F.substring("dst", 8, 1 << 30).alias("entity"), F.substring("src", 5, 1 << 30).alias("doc")).distinct()


def entity_pages(edges: DataFrame, nodes: DataFrame, entity: str | None = None) -> DataFrame:
    """``entity, page_id, doc, number``: pages an entity appears on; ("", 0) for bare nodes."""
    found = edges.where(F.col("src").startswith("entity:") & F.col("dst").startswith("page:"))
    found = found if entity is None else found.where(F.col("src") == f"entity:{entity.lower()}")
    pages = nodes.where("kind = 'page'").select(F.col("id").alias("dst"), "doc", "number").distinct()
    return found.select("src", "dst").distinct().join(pages, "dst", "left").select(
        F.substring("src", 8, 1 << 30).alias("entity"), F.col("dst").alias("page_id"), F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("number", F.lit(0)).alias("number")
    )


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``nodes, edges, docs``; edge ends count as nodes."""
    ids = nodes.select("id", (F.col("kind") == "doc").alias("doc")).unionByName(edges.select(F.col("src").alias("id"), F.lit(False).alias("doc"))).unionByName(edges.select(F.col("dst").alias("id"), F.lit(False).alias("doc")))
    counted = ids.groupBy("id").agg(F.max("doc").alias("doc")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if("doc").alias("docs"))
    return counted.join(F.broadcast(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges")))).select("nodes", "edges", "docs")
