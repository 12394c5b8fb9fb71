"""Semantic graph and provenance graph over plain DataFrames (edges: id, src, dst, relation, created_at)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators.catalogue import keyset_page, records_for


def touching(edges: DataFrame, nodes: DataFrame, id_: str = "id", both: bool = False) -> DataFrame:
    """Edges with either (or both) endpoints among nodes, by hash semi-joins on one endpoint at a time, never an OR join."""
    n = nodes.select(F.col(id_).alias("_n")).distinct()
    src = edges.join(n, edges["src"] == n["_n"], "left_semi")
    if both:
        return src.join(n, src["dst"] == n["_n"], "left_semi")
    other = edges.join(n, edges["src"] == n["_n"], "left_anti")
    return src.unionByName(other.join(n, other["dst"] == n["_n"], "left_semi"))


def neighbours(edges: DataFrame, entities: DataFrame, centre: str, limit: int, type_: str | None = None) -> DataFrame:
    """The page of the centre's edges first, then the other endpoints; the type filter comes after the page, which may so be short."""
    page = keyset_page(edges.where((F.col("src") == centre) | (F.col("dst") == centre)), "created_at", "id", limit, overflow=False)
    page = page.withColumn("other", F.when(F.col("src") == centre, F.col("dst")).otherwise(F.col("src")))
    out = page.join(entities.select(F.col("id").alias("other"), "type", "label"), "other")
    return out.where(F.col("type") == type_) if type_ else out


def lexical_roots(entities: DataFrame, edges: DataFrame, needle: str, type_: str | None = None, relation: str | None = None) -> DataFrame:
    """Entities by type, by text in label or external id, and by EXISTS an edge of the relation at either end."""
    hit = F.contains(F.lower("label"), F.lit(needle.casefold())) | F.contains(F.lower("external_id"), F.lit(needle.casefold()))
    roots = entities.where(hit)
    if type_:
        roots = roots.where(F.col("type") == type_)
    if relation:
        ends = edges.where(F.col("relation") == relation).select(F.explode(F.array("src", "dst")).alias("_e")).distinct()
        roots = roots.join(ends, roots["id"] == ends["_e"], "left_semi")
    return roots


def expand(roots: DataFrame, edges: DataFrame, limit: int, relation: str | None = None) -> DataFrame:
    """Edges of the roots: with a relation either endpoint suffices, without one both must be roots. Newest limit."""
    found = touching(edges.where(F.col("relation") == relation), roots) if relation else touching(edges, roots, both=True)
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def edge(rows: DataFrame, source: str, relation: str, target: str) -> DataFrame:
    ends = rows.select(F.expr(source).alias("source"), F.lit(relation).alias("relation"), F.expr(target).alias("target")).where("source is not null and target is not null")
    return ends.withColumn("id", F.concat_ws(":", "source", "relation", "target"))


def projection(edges: list[DataFrame]) -> DataFrame:
    """Union of edge projections, one row per id."""
    return reduce(DataFrame.unionByName, edges).dropDuplicates(["id"])


def loaded_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose endpoints are loaded, once per id; parallel edges stay."""
    return touching(edges, nodes, both=True).dropDuplicates(["id"])


def neighbourhood(edges: DataFrame, entities: DataFrame, centre: str, limit: int, type_: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The page of the centre's edges with known other ends, and its nodes: the centre and those ends, once each."""
    found = neighbours(edges, entities, centre, limit, type_)
    nodes = entities.where(F.col("id") == centre).select("id", "type", "label").unionByName(found.select(F.col("other").alias("id"), "type", "label")).distinct()
    return found, nodes


def query_graph(entities: DataFrame, edges: DataFrame, needle: str, limit: int, type_: str | None = None, relation: str | None = None, cursor: tuple | None = None) -> dict[str, DataFrame]:
    """roots (a page, newest first), edges (newest limit of those that expand the roots, with `truncated` if there were more), nodes (roots and
    the ends of the edges) and expansions (every root if edges were truncated). entities need created_at."""
    roots = keyset_page(lexical_roots(entities, edges, needle, type_, relation), "created_at", "id", limit, cursor, overflow=False)
    ids = roots.select("id")
    more = expand(ids, edges, limit + 1, relation)
    total = more.agg((F.count(F.lit(1)) > limit).alias("truncated"))  # one row
    kept = more.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).join(F.broadcast(total))
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).union(ids).distinct()
    nodes = entities.join(ends, "id", "left_semi")
    expansions = ids.join(F.broadcast(total)).where("truncated").select("id")
    return {"roots": roots, "edges": kept, "nodes": nodes, "expansions": expansions}


#: Child collections of a run: their table, the time that orders them, and their edge to the run.
CHILDREN = {"stages": ("created_at", "stage", "part_of"), "artifacts": ("created_at", "artifact", "artifact_of"), "metrics": ("created_at", "metric", "reported_for"), "reviews": ("recorded_at", "review", "reviews")}


def provenance(tables: dict[str, DataFrame], limit: int, run_id=None, product_id=None, cursor: tuple | None = None) -> dict[str, DataFrame]:
    """Provenance of some runs as nodes (id, kind), edges (id, source, relation, target) and truncated (collection): what foreign keys tell, nothing stored.

    Roots are one run, the newest page of a product's runs, or the newest page of all. Of each child collection only the newest `limit` rows of
    all roots together are shown; an artifact names its stage only if that stage is among those shown. tables: runs (id, created_at, owner,
    source_product_id, reference_product_id), products (id, owner), subjects (id), stages, artifacts (with run_stage_id), metrics and reviews (with actor), each with id and run_id."""
    runs = tables["runs"]
    if run_id is not None:
        roots = runs.where(F.col("id") == F.lit(run_id))
    else:
        if product_id is not None:
            runs = runs.where((F.col("source_product_id") == F.lit(product_id)) | (F.col("reference_product_id") == F.lit(product_id)))
        roots = keyset_page(runs, "created_at", "id", limit, cursor, overflow=False)
    used = roots.select(F.explode(F.array("source_product_id", "reference_product_id")).alias("id"))
    if product_id is not None:
        used = used.union(tables["products"].where(F.col("id") == F.lit(product_id)).select("id"))
    products = tables["products"].join(used.distinct(), "id", "left_semi")
    keys = roots.select(F.col("id").alias("run_id"))
    children = {name: records_for(tables[name], "run_id", keys, ts, "id", limit) for name, (ts, _, _) in CHILDREN.items()}
    owners = products.select("owner").union(roots.select("owner")).union(children["reviews"].select("actor")).distinct()
    subjects = tables["subjects"].join(owners.select(F.col("owner").alias("id")), "id", "left_semi")

    def name(kind: str, column: str) -> str:
        return f"'{kind}:' || {column}"

    shown = children["stages"].select(F.col("id").alias("run_stage_id"))
    edges = [
        edge(products, name("product", "id"), "owned_by", name("subject", "owner")),
        edge(roots, name("run", "id"), "owned_by", name("subject", "owner")),
        edge(roots, name("run", "id"), "uses_source", name("product", "source_product_id")),
        edge(roots, name("run", "id"), "uses_reference", name("product", "reference_product_id")),
        *[edge(children[c], name(kind, "id"), relation, name("run", "run_id")) for c, (_, kind, relation) in CHILDREN.items()],
        edge(children["artifacts"].join(shown, "run_stage_id", "left_semi"), name("artifact", "id"), "produced_by", name("stage", "run_stage_id")),
        edge(children["reviews"], name("review", "id"), "submitted_by", name("subject", "actor")),
    ]
    kinds = {"subject": subjects, "product": products, "run": roots, **{kind: children[c] for c, (_, kind, _) in CHILDREN.items()}}
    nodes = reduce(DataFrame.unionByName, [rows.select(F.expr(name(kind, "id")).alias("id"), F.lit(kind).alias("kind")) for kind, rows in kinds.items()])
    cut = reduce(DataFrame.unionByName, [rows.where("truncated").select(F.lit(c).alias("collection")).distinct() for c, rows in children.items()])
    return {"nodes": nodes.dropDuplicates(["id"]), "edges": projection(edges), "truncated": cut}
