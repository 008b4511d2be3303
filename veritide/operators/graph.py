"""The sourced entity graph: build, lookup, traversal. Vertices and edges are DataFrames.

vertices: entity_id, name, type, aliases, doc_ids. edges: subject_id, predicate, object_id, evidence, tier, confidence, qualifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.sources import store, tables

EDGE_KEY = ["subject_id", "predicate", "object_id", "evidence"]
#: Fixed: entity types that may seed an expansion; the shortest name; least confidence of an edge that may evict a hit.
SEED_TYPES = ["Character", "Faction", "Location", "Artifact", "Event", "Component"]
MIN_NAME, MIN_CONFIDENCE, MAX_NODES = 4, 1.0, 200


def merge_edges(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all edges, those that were new). An edge that is there already stays as it is."""
    added = new.join(existing, EDGE_KEY, "left_anti").dropDuplicates(EDGE_KEY)
    return existing.unionByName(added), added


def by_name(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """Vertices for names (column name), letter case aside."""
    return names.select(F.lower("name").alias("_k")).join(vertices.withColumn("_k", F.lower("name")), "_k").drop("_k")


def resolve(vertices: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ref) with entity_id and resolved: an id, a name's id, a name; else the slug, unresolved."""
    slug = F.when(F.col("ref").startswith("ent_"), F.col("ref")).otherwise(X.entity_id(F.col("ref")))
    ids = vertices.select(F.col("entity_id").alias("_id"))
    names = vertices.groupBy(F.lower("name").alias("_name")).agg(F.min("entity_id").alias("_by_name"))
    out = asked.withColumn("_slug", slug).join(ids, F.col("_slug") == F.col("_id"), "left").join(names, F.lower("ref") == F.col("_name"), "left")
    return out.select(*asked.columns, F.coalesce("_id", "_by_name", "_slug").alias("entity_id"), F.coalesce("_id", "_by_name").isNotNull().alias("resolved"))


def undirected(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of the given ids (entity_id) from either end; a self-loop stands twice. ``from_id`` is the given end."""
    outgoing = edges.join(ids, edges["subject_id"] == ids["entity_id"]).select(F.col("entity_id").alias("from_id"), F.col("object_id").alias("to_id"), *edges.columns)
    incoming = edges.join(ids, edges["object_id"] == ids["entity_id"]).select(F.col("entity_id").alias("from_id"), F.col("subject_id").alias("to_id"), *edges.columns)
    return outgoing.unionAll(incoming)


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, predicates: list[str] | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``hops`` of each seed (seed, entity_id). nodes: seed, entity_id, hop. Edges once each.

    A frontier a hop, with an anti-join on what was visited. max_nodes cuts by (hop, id) and sets ``truncated``.
    """
    if predicates:
        edges = edges.where(F.col("predicate").isin(predicates))
    links = edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).union(edges.select("object_id", "subject_id")).distinct()
    visited = seeds.select("seed", "entity_id", F.lit(0).alias("hop")).distinct()
    frontier, reached = visited, None
    for hop in range(1, hops + 1):
        ends = frontier.select("seed", "entity_id")
        around = edges.join(ends, edges["subject_id"] == ends["entity_id"]).unionAll(edges.join(ends, edges["object_id"] == ends["entity_id"])).drop("entity_id")
        reached = around if reached is None else reached.unionByName(around)
        step = ends.join(links, ends["entity_id"] == links["a"]).select("seed", F.col("b").alias("entity_id")).distinct()
        frontier = step.join(visited, ["seed", "entity_id"], "left_anti").withColumn("hop", F.lit(hop))
        visited = visited.unionByName(frontier)
    edges_out = reached.dropDuplicates(["seed", *EDGE_KEY])
    if max_nodes:
        w = Window.partitionBy("seed").orderBy("hop", "entity_id")
        total = F.count("*").over(Window.partitionBy("seed"))
        visited = visited.withColumn("_n", F.row_number().over(w)).withColumn("truncated", total > max_nodes).where(F.col("_n") <= max_nodes).drop("_n")
    return visited, edges_out


def reach(links: DataFrame, ends: DataFrame, radius: int) -> DataFrame:
    """target, node, dist: nodes within ``radius`` links of each target, each once. links: a, b, from either end; ends: target."""
    near = ends.select("target", F.col("target").alias("node"), F.lit(0).alias("dist")).distinct()
    edge = near
    for d in range(1, radius + 1):
        step = edge.join(links, F.col("node") == F.col("b")).select("target", F.col("a").alias("node")).distinct()
        edge = store.stored(step.join(near, ["target", "node"], "left_anti").withColumn("dist", F.lit(d)), "frontier")
        near = near.unionByName(edge)
    return near


def _both_ways(edges: DataFrame) -> DataFrame:
    """a, b, away, predicate, evidence: each link from either end, a self-loop once; ``away`` where it stands as it was given."""
    away = edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.lit(True).alias("away"), "predicate", "evidence")
    return away.unionByName(edges.where("subject_id <> object_id").select(F.col("object_id").alias("a"), F.col("subject_id").alias("b"), F.lit(False).alias("away"), "predicate", "evidence"))


def _step() -> Column:
    """What a link reads, put together where it has been met, so that links move without it."""
    return F.concat_ws(" ", F.when(F.col("away"), F.col("a")).otherwise(F.col("b")), F.concat(F.lit("-"), "predicate", F.lit("->")), F.when(F.col("away"), F.col("b")).otherwise(F.col("a")))


def _shortest(found: DataFrame, max_paths: int) -> DataFrame:
    w = Window.partitionBy("source", "target").orderBy("hops", F.array_join("steps", " | "), F.array_join("evidence", " | "))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_paths)


def paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 3, max_paths: int = 10) -> DataFrame:
    """Simple paths between pairs (source, target), undirected, shortest first: source, target, hops, steps, evidence, rank.

    From both ends: first the nodes around each target, by their distance, each once; then partial paths from the source, which take a
    step only to a node that is near enough to the target for the hops that are left. So a partial path that is kept can be
    completed but for the rule that no node comes twice. Links are met with the nodes around a target before paths take them: a path meets
    only links that lead on to its own target, never a hub's others; the nodes around a target are at most all nodes. Pairs that have max_paths are done: longer
    paths rank behind. A step reads ``subject -predicate-> object``; what is visited travels in an array. Paths of one step alone: direct().
    """
    both = _both_ways(edges)
    near = reach(both.select("a", "b").distinct(), pairs.select("target"), max_hops - 1).select(F.col("target").alias("_t"), F.col("node").alias("_n"), "dist")
    at = pairs.select("source", "target", F.col("source").alias("node"), F.array("source").alias("seen"), F.array().cast("array<string>").alias("steps"), F.array().cast("array<string>").alias("via"))
    found = None
    for hop in range(1, max_hops + 1):
        able = near.where(F.col("dist") <= max_hops - hop).drop("dist")
        on = _leaving(both, at.select("node")).join(able, F.col("b") == F.col("_n"))
        at = store.stored(
            at.join(on, (F.col("target") == F.col("_t")) & (F.col("node") == F.col("a")))
            .where(~F.array_contains("seen", F.col("b")))
            .select("source", "target", F.col("b").alias("node"), F.concat("seen", F.array("b")).alias("seen"), F.concat("steps", F.array(_step())).alias("steps"), F.concat("via", F.array("evidence")).alias("via")),
            "partial",
        )
        done = at.where("node = target").select("source", "target", F.lit(hop).alias("hops"), "steps", F.col("via").alias("evidence"))
        found = done if found is None else found.unionByName(done)
        full = found.groupBy("source", "target").count().where(F.col("count") >= max_paths).drop("count")
        at = at.where("node <> target").join(full, ["source", "target"], "left_anti")
    return _shortest(found, max_paths)


def direct(edges: DataFrame, pairs: DataFrame, max_paths: int = 10) -> DataFrame:
    """What paths() gives for one hop. Pairs meet links by both ends at once: a link moves once, and what follows by pair moves nothing again."""
    met = pairs.select("source", "target").where("source <> target").join(_leaving(_both_ways(edges), pairs.select("source")), (F.col("source") == F.col("a")) & (F.col("target") == F.col("b")))
    return _shortest(met.select("source", "target", F.lit(1).alias("hops"), F.array(_step()).alias("steps"), F.array("evidence").alias("evidence")), max_paths)


#: Nodes that are sent to all tasks at most, and bytes of their names.
TOLD, TOLD_BYTES = 1 << 20, 64 << 20


def _leaving(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links that leave the nodes (one column): where these are few they are sent to the links, which then do not move for it. Where they are many, all links: a join drops the rest."""
    own = store.stored(nodes.toDF("_at").where("_at IS NOT NULL").distinct(), "nodes")
    n = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("_at")).alias("size")).first()
    few = n["n"] <= TOLD and (n["size"] or 0) <= TOLD_BYTES
    return both.join(F.broadcast(own), F.col("a") == F.col("_at"), "left_semi") if few else both


def distinct_paths(found: DataFrame, max_paths: int = 10) -> DataFrame:
    """Paths with the same steps as one, their evidence together."""
    one = found.groupBy("source", "target", "hops", F.array_join("steps", " | ").alias("path")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), ",").alias("evidence"))
    w = Window.partitionBy("source", "target").orderBy("hops", "path")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_paths)


def named(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the names of both ends (the id where there is none) and a line of text."""
    names = vertices.select("entity_id", "name")
    out = edges.join(names.toDF("_s", "_sn"), F.col("subject_id") == F.col("_s"), "left").join(names.toDF("_o", "_on"), F.col("object_id") == F.col("_o"), "left")
    s, o = F.coalesce("_sn", "subject_id"), F.coalesce("_on", "object_id")
    tail = F.when(F.col("qualifier").isNotNull(), F.concat(F.lit(" ("), "qualifier", F.lit(")"))).otherwise("")
    return out.select(*edges.columns, s.alias("subject"), o.alias("object"), F.concat(s, F.lit(" -"), "predicate", F.lit("-> "), o, tail).alias("hop_text"))


def vocabulary(vertices: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities by name, with the number of all that fit; optionally of one type and a page of them."""
    rows = vertices.where(F.col("type") == kind) if kind else vertices
    rows = rows.withColumn("total", F.lit(rows.count())).orderBy("name", "entity_id")
    return rows.limit(limit) if limit else rows


def runs(texts: DataFrame, words: Column, names: DataFrame) -> DataFrame:
    """Every run of words of a text that is as long as some name, as rows: the columns of texts, at (from 1), form. names: form, n (its words).

    A run meets names by all its words at once, in one equi-join: no first word that many names share brings pairs.
    """
    #: One row: the lengths that names have.
    lengths = names.agg(F.collect_set("n").alias("_lengths"))
    each = texts.withColumn("_w", words).join(F.broadcast(lengths), how="left").withColumn("_n", F.explode("_lengths")).where(F.size("_w") >= F.col("_n"))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)
    cut = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.col("_n")), " "))
    return each.select(*texts.columns, F.posexplode(cut).alias("at", "form")).withColumn("at", F.col("at") + 1)


def mentions(texts: DataFrame, vertices: DataFrame, text: str = "query", key: str = "qid") -> DataFrame:
    """key, entity_id, name, at: entities whose name stands word by word in a text; longest names first, none within another.

    Runs of words meet the names in one equi-join, so rows grow with what is found, however many names begin alike. What follows it goes by text
    and entity, so tasks can share the runs of a word that all texts hold. Only a name's first place counts, as does an entity's first name that fits.
    """
    surfaces = vertices.where(F.col("type").isin(SEED_TYPES)).select("entity_id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "surface"), F.length("name").alias("len"))
    surfaces = surfaces.withColumn("form", X.words(F.col("surface"))).where((F.length("surface") >= MIN_NAME) & (F.length("form") >= MIN_NAME))
    forms = surfaces.select("entity_id", "nth", "len", "form", F.size(F.split("form", " ")).alias("n"))
    places = runs(texts.select(F.col(key), X.words(F.col(text)).alias("_text")), F.split("_text", " "), forms).drop("_text")
    each = places.join(forms, "form").groupBy(key, "entity_id").agg(F.min(F.struct("nth", "at", "n", "form", "len")).alias("m"))
    items = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("m.len")).alias("o"), "entity_id", F.col("m.at").alias("at"), (F.col("m.at") + F.col("m.n")).alias("to"), F.col("m.form").alias("form")))).alias("found"))
    inside = lambda acc, x: F.exists(acc, lambda c: (c["at"] <= x["at"]) & (x["to"] <= c["to"]))
    kept = F.aggregate("found", F.slice("found", 1, 0), lambda acc, x: F.when(inside(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return items.select(key, F.explode(kept).alias("m")).select(key, "m.entity_id", "m.form", "m.at")


def known_documents(vertices: DataFrame, first_chunks: DataFrame) -> DataFrame:
    """entity_id, docs: the documents of an entity that have chunks, in its order, as (doc_id, chunk_id). A reference is tried as it stands, then by its slug."""
    chunks = first_chunks.groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_id"))
    refs = vertices.select("entity_id", F.posexplode("doc_ids").alias("_nth", "ref")).withColumn("slug", X.doc_slug(F.col("ref")))
    tried = refs.select("entity_id", "_nth", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("ref").alias("doc_id")), F.struct(F.lit(1).alias("way"), F.col("slug").alias("doc_id")))).alias("t"))
    met = tried.select("entity_id", "_nth", "t.way", "t.doc_id").join(chunks, "doc_id")
    #: A document that several references name stands at the first of them.
    one = met.groupBy("entity_id", "_nth").agg(F.min_by(F.struct("doc_id", "chunk_id"), "way").alias("d"))
    return one.groupBy("entity_id", "d").agg(F.min("_nth").alias("_nth")).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "d"))).alias("docs")).select("entity_id", F.transform("docs", lambda x: x["d"]).alias("docs"))


def expand(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, first_chunks: DataFrame, exclude: DataFrame, budget: int = 12, hops: int = 1) -> DataFrame:
    """From the seeds of each query over edges within ``hops`` to new documents: qid, chunk_id, doc_id, reason, rank.

    seeds: qid, entity_id; first_chunks: doc_id, chunk_id; exclude: qid, doc_id. Edges by (confidence, tier), each triple once; in that
    order each takes the first document of its neighbour that is neither excluded nor taken, until the budget is full.

    The order is a fold over the edges of a query, whose length is bounded: of a neighbour's documents the first ``budget`` that are
    not excluded are enough, as fewer are taken when an edge's turn comes; of edges with the same set of n documents the first
    n are; and an edge can only fail if its set lies within the budget - 1 documents taken, so (budget - 1) 2^(budget - 2) fail at most.
    """
    triple = ["subject_id", "predicate", "object_id"]
    s = seeds.select("qid", "entity_id").distinct()
    ends = s.select(F.col("entity_id").alias("seed"), "entity_id").distinct()
    around = neighbours(edges, ends, hops)[1].where((F.col("subject_id") != F.col("object_id")) & (F.col("confidence") >= MIN_CONFIDENCE))
    order = Window.partitionBy("qid", *triple).orderBy(F.desc("confidence"), "tier", "evidence")
    hop = s.withColumnRenamed("entity_id", "seed").join(around, "seed").drop("seed").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    is_seed = s.select(F.col("qid").alias("_q"), F.col("entity_id").alias("_seed"))
    once = hop.join(is_seed, (F.col("qid") == F.col("_q")) & (F.col("subject_id") == F.col("_seed")), "left").withColumn("other", F.when(F.col("_seed").isNotNull(), F.col("object_id")).otherwise(F.col("subject_id"))).drop("_q", "_seed")
    barred = exclude.groupBy("qid").agg(F.collect_set("doc_id").alias("_barred"))
    docs = known_documents(vertices, first_chunks).withColumnRenamed("entity_id", "other")
    free = F.filter("docs", lambda d: ~F.coalesce(F.array_contains("_barred", d["doc_id"]), F.lit(False)))
    open_ = once.join(docs, "other").join(barred, "qid", "left").withColumn("docs", F.slice(free, 1, budget)).where(F.size("docs") > 0)
    best = [F.desc("confidence"), "tier", *triple]
    same = Window.partitionBy("qid", F.array_sort("docs")).orderBy(*best)
    needed = open_.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= F.size("docs"))
    bound = (budget - 1) * 2 ** max(0, budget - 2) + budget
    ranked = needed.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).where(F.col("_r") <= min(bound, 2**31 - 1))
    reason = F.concat(F.lit("reached via "), "subject_id", F.lit(" -"), "predicate", F.lit("-> "), "object_id", F.lit(" | evidence "), "evidence")
    lists = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_r", "docs", reason.alias("reason")))).alias("edges"))
    into = f"array<struct<doc_id:{first_chunks.schema['doc_id'].dataType.simpleString()},chunk_id:string,reason:string>>"

    def take(taken: Column, edge: Column) -> Column:
        left = F.filter(edge["docs"], lambda d: ~F.exists(taken, lambda t: t["doc_id"] == d["doc_id"]))
        got = F.transform(F.slice(left, 1, 1), lambda d: F.struct(d["doc_id"].alias("doc_id"), d["chunk_id"].alias("chunk_id"), edge["reason"].alias("reason")))
        return F.when(F.size(taken) >= budget, taken).otherwise(F.concat(taken, got))

    folded = lists.select("qid", F.posexplode(F.aggregate("edges", F.array().cast(into), take)).alias("_place", "t"))
    return folded.select("qid", "t.chunk_id", "t.doc_id", "t.reason", (F.col("_place") + 1).alias("rank"))


def section_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Chunks beside hits, of the same document and section, that are no hits: qid, chunk_id, reason. First hit wins.

    The range condition is turned into equi-joins on the position, one a place within the window.
    """
    where = chunks.select("chunk_id", "doc_id", "section_path", "chunk_pos")
    own = hits.select("qid", F.col("chunk_id").alias("hit"), "rank").join(where.withColumnRenamed("chunk_id", "hit"), "hit")
    offsets = F.array(*(F.lit(o) for o in range(-window, window + 1) if o))
    beside = own.select("qid", "hit", "rank", "doc_id", "section_path", "chunk_pos", F.explode(offsets).alias("offset")).withColumn("chunk_pos", F.col("chunk_pos") + F.col("offset"))
    met = beside.join(where, ["doc_id", "section_path", "chunk_pos"]).join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    w = Window.partitionBy("qid", "chunk_id").orderBy("rank", "offset")
    side = F.when(F.col("offset") < 0, "before").otherwise("after")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("qid", "chunk_id", F.concat(F.lit("section neighbour "), side, F.lit(" "), "hit").alias("reason"))


def expansion_budget(k: Column, fused: Column) -> Column:
    """How many of k hits an expansion may replace: half, but never all."""
    return F.greatest(F.lit(0), F.least(F.floor(k * 0.5), fused - 1)).cast("int")


def within_budget(base: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """Base hits and expanded ones (qid, chunk_id, rank, reason) in k places: the weakest base hits give way, never are places added."""
    count = base.groupBy("qid").agg(F.count("*").alias("_n"))
    extra = expanded.join(count, "qid").where(F.col("rank") <= expansion_budget(F.lit(k), F.col("_n")))
    used = extra.groupBy("qid").agg(F.count("*").alias("_used"))
    kept = base.join(used, "qid", "left").where(F.col("rank") <= k - F.coalesce("_used", F.lit(0)))
    hits = kept.select("qid", "chunk_id", "score", F.lit(None).cast("string").alias("reason"), F.lit(0).alias("_e"), "rank")
    more = extra.select("qid", "chunk_id", F.lit(0.0).alias("score"), "reason", F.lit(1).alias("_e"), "rank")
    w = Window.partitionBy("qid").orderBy("_e", "rank")
    return hits.unionByName(more).withColumn("rank", F.row_number().over(w)).drop("_e")


def save(vertices: DataFrame, edges: DataFrame, root: str) -> None:
    """The whole graph in place of the one under root."""
    tables.write_tables({"entities": vertices, "relations": edges}, root)


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    found = tables.read_tables(spark, root, ["entities", "relations"])
    return found["entities"], found["relations"]


def act(action: str, asked: DataFrame, edges: DataFrame, vertices: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges with names that an action gives each query, queries that name something unknown).

    graph_neighbors asks by qid and ref; graph_paths by qid, ref and to. An edge is given once a query.
    """
    ends = ["ref", "to"] if action == "graph_paths" else ["ref"]
    if action not in ("graph_paths", "graph_neighbors"):
        raise ValueError(f"unknown action {action}")
    known = asked
    for end in ends:
        found = resolve(vertices, asked.select(F.col(end).alias("ref")).distinct()).select(F.col("ref").alias(f"_{end}"), F.col("entity_id").alias(f"{end}_id"), F.col("resolved").alias(f"{end}_known"))
        known = known.join(found, F.col(end) == F.col(f"_{end}")).drop(f"_{end}")
    sure = F.col("ref_known") & F.col("to_known") if len(ends) == 2 else F.col("ref_known")
    good = known.where(sure)
    if action == "graph_neighbors":
        met = neighbours(edges, good.select(F.col("ref_id").alias("seed"), F.col("ref_id").alias("entity_id")).distinct(), hops)[1]
        out = good.select("qid", F.col("ref_id").alias("seed")).distinct().join(met, "seed").drop("seed").dropDuplicates(["qid", *EDGE_KEY])
    else:
        pairs = good.select(F.col("ref_id").alias("source"), F.col("to_id").alias("target")).distinct()
        on = paths(edges, pairs, hops).select("source", "target", F.explode("evidence").alias("evidence")).distinct()
        out = good.select("qid", F.col("ref_id").alias("source"), F.col("to_id").alias("target")).distinct().join(on, ["source", "target"]).join(edges, "evidence").select("qid", *edges.columns).dropDuplicates(["qid", *EDGE_KEY])
    return named(out, vertices), known.where(~sure).select("qid").distinct()
