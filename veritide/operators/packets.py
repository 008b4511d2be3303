"""Answer packets: plans for questions, proposed claims that their sources bear out, what stays open, and the graph behind an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.operators import answers, evidence
from veritide.operators.analysis import surfaces

#: Fixed: intents that are taken apart, how many names a plan follows, the least score of a figure.
DECOMPOSED, MOST_SEEDS, FIGURE_SCORE = ["multi_hop", "comparison", "exploratory"], 8, 0.8


def plan(questions: DataFrame, seeds: DataFrame) -> DataFrame:
    """questions (qid, question, intent) with sub_questions: one for each name found, or two steps where there are fewer than two names.

    seeds: qid, at, surface. A blank question has no sub-questions.
    """
    named = F.array_sort(F.collect_list(F.struct("at", "surface")))
    by = seeds.groupBy("qid").agg(F.transform(F.slice(named, 1, MOST_SEEDS), lambda x: x["surface"]).alias("_names"))
    q = F.col("question")
    each = F.transform("_names", lambda s: F.concat(F.lit("Find evidence about "), s, F.lit(" relevant to: "), q))
    steps = F.array(F.concat(F.lit("Which entities and relationships are requested by: "), q), F.concat(F.lit("Using those retrieved entities, resolve: "), q))
    several = F.when(F.coalesce(F.size("_names"), F.lit(0)) >= 2, each).otherwise(steps)
    none = F.array().cast("array<string>")
    return questions.join(by, "qid", "left").withColumn("sub_questions", F.when(F.trim(q) == "", none).when(F.col("intent").isin(DECOMPOSED), several).otherwise(F.array(q))).drop("_names")


def complete_vocabulary(vertices: DataFrame, total: int) -> DataFrame:
    """vertices, if they are as many as they should be and some have a kind: names must not be looked for in a part of them."""
    n, typed = vertices.agg(F.count("*"), F.count_if(F.col("type") != "Title")).first()
    if n != total:
        raise ValueError(f"the vocabulary has {n} of {total} entities")
    if not typed:
        raise ValueError("the vocabulary has no named entities")
    return vertices


def figures(claims: DataFrame, quotes: DataFrame, assets: DataFrame) -> DataFrame:
    """trace_id, ord, asset_id: figures that a claim asks for and one of its quotations shows.

    claims: trace_id, ord, text, question, asset_ids; quotes: trace_id, ord, quote, shown (the asset ids of its chunk); assets: asset_id, subject, values.
    """
    wanted = claims.select("trace_id", "ord", F.col("text").alias("claim"), "question", F.explode("asset_ids").alias("asset_id")).join(assets, "asset_id")
    scored = answers.score_assets(wanted).where(F.col("score") >= FIGURE_SCORE)
    met = scored.join(quotes, ["trace_id", "ord"]).where(F.array_contains("shown", F.col("asset_id")))
    subject = F.regexp_replace(X.words(F.col("subject")), "^the ", "")
    names_it = F.contains(F.concat(F.lit(" "), X.words(F.col("quote")), F.lit(" ")), F.concat(F.lit(" "), subject, F.lit(" ")))
    return met.where(names_it & evidence.bound_value(F.col("values"), F.col("claim"), F.col("quote"), subject)).select("trace_id", "ord", "asset_id").distinct()


def accept(claims: DataFrame, chunks: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, citations, removed): what proposed claims are worth against the evidence they were made from.

    claims: trace_id, ord, question, text, confidence, asset_ids, sources (chunk_id, quote); chunks: trace_id, chunk_id, doc_id, rank,
    text, asset_ids. A claim goes if it cites a chunk that is no evidence, quotes what its chunk does not say (nor several chunks
    part by part), or asks for figures of which none shows what it says. Quotations are replaced by the words of the source.
    """
    refs = claims.select("trace_id", "ord", F.posexplode("sources").alias("nth", "s")).select("trace_id", "ord", "nth", "s.chunk_id", "s.quote")
    known = chunks.select("trace_id", "chunk_id", F.col("text").alias("_t"), "doc_id", F.col("asset_ids").alias("shown"))
    met = refs.join(known, ["trace_id", "chunk_id"], "left")
    absent = met.where("_t IS NULL").select("trace_id", "ord", F.lit("chunk_not_in_evidence").alias("reason"))
    there = met.where("_t IS NOT NULL")
    #: Most quotations stand in their chunk letter by letter; only the rest are matched loosely.
    exact = there.where(F.contains("_t", "quote")).withColumn("span", F.col("quote"))
    loose = there.where(~F.contains("_t", "quote")).withColumn("span", evidence.verbatim("quote", "_t"))
    found = exact.unionByName(loose.where("span IS NOT NULL")).select("trace_id", "ord", "nth", F.lit(0).alias("part"), "chunk_id", "doc_id", "span", "shown")
    lost = loose.where("span IS NULL").withColumn("quote_id", F.concat_ws(":", "trace_id", "ord", "nth"))
    pieces = evidence.split_quote(lost.select("quote_id", F.col("trace_id").alias("qid"), "quote"), chunks.select(F.col("trace_id").alias("qid"), "chunk_id", "rank", "text"))
    apart = lost.select("trace_id", "ord", "nth", "quote_id").join(pieces, "quote_id").join(known.select("trace_id", "chunk_id", "doc_id", "shown"), ["trace_id", "chunk_id"]).select("trace_id", "ord", "nth", "part", "chunk_id", "doc_id", F.col("fragment").alias("span"), "shown")
    unmatched = lost.join(apart.select("trace_id", "ord", "nth").distinct(), ["trace_id", "ord", "nth"], "left_anti").select("trace_id", "ord", F.lit("quote_not_found").alias("reason"))
    spans = found.unionByName(apart)
    shown = figures(claims, spans.select("trace_id", "ord", F.col("span").alias("quote"), "shown"), assets)
    bare = claims.where(F.size("asset_ids") > 0).select("trace_id", "ord").join(shown, ["trace_id", "ord"], "left_anti").withColumn("reason", F.lit("figure_not_bound"))
    order = F.array(F.lit("chunk_not_in_evidence"), F.lit("quote_not_found"), F.lit("figure_not_bound"))
    every = absent.unionByName(unmatched).unionByName(bare)
    removed = every.groupBy("trace_id", "ord").agg(F.min(F.struct(F.array_position(order, F.col("reason")).alias("n"), "reason")).alias("m")).select("trace_id", "ord", "m.reason")
    cited = spans.join(removed, ["trace_id", "ord"], "left_anti").select("trace_id", "ord", "nth", "part", X.citation_id(F.col("chunk_id"), F.col("span")).alias("id"), "chunk_id", "doc_id", F.col("span").alias("excerpt"), F.sha2("span", 256).alias("excerpt_sha256"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "part", "id"))), lambda x: x["id"])
    backed = F.when((F.count_distinct("doc_id") > 1) & (F.count_distinct(F.lower(X.squeeze(F.col("excerpt")))) > 1), "corroborated").otherwise("single_source")
    each = cited.groupBy("trace_id", "ord").agg(ids.alias("citation_ids"), backed.alias("support"))
    visuals = shown.groupBy("trace_id", "ord").agg(F.array_sort(F.collect_set("asset_id")).alias("visuals"))
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("ord"))
    kept = claims.join(each, ["trace_id", "ord"]).join(visuals, ["trace_id", "ord"], "left").select("trace_id", F.concat(F.lit("claim_"), number.cast("string")).alias("claim_id"), "text", "support", "confidence", "citation_ids", F.coalesce("visuals", F.array().cast("array<string>")).alias("visuals"))
    return kept, cited.dropDuplicates(["trace_id", "id"]).drop("ord", "nth", "part"), removed


def plain_question(question: Column) -> Column:
    """A question's words, letter case and marks aside."""
    return X.squeeze(F.lower(F.regexp_replace(question, r"[^\p{L}\p{N}_\s]", " ")))


def outstanding(packets: DataFrame) -> DataFrame:
    """packets (trace_id, question, n_claims, missing, partial, dated) with missing_information and is_partial.

    The question itself is nothing missing once some claim answers it; a partial answer that misses nothing else says that the
    question is not resolved. Without claims the question is refused. dated: whether some claim has a number.
    """
    q, some = F.col("question"), F.col("n_claims") > 0
    listed = F.array_distinct("missing")
    rest = F.when(some, F.filter(listed, lambda m: plain_question(m) != plain_question(q))).otherwise(listed)
    rest = F.when(some & F.col("partial") & (F.size(rest) == 0), F.array(F.concat(F.lit("The question was not fully resolved: "), q))).otherwise(rest)
    refused = F.array_distinct(F.concat(rest, F.array(F.concat(F.lit("No proposed claim had valid supporting evidence: "), q))))
    year = some & q.rlike(r"(?i)\byear\b") & ~F.col("dated")
    final = F.when(~some, refused).when(year, F.concat(rest, F.array(F.lit("The requested year has not been established.")))).otherwise(rest)
    return packets.withColumn("missing_information", final).withColumn("is_partial", ~some | (F.size(rest) > 0) | year)


def evidence_graph(edges: DataFrame, claims: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of answers: entities and how they relate, documents and the claims they support. Each node and support stands once.

    edges: trace_id, subject_id, subject, object_id, object; claims: trace_id, claim_id, text, citation_ids; citations: trace_id, id, doc_id, title.
    """
    node = lambda df, key, kind, label: df.select("trace_id", F.col(key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
    held = claims.select("trace_id", "claim_id", F.explode("citation_ids").alias("id")).join(citations, ["trace_id", "id"])
    nodes = node(edges, "subject_id", "entity", "subject").unionByName(node(edges, "object_id", "entity", "object")).unionByName(node(claims, "claim_id", "claim", "text")).unionByName(node(held, "doc_id", "document", "title"))
    one = nodes.groupBy("trace_id", "id").agg(F.min_by("type", "label").alias("type"), F.min("label").alias("label"))
    link = lambda df, a, b, kind: df.select("trace_id", F.col(a).alias("from"), F.col(b).alias("to"), F.lit(kind).alias("type"))
    return one, link(edges, "subject_id", "object_id", "relates").unionByName(link(held, "doc_id", "claim_id", "supports").distinct())


def ordered_assets(hits: DataFrame) -> DataFrame:
    """qid, asset_ids: the assets of each query's hits (qid, rank, asset_ids), each once, in the order in which they are met."""
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_ids"))), lambda x: x["asset_ids"]))
    return hits.groupBy("qid").agg(F.array_distinct(every).alias("asset_ids"))


def with_assets(wanted: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets found, ids that the registry lacks). wanted: qid, asset_ids; registry: asset_id, ...."""
    each = wanted.select("qid", F.posexplode("asset_ids").alias("place", "asset_id"))
    return each.join(registry, "asset_id"), each.join(registry.select("asset_id"), "asset_id", "left_anti")


def asset_page(registry: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The first assets by id, of one kind if asked, with has_values and the number of all assets of any kind."""
    total = registry.agg(F.count("*").alias("total"))
    rows = registry.where(F.col("kind") == kind) if kind else registry
    return rows.withColumn("has_values", F.size("values") > 0).orderBy("asset_id").limit(limit).join(F.broadcast(total))


def envelope(payload: Column) -> Column:
    """Evidence for a prompt: JSON in ASCII without angle brackets, so that nothing in it can end the block it stands in."""
    safe = F.replace(F.replace(F.to_json(payload), F.lit("<"), F.lit(r"\u003c")), F.lit(">"), F.lit(r"\u003e"))
    return F.concat(F.lit("<evidence>"), safe, F.lit("</evidence>"))


def names_of(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """ids (entity_id) with name, the id itself where there is none."""
    return ids.join(vertices.select("entity_id", "name"), "entity_id", "left").withColumn("name", F.coalesce("name", "entity_id"))


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, relations, surfaces (names and aliases as they are looked up), and kinds of entity."""
    v = vertices.agg(F.count("*").alias("entities"), F.count_distinct("type").alias("kinds"))
    return v.join(F.broadcast(edges.agg(F.count("*").alias("relations")))).join(F.broadcast(surfaces(vertices).agg(F.count_distinct("surface").alias("surfaces"))))


def listed(column: Column) -> Column:
    """A list that was stored as one string with bars between its items; blanks are none."""
    return F.filter(F.split(column, r"\|"), lambda x: x != "")


def bundle(hits: DataFrame, claims: DataFrame, detector: Callable[[DataFrame], DataFrame] = evidence.conflicts, hop_order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged evidence of each query, conflicts among claims by a detector that may be any function of a table of claims)."""
    return evidence.merge_evidence(hits, hop_order), detector(claims)


def assess(packets: DataFrame, covered: DataFrame, latest: DataFrame, history: DataFrame) -> DataFrame:
    """trace_id, sufficient, missing, next_action, next_query: whether evidence suffices, by rule.

    packets: trace_id, question, intent, step, sub_questions, requires_visual; covered: trace_id, sub_question, quoted verbatim in known
    chunks; latest: trace_id, place, name, what the last step found; history: trace_id, action, query. A chain of hops needs two steps. The next search leads with
    the first name found that neither the question nor a search has had; no action is taken twice.
    """
    none = F.array().cast("array<string>")
    done = covered.groupBy("trace_id").agg(F.collect_set("sub_question").alias("_done"))
    used = history.groupBy("trace_id").agg(F.lower(F.array_join(F.collect_list("query"), " ")).alias("_used"), F.collect_set(F.concat_ws("\u0001", "action", "query")).alias("_taken"))
    names = latest.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("_names"))
    rows = packets.join(done, "trace_id", "left").join(used, "trace_id", "left").join(names, "trace_id", "left")
    open_ = F.array_except("sub_questions", F.coalesce("_done", none))
    enough = (F.size(open_) == 0) & ~((F.col("intent") == "multi_hop") & (F.col("step") < 2))
    before = F.concat(F.coalesce("_used", F.lit("")), F.lit(" "), F.lower("question"))
    new = F.get(F.filter(F.coalesce("_names", none), lambda n: ~F.contains(before, F.lower(n))), F.lit(0))
    action = F.when(new.isNotNull(), "hybrid_search").when(F.col("requires_visual"), "figure_search").otherwise("hybrid_search")
    query = F.when(new.isNotNull(), F.concat_ws(" ", new, "question")).otherwise(F.col("question"))
    again = F.array_contains(F.coalesce("_taken", none), F.concat_ws("\u0001", action, query))
    missing = F.when(enough, none).when(F.size(open_) > 0, open_).otherwise(F.array(F.concat(F.lit("The complete relationship chain for "), "question")))
    return rows.select("trace_id", enough.alias("sufficient"), missing.alias("missing"), F.when(~enough & ~again, action).alias("next_action"), F.when(~enough & ~again, query).alias("next_query"))
