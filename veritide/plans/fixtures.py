"""Views over the test tables in the shapes that the operators read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.operators import chunking
from veritide.sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def docs(self) -> DataFrame:
        return self.t("documents").withColumn("authority_tier", 1 + F.substring("source", 4, 9).cast("int") % 5).withColumn("source_type", F.col("source"))

    def blocks(self) -> DataFrame:
        return chunking.line_blocks(self.t("documents"))

    def chunks(self) -> DataFrame:
        """A chunk a line; four lines a section. Positions are those within a document, offset by the document."""
        tiers = self.docs().select("doc_id", "authority_tier", "source_type", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
        return tiers.select(F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.col("ord").cast("string")).alias("chunk_id"), "doc_id", "authority_tier", "source_type", "text", "ord", (F.col("doc_id") * 1000000 + F.col("ord")).alias("chunk_pos"), F.concat(F.lit("s"), F.floor(F.col("ord") / 4).cast("string")).alias("section_path"))

    def queries(self) -> DataFrame:
        return self.t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    def gold(self) -> DataFrame:
        """Documents that hold a passage whole.

        A passage's longest inner word (with spaces on both sides) stands in any such document as a word, so passages meet
        documents by it, and only those that meet are searched. Passages of one or two words are tried against all texts.
        """

        def make() -> dict[str, DataFrame]:
            parts = F.split("query", " ")
            inner = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2))
            longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
            asked = self.queries().withColumn("word", F.when(F.size(inner) > 0, longest))
            docs = self.t("documents").select("doc_id", "text")
            words = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
            #: A text is searched where it is read: passages that it meets never travel with it.
            found = words.join(asked.where("word IS NOT NULL"), "word").where(F.contains("text", "query")).select("qid", "doc_id")
            short = docs.join(asked.where("word IS NULL").select("qid", "query"), F.contains("text", "query")).select("qid", "doc_id")
            return {"gold": found.unionByName(short)}

        return store.once(self.spark, f"gold {self.dir}", make)["gold"]

    def vectors(self) -> DataFrame:
        return self.t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", "embedding", "label")

    def vector_queries(self) -> DataFrame:
        """The vector of the same number for each query."""
        return self.queries().join(self.t("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid").select("qid", "qvec")

    def entities(self) -> DataFrame:
        one = lambda t, kind, key, name, of: self.t(t).select(F.concat(F.lit(f"ent_{kind}_"), F.col(key).cast("string")).alias("entity_id"), F.col(name).alias("name"), F.lit(of).alias("type"), F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit(f"{t}/"), F.col(key).cast("string"), F.lit(".md"))).alias("doc_ids"))
        return (
            one("region", "region", "r_regionkey", "r_name", "Location")
            .unionByName(one("nation", "nation", "n_nationkey", "n_name", "Location"))
            .unionByName(one("supplier", "supplier", "s_suppkey", "s_name", "Faction"))
            .unionByName(one("customer", "customer", "c_custkey", "c_name", "Character"))
        )

    def places(self) -> DataFrame:
        """Edges of what lies where."""
        def one(t: str, key: str, to: str, to_key: str) -> DataFrame:
            k = F.col(key).cast("string")
            return self.t(t).select(F.concat(F.lit(f"ent_{t}_"), k).alias("subject_id"), F.lit("located_in").alias("predicate"), F.concat(F.lit(f"ent_{to}_"), F.col(to_key).cast("string")).alias("object_id"), F.concat(F.lit(f"{t}#"), k).alias("evidence"), (1 + F.col(key) % 5).cast("int").alias("tier"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("qualifier"))

        return one("nation", "n_nationkey", "region", "n_regionkey").unionByName(one("supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(one("customer", "c_custkey", "nation", "c_nationkey"))

    def supplies(self) -> DataFrame:
        """An edge a line item."""
        s = F.col("l_suppkey").cast("string")
        line = F.concat(F.lit("lineitem#"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
        return self.t("lineitem").select(F.concat(F.lit("ent_supplier_"), s).alias("subject_id"), F.lit("supplies").alias("predicate"), F.concat(F.lit("ent_part_"), F.col("l_partkey").cast("string")).alias("object_id"), line.alias("evidence"), (1 + F.col("l_suppkey") % 5).cast("int").alias("tier"), F.lit(0.6).alias("confidence"), F.lit(None).cast("string").alias("qualifier"))

    def claims(self) -> DataFrame:
        """What each line item says a part costs."""
        line = F.concat(F.lit("lineitem#"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
        return self.t("lineitem").select(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("entity"), F.lit("unit price").alias("attribute"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("string").alias("value"), line.alias("chunk_id"), F.col("l_suppkey").cast("string").alias("doc_id"), (1 + F.col("l_suppkey") % 5).cast("int").alias("tier"))


TOKEN_SQL = "[a-z0-9]+(?:[-''][a-z0-9]+)*"
SQL = {
    "v_docs": "SELECT *, 1 + cast(substr(source, 4) AS int) % 5 AS authority_tier, source AS source_type FROM documents",
    "v_chunks": """SELECT doc_id || ':c' || ord AS chunk_id, doc_id, authority_tier, source_type, text, ord, doc_id * 1000000 + ord AS chunk_pos, 's' || (ord // 4) AS section_path
        FROM (SELECT doc_id, authority_tier, source_type, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM v_docs)""",
    "v_queries": "SELECT item_id AS qid, text AS query FROM benchmark",
    "v_gold": "SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "v_qvec": "SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON item_id = vec_id",
    "v_entities": """SELECT 'ent_region_' || r_regionkey AS entity_id, r_name AS name, 'Location' AS type, 'region/' || r_regionkey || '.md' AS doc FROM region
        UNION ALL SELECT 'ent_nation_' || n_nationkey, n_name, 'Location', 'nation/' || n_nationkey || '.md' FROM nation
        UNION ALL SELECT 'ent_supplier_' || s_suppkey, s_name, 'Faction', 'supplier/' || s_suppkey || '.md' FROM supplier
        UNION ALL SELECT 'ent_customer_' || c_custkey, c_name, 'Character', 'customer/' || c_custkey || '.md' FROM customer""",
    "v_places": """SELECT 'ent_nation_' || n_nationkey AS subject_id, 'located_in' AS predicate, 'ent_region_' || n_regionkey AS object_id, 'nation#' || n_nationkey AS evidence, 1 + n_nationkey % 5 AS tier FROM nation
        UNION ALL SELECT 'ent_supplier_' || s_suppkey, 'located_in', 'ent_nation_' || s_nationkey, 'supplier#' || s_suppkey, 1 + s_suppkey % 5 FROM supplier
        UNION ALL SELECT 'ent_customer_' || c_custkey, 'located_in', 'ent_nation_' || c_nationkey, 'customer#' || c_custkey, 1 + c_custkey % 5 FROM customer""",
    "v_supplies": "SELECT 'ent_supplier_' || l_suppkey AS subject_id, 'supplies' AS predicate, 'ent_part_' || l_partkey AS object_id, 'lineitem#' || l_orderkey || ':' || l_linenumber AS evidence, 1 + l_suppkey % 5 AS tier FROM lineitem",
    "v_claims": "SELECT 'part ' || l_partkey AS entity, 'unit price' AS attribute, cast(cast(floor(l_extendedprice / l_quantity / 100) AS bigint) AS varchar) AS value, 'lineitem#' || l_orderkey || ':' || l_linenumber AS chunk_id, cast(l_suppkey AS varchar) AS doc_id, 1 + l_suppkey % 5 AS tier FROM lineitem",
}
NEEDS = {"v_chunks": ["v_docs"]}


def with_views(sql: str, *views: str) -> str:
    """sql after the definitions of the views it names."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*NEEDS.get(v, []), v] if x not in order]
    heads = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    again = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    return f"WITH {again}{heads}{', ' + sql.removeprefix('WITH ').removeprefix('RECURSIVE ') if sql.startswith('WITH ') else ' ' + sql}"
