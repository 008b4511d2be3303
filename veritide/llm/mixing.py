"""Mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only.

Every source gets a target number of words: a share of the whole by weight, held at ``max_repeat`` times its own size,
the excess shared again by weight. A source's documents then each have the same expected number of copies,
target / size of the source. The whole part is taken outright; the fractions are rounded by the pivotal method: of two
units with fractional copies one gives words to the other until one of the two is integral, in a random direction
whose odds keep both expectations. Words, not copies, are what is passed on, so a source's total never moves while units
meet, and only its last undecided unit (one document) can miss the target.

Units meet in blocks of bounded expected size, dealt by a hash of the document; each block leaves one undecided unit, and
these meet in the next level's blocks, until each source has one left: a reduction tree of depth
log(documents) / log(block). All chance comes from hashes of ids and the seed, so reruns agree.

Defined cases: a null or empty text has no words; a document without words takes none; a very long text is a unit of its size; a null
source is a source of its own, the last. Rows equal in source, id and size are one unit of so many rows until the end, so a hot id is never gathered
in one task. Empty input gives an empty result. Extra columns are kept; own columns replace any of the same name.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, shielded

ADDED = ("size", "source_size", "target", "copies", "taken")
#: Units that meet in one block, on average.
BLOCK = 64
KEY = ("_source", "_null", "_id", "size")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """_source, _null, source_size, target. Sources by code point (null last) take the weights in turn.

    A target is min(cap, level * weight). The level rises from "nobody is capped" by sharing what capped sources cannot take
    among the others, until no further source is capped; a round is one aggregate over the stored sources. Sources are numbered
    within ranges of a distributed sort, so none of this gathers them, be they tens or all hosts of a crawl.
    """
    sizes = sized.groupBy("_source", "_null").agg(F.sum("size").alias("source_size")).withColumn("_key", F.col("_source").cast("binary"))
    order = ("_null", "_key")
    #: The id is the range and the place in it, in the order of the sort.
    sorted_ = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = materialise(sorted_.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "mixsources")
    counts = sorted(numbered.groupBy("_range").count().collect())
    first = dict(zip((r["_range"] for r in counts), accumulate((r["count"] for r in counts), initial=0), strict=False))
    starts = F.create_map(*(F.lit(x) for kv in (first or {0: 0}).items() for x in kv))
    turn = (F.element_at(starts, F.col("_range")) + F.col("_place")) % len(weights)
    weighed = numbered.withColumn("_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).withColumn("_cap", max_repeat * F.col("source_size"))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, capped = min(float(share), float(max_repeat)) * total, 0.0, None
    while total:
        held = F.col("_cap") <= level * F.col("_weight")
        n, caps, open_ = weighed.agg(F.count_if(held), F.sum(F.when(held, F.col("_cap")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("_weight")))).first()
        if n == capped or not open_:
            level = level if open_ else float("inf")
            break
        capped, level = n, (wanted - caps) / open_
    return weighed.select("_source", "_null", "source_size", F.least("_cap", F.lit(level) * F.col("_weight")).alias("target"))


def _chance(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _meet(units: Column, seed: int) -> Column:
    """Fold an array of (key, size, p) into (undecided unit, decided units). All sizes are above 0.

    The fold keeps one undecided unit ``u``; ``v`` meets it. Passing w words changes u's copies by w / size(u) and v's
    by -w / size(v). ``up`` is the most that u can take (until u is 1 or v is 0), ``down`` the most it can give.
    """
    unit = "struct<key:bigint,size:bigint,p:double>"

    def step(acc: Column, v: Column) -> Column:
        u = acc["u"]
        su, sv, pu, pv = u["size"].cast("double"), v["size"].cast("double"), u["p"], v["p"]
        fill_u, drain_v = (1 - pu) * su, pv * sv
        drain_u, fill_v = pu * su, (1 - pv) * sv
        up, down = F.least(fill_u, drain_v), F.least(drain_u, fill_v)
        goes_up = _chance(F.lit(seed), u["key"], v["key"]) < down / (up + down)
        #: Whether u is the one that becomes integral, to which value, and what is then left of the other.
        u_ends = F.when(goes_up, fill_u <= drain_v).otherwise(drain_u <= fill_v)
        u_to = F.when(goes_up, 1.0).otherwise(0.0)
        v_to = F.when(goes_up, 0.0).otherwise(1.0)
        v_left = F.when(goes_up, pv - up / sv).otherwise(pv + down / sv)
        u_left = F.when(goes_up, pu + up / su).otherwise(pu - down / su)
        clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        make = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))
        done = F.when(u_ends, make(u, u_to)).otherwise(make(v, v_to))
        left = F.when(u_ends, make(v, clip(v_left))).otherwise(make(u, clip(u_left)))
        #: A unit that is integral already (another's exact remainder) needs no partner.
        idle_u, idle_v = (pu <= 0) | (pu >= 1), (pv <= 0) | (pv >= 1)
        done = F.when(idle_u, make(u, pu)).when(idle_v, make(v, pv)).otherwise(done)
        left = F.when(idle_u, make(v, pv)).when(idle_v, make(u, pu)).otherwise(left)
        return F.struct(left.alias("u"), F.concat(acc["done"], F.array(done)).alias("done"))

    first = F.struct(F.element_at(units, 1).cast(unit).alias("u"), F.array().cast(f"array<{unit}>").alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), first, step)


def round_copies(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """_source, _null, key, size, extra (0 or 1): the units' fractions p rounded. units: _source, _null, key, size > 0, 0 < p < 1.

    The number of blocks of the next level follows from this one's, so only the first level counts its units.
    """
    counts = materialise(units.groupBy("_source", "_null").agg(F.count("*").alias("_n")), "mixcounts")
    most = counts.agg(F.max("_n")).first()[0] or 0
    left = units.join(counts.withColumnsRenamed({"_source": "c_source", "_null": "c_null"}), (F.col("_null") == F.col("c_null")) & F.col("_source").eqNullSafe(F.col("c_source"))).drop("c_source", "c_null")
    out, level = None, 0
    while most > 1 or level == 0:
        met = (
            left.withColumn("_blocks", F.ceil(F.col("_n") / block))
            .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), "_blocks"))
            .groupBy("_source", "_null", "_block")
            .agg(F.max("_blocks").alias("_n"), F.array_sort(F.collect_list(F.struct("key", "size", "p"))).alias("units"))
            .withColumn("met", _meet(F.col("units"), seed + level))
            .select("_source", "_null", "_n", F.col("met.u").alias("u"), F.col("met.done").alias("done"))
        )
        met = materialise(met, f"mix{level}")
        done = met.select("_source", "_null", F.explode("done").alias("d")).select("_source", "_null", "d.key", "d.size", F.col("d.p").cast("int").alias("extra"))
        out = done if out is None else out.unionByName(done)
        left = met.select("_source", "_null", "_n", "u.key", "u.size", "u.p")
        most, level = -(-most // block), level + 1
    return out.unionByName(left.select("_source", "_null", "key", "size", (F.col("p") >= 0.5).cast("int").alias("extra")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0, seed: int = 11, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target (both of its source), copies, and taken (size * copies)."""
    return shielded(docs, {"text": text, "source": source, "doc_id": doc_id}, ADDED, lambda rows: _mixed(rows, weights, share, max_repeat, seed))


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float, seed: int, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    kept = docs.columns
    sized = docs.select(
        *kept,
        F.col(source).alias("_source"),
        F.col(source).isNull().alias("_null"),
        F.col(doc_id).alias("_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    #: (source, id, size) and how many rows. All that is gathered works on this, without texts.
    slim = materialise(sized.groupBy(*KEY).agg(F.count("*").alias("_rows")), "mixrows")
    per_source = source_targets(slim.withColumn("size", F.col("size") * F.col("_rows")), weights, share, max_repeat)
    units = (
        slim.join(per_source.withColumnsRenamed({"_source": "s_source", "_null": "s_null"}), (F.col("_null") == F.col("s_null")) & F.col("_source").eqNullSafe(F.col("s_source")))
        .drop("s_source", "s_null")
        .withColumn("_expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_whole", F.floor("_expected"))
        #: Of so many equal rows, so many get one copy more; what is then left is one row's fraction.
        .withColumn("_more", (F.col("_expected") - F.col("_whole")) * F.col("_rows"))
        .withColumn("_sure", F.floor("_more"))
        .withColumn("p", F.col("_more") - F.col("_sure"))
        .withColumn("key", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), F.col("size")))
    )
    open_units = units.where("size > 0 and p > 0").select("_source", "_null", "key", "size", "p")
    rounded = round_copies(open_units, seed).select(F.col("_source").alias("r_source"), F.col("_null").alias("r_null"), F.col("key").alias("r_key"), F.col("size").alias("r_size"), "extra")
    settled = materialise(
        units.join(rounded, (F.col("key") == F.col("r_key")) & (F.col("size") == F.col("r_size")) & (F.col("_null") == F.col("r_null")) & F.col("_source").eqNullSafe(F.col("r_source")), "left").select(
            F.col("_source").alias("t_source"), F.col("_null").alias("t_null"), F.col("_id").alias("t_id"), F.col("size").alias("t_size"),
            (F.col("_sure") + F.coalesce("extra", F.lit(0))).alias("_extra"), "_whole", "source_size", "target", "_rows",
        ),
        "mixsettled",
    )
    same = F.col("_id").eqNullSafe(F.col("t_id")) & (F.col("size") == F.col("t_size")) & (F.col("_null") == F.col("t_null")) & F.col("_source").eqNullSafe(F.col("t_source"))
    shape = lambda df, extra: df.withColumn("copies", F.col("_whole") + extra).select(*kept, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    #: Units grow with the documents, so these are merge joins at any size, not broadcasts at some.
    single = shape(sized.join(settled.where("_rows = 1").hint("merge"), same), F.col("_extra"))
    if settled.where("_rows > 1").isEmpty():
        return single
    #: Repeated rows: numbered within the parts of a stored table, and the parts take their turns in order.
    repeated = materialise(sized.join(settled.where("_rows > 1").hint("merge"), same).withColumn("_part", F.spark_partition_id()), "mixrepeated")
    parts = repeated.groupBy(*KEY, "_part").agg(F.count("*").alias("_in_part"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in_part").over(Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(*(F.col(c).alias(f"p_{c}") for c in KEY), F.col("_part").alias("p_part"), "_before")
    numbered = repeated.withColumn("_number", F.row_number().over(Window.partitionBy(*KEY, "_part").orderBy(F.lit(1))))
    on = F.col("_id").eqNullSafe(F.col("p__id")) & (F.col("size") == F.col("p_size")) & (F.col("_null") == F.col("p__null")) & F.col("_source").eqNullSafe(F.col("p__source")) & (F.col("_part") == F.col("p_part"))
    return single.unionByName(shape(numbered.join(parts, on), ((F.col("_number") + F.col("_before")) <= F.col("_extra")).cast("long")))
