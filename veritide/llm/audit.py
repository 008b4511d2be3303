"""How filters interact, told from one look at each document.

1. A document's mask says which of the five filters it fails; it does not depend on the order in which filters are applied.
2. Documents are counted by part and mask (at most 32 rows a part): all of them, the good and the toxic ones.
3. A part's removal polynomial is the multilinear extension of "how many documents do these filters remove": a document of mask m is
   removed with probability 1 - prod(1 - x_i, i in m) when each filter i is applied with probability x_i. As a sum of monomials
   its coefficients follow from the mask counts.
4. At a corner of the cube (each filter applied or not) the polynomial counts what exactly these filters remove; corners along
   an order give what is kept, removed and redundant at each step, corners that lack one filter what it alone catches.
5. A filter's Shapley value is the integral of the polynomial's partial derivative along the diagonal of the cube, an exact
   rational; times 120 it is what the filter removes over all orders together.

Filters (words are maximal runs of other than white space): A fewer than 50 words; B distinct words below 65 % of the words; C capital
letters A-Z above 5 % of the code points; D a character of ``[#$%&*|]``; E equal to the text of a smaller id anywhere in the table.

Defined cases: a null text is empty (it fails A, and E where a smaller id has an empty text); long texts are counted whole; a null id
is neither smaller than another nor has smaller ones; rows of one id are no copies of each other, yet each is counted; a null part is
the empty string; a document is good or toxic if any label of its id says so; labels without document are not looked at; an empty table gives no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact
from .common import SPACE, materialise, quoted

FILTERS = "ABCDE"
#: Fixed: the limits of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, ODD = 50, 65, 5, "[#$%&*|]"
MEASURES = ("n", "good", "toxic")
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

Polynomial = dict[int, int]


def own_failures(text: Column) -> Column:
    """The mask of the filters A to D, for a text that is not null."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(ODD),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def masks(docs: DataFrame, text: str, doc_id: str, part: str) -> DataFrame:
    """doc_id, part, mask."""
    given, key = F.coalesce(F.col(quoted(text)), F.lit("")), F.col(quoted(doc_id))
    own = F.struct(key.alias("id"), F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"), own_failures(given).alias("mask"))
    order = F.struct(key.isNull().alias("none"), key.alias("id"))
    told = exact.groups(docs.select(own.alias("own"), order.alias("order"), given.alias("content")))
    copy = F.coalesce(F.col("first.id") < F.col("own.id"), F.lit(False))
    return told.select(F.col("own.id").alias("doc_id"), F.col("own.part").alias("part"), (F.col("own.mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def removal(counts: dict[int, int]) -> Polynomial:
    """Coefficients by monomial (a mask of variables) of the removal polynomial of mask counts."""
    out: Polynomial = {}
    for monomial in range(1, 1 << len(FILTERS)):
        over = sum(n for mask, n in counts.items() if mask & monomial == monomial)
        out[monomial] = over if monomial.bit_count() % 2 else -over
    return out


def at_corner(p: Polynomial, corner: int) -> int:
    """The polynomial where the variables of corner are 1 and all others 0."""
    return sum(c for monomial, c in p.items() if monomial & corner == monomial)


def shapley(p: Polynomial, k: int) -> Fraction:
    """The integral over t from 0 to 1 of the derivative by variable k, where all variables are t."""
    by_power: dict[int, int] = {}
    for monomial, c in p.items():
        if monomial >> k & 1:
            power = monomial.bit_count() - 1
            by_power[power] = by_power.get(power, 0) + c
    return sum((Fraction(c, power + 1) for power, c in by_power.items()), Fraction(0))


def report(part: str, counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The rows of a part (``COLUMNS``) from its counts (mask, all, good, toxic)."""
    total = sum(row[1] for row in counts)
    everything, good, toxic = (removal({row[0]: row[k] for row in counts}) for k in (1, 2, 3))
    corners = range(1 << len(FILTERS))
    gone, good_gone, toxic_gone = ([at_corner(p, c) for c in corners] for p in (everything, good, toxic))
    every = corners[-1]
    orders = list(permutations(range(len(FILTERS))))
    worth = [shapley(everything, k) * len(orders) for k in range(len(FILTERS))]
    rows = []
    for order in orders:
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            redundant = gone[1 << k] - removed
            unique = gone[every] - gone[every ^ 1 << k]
            rows.append((part, "".join(FILTERS[x] for x in order), step, total - gone[after], removed, redundant, unique, good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], int(worth[k])))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step (``COLUMNS``). labels: doc_id, quality, toxic."""
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    #: Labels have a row an id; an id with many rows is split by the join and counted in its tasks.
    known = masks(docs, text, doc_id, part).join(said, F.col("doc_id") == F.col("labelled"), "left")
    sums = [F.count("*").alias("n"), *(F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in MEASURES[1:])]
    counts = known.groupBy("part", "mask").agg(*sums)
    one = materialise(counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("counts")), "maskcounts")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, of in zip(batch["part"], batch["counts"], strict=True):
                yield pd.DataFrame(report(name, [(x["mask"], *(x[m] for m in MEASURES)) for x in of]), columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return one.mapInPandas(rows, COLUMNS)
