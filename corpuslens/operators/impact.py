"""Best items for many weighted term queries, from postings in groups of like impact.

Postings are ``(term, item, n)``: a term's count in an item. A query scores an item by the
sum of its terms' ``weight * n`` and something else that depends on the item and on the
query's *class*. Items are put in groups by the sum of their counts; each term has its
largest count in each group, and each class the largest rest. For a query these add up to a
bound of what any item of a group can score, so a query that knows a threshold for its
results meets the postings of the few groups that reach it, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups for each doubling of the impact. More groups bound better and make a longer table.
PER_OCTAVE = 8
#: Sums of doubles may differ in their last digits by the order of addition.
SLACK = 1e-6


def in_groups(postings: DataFrame) -> DataFrame:
    """The postings with the number of their item's ``group``."""
    sizes = postings.groupBy("item").agg(F.sum("n").alias("_size"))
    group = F.floor(F.log2(1 + F.col("_size").cast("double")) * PER_OCTAVE).cast("int")
    return postings.join(sizes.select("item", group.alias("group")), "item")


def reachable(postings: DataFrame, wanted: DataFrame, rests: DataFrame, least_rest: DataFrame) -> DataFrame:
    """(query_id, item, n): the pairs that may score a query's threshold or more, with the
    sum of ``times * n`` over the terms that they share. No pair that reaches it is left out.

    ``postings`` are in groups; ``wanted`` is ``(query_id, term, times, weight, class,
    threshold)``, a term's weight being its times in the query times a constant. ``rests``
    is ``(class, group, rest)``, the largest rest where the class says something of an item;
    ``least_rest`` is ``(group, rest)``, the largest of items of which it says nothing.
    Bounds are added up from the table of each term's largest counts, whose length is the
    number of terms times the logarithm of the largest item. Then queries meet the postings
    of the groups that reach their threshold; of the sums, which are exact, those stay that
    reach it with the largest rest of their group.
    """
    largest = postings.groupBy("term", "group").agg(F.max("n").alias("most_n"))
    bounds = wanted.join(largest, "term").groupBy("query_id", "class", "threshold", "group").agg(
        F.sum(F.col("weight") * F.col("most_n")).alias("bound")
    )
    own = rests.withColumnRenamed("rest", "_own")
    rest = F.greatest(F.coalesce("_own", F.col("rest")), F.col("rest"))
    least = F.col("threshold") - SLACK - rest
    open_ = bounds.join(own, ["class", "group"], "left").join(least_rest, "group").withColumn("least", least)
    open_ = open_.where(F.col("bound") >= F.col("least")).select("query_id", "group", "least")
    met = wanted.select("query_id", "term", "times", "weight").join(open_, "query_id").join(
        postings.select("term", "group", "item", "n"), ["term", "group"]
    )
    sums = met.groupBy("query_id", "item", "least").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("weight") * F.col("n")).alias("gained")
    )
    return sums.where(F.col("gained") >= F.col("least")).select("query_id", "item", "n")


def term_sums(pairs: DataFrame, postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, item, n): sum of ``times * n`` over the terms that a query of ``wanted``
    and an item of ``pairs`` (query_id, item) share."""
    asked = pairs.select("query_id", "item").join(wanted.select("query_id", "term", "times"), "query_id")
    shared = asked.join(postings.select("term", "item", "n"), ["term", "item"])
    return shared.groupBy("query_id", "item").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
