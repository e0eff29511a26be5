"""Frequent itemsets of two and three items, and association rules.

Baskets are gathered once; pairs and triples are made inside each basket, so
counting shuffles partial counts only.  A basket's pairs are quadratic in its
items: baskets are meant to be orders, visits or sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the sorted distinct items of each basket; rows with a null on either side are left out."""
    own = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    return own.groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def ordered_baskets(rows: DataFrame, basket: str, position: str, item: str) -> DataFrame:
    """(basket, items): the items of each basket in order, repetitions included."""
    own = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(item).alias("i"))))
    return own.groupBy(F.col(basket).alias("basket")).agg(F.transform(sorted_rows, lambda x: x["i"]).alias("items"))


def _after(items: Column, i: Column) -> Column:
    return F.slice(items, i + 2, F.size(items))


def _pairs(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda a, i: F.transform(_after(items, i), lambda b: F.struct(a.alias("i1"), b.alias("i2")))))


def item_support(sets: DataFrame, threshold: float) -> DataFrame:
    """(item, support) of items in more than threshold baskets (instances, for ordered baskets)."""
    return sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") > threshold)


def _only_frequent(sets: DataFrame, threshold: float) -> DataFrame:
    """Baskets without infrequent items, which no frequent set holds."""
    rows = sets.select("basket", F.posexplode("items").alias("p", "item"))
    kept = rows.join(item_support(sets, threshold).select("item"), "item", "left_semi")
    items = F.transform(F.array_sort(F.collect_list(F.struct("p", "item"))), lambda x: x["item"])
    return kept.groupBy("basket").agg(items.alias("items"))


def pair_support(sets: DataFrame, threshold: float) -> DataFrame:
    """(i1, i2, support) of pairs in more than threshold baskets; i1 stands before i2."""
    pairs = _only_frequent(sets, threshold).select(F.explode(_pairs(F.col("items"))).alias("p")).select("p.*")
    return pairs.groupBy("i1", "i2").agg(F.count("*").alias("support")).where(F.col("support") > threshold)


def triple_support(sets: DataFrame, pair_threshold: float, threshold: float) -> DataFrame:
    """(i1, i2, i3, support) of triples in more than threshold baskets, all of whose pairs are in more than pair_threshold."""
    items = F.col("items")
    triples = F.flatten(F.flatten(F.transform(items, lambda a, i: F.transform(_after(items, i), lambda b, j: F.transform(F.slice(items, i + j + 3, F.size(items)), lambda d: F.struct(a.alias("i1"), b.alias("i2"), d.alias("i3")))))))
    own = _only_frequent(sets, pair_threshold).select(F.explode(triples).alias("t")).select("t.*")
    # counted before it is joined: what meets the frequent pairs is a row for each triple
    counted = own.groupBy("i1", "i2", "i3").agg(F.count("*").alias("support")).where(F.col("support") > threshold)
    pairs = pair_support(sets, pair_threshold)
    for a, b in (("i1", "i2"), ("i1", "i3"), ("i2", "i3")):
        counted = counted.join(pairs.select(F.col("i1").alias(a), F.col("i2").alias(b)), [a, b], "left_semi")
    return counted.select("i1", "i2", "i3", "support")


def standardised_lift(lift: Column, antecedent: Column, consequent: Column, n: Column) -> Column:
    """Lift, relative to its least and greatest value for these supports."""
    least = F.greatest(antecedent + consequent - 1, 1 / n)
    low, high = least / (antecedent * consequent), 1 / (antecedent * consequent)
    return (lift - low) / (high - low)


def rule_measures(support: Column, of_antecedent: Column, of_consequent: Column, n: Column) -> list[Column]:
    """confidence, interest, lift, std_lift and std_lift_count; the last takes the antecedent's count where its share belongs."""
    confidence, p = support / of_antecedent, of_consequent / n
    lift = confidence / p
    return [
        confidence.alias("confidence"), (confidence - p).alias("interest"), lift.alias("lift"),
        standardised_lift(lift, of_antecedent / n, p, n).alias("std_lift"), standardised_lift(lift, of_antecedent.cast("double"), p, n).alias("std_lift_count"),
    ]


def rules(sets: DataFrame, itemsets: DataFrame, antecedents: DataFrame) -> DataFrame:
    """Rules from all but the last item of each itemset to the last one.

    itemsets has columns i1, i2[, i3] and support, antecedents the same without
    the last item.  One row for each itemset: key (comma-joined), support,
    confidence, interest, lift, std_lift, std_lift_count.
    """
    names = [x for x in itemsets.columns if x != "support"]
    n = sets.agg(F.count("*").cast("double").alias("n"))  # one row
    holding = sets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("of_consequent"))
    given = antecedents.withColumnsRenamed({"item": "i1", "support": "of_antecedent"})
    own = itemsets.join(given, names[:-1]).join(holding.withColumnRenamed("item", names[-1]), names[-1]).crossJoin(F.broadcast(n))
    return own.select(F.concat_ws(",", *names).alias("key"), "support", *rule_measures(*map(F.col, ("support", "of_antecedent", "of_consequent", "n"))))
