"""Pattern discovery, ranking, and the two token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Tokens that a snapshot takes before any pattern.
ENVELOPE = 36
#: No pattern costs less.
LEAST_COST = 24


def python_repr(sample):
    """Length-true text of a sample as the token estimate sees it: a mapping's plain rendering."""
    value = lambda v: F.when(v == "null", "None").when(v == "true", "True").when(v == "false", "False").when(v.startswith('"'), F.concat(F.lit("'"), T.unquoted(v), F.lit("'"))).otherwise(v)
    pairs = F.transform(F.map_entries(sample["fields"]), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), value(e["value"])))
    return F.concat(F.lit("{'timestamp': '"), sample["timestamp"], F.lit("', 'fields': {"), F.array_join(pairs, ", "), F.lit("}}"))


def discover(enriched: DataFrame) -> DataFrame:
    """One row for each (template, severity).

    Events are first summed by evidence too, so a hot pattern is summed on the
    map side; only distinct services, evidence and stacks are collected.
    """
    place = F.struct("ts", "seq")
    has_fields, has_evidence = "fields" in enriched.columns, "evidence" in enriched.columns
    fields = T.sanitized(F.col("fields")) if has_fields else F.create_map().cast("map<string,string>")
    evidence = F.col("evidence") if has_evidence else F.lit(None).cast("struct<source:string,queryRef:string,start:string,end:string>")
    one = enriched.select("template", "severity", "fingerprint", "seq", "ts", "service", F.col("stack.fingerprint").alias("stack_id"), fields.alias("fields"), evidence.alias("evidence"))
    sample = F.struct("ts", "seq", "fields")
    small = one.groupBy("template", "severity", "fingerprint", "evidence").agg(
        F.count("*").alias("n"), F.min_by(sample, place).alias("first"), F.max_by(sample, place).alias("last"),
        F.collect_set("service").alias("services"), F.collect_set("stack_id").alias("stacks"), F.min("seq").alias("at"),
    )
    whole = small.groupBy("template", "severity", "fingerprint").agg(
        F.sum("n").alias("count"),
        F.min_by("first", F.struct("first.ts", "first.seq")).alias("first"), F.max_by("last", F.struct("last.ts", "last.seq")).alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"),
        F.array_distinct(F.flatten(F.collect_list("stacks"))).alias("stacks"),
        F.array_sort(F.collect_list(F.struct("at", "evidence"))).alias("evidence"),
    )
    shown = lambda s: F.struct(T.iso_z(F.col(f"{s}.ts").cast("timestamp")).alias("timestamp"), F.col(f"{s}.fields").alias("fields"))
    out = whole.select(
        "fingerprint", "template", "severity", "count",
        T.iso_z(F.col("first.ts").cast("timestamp")).alias("first_seen"), T.iso_z(F.col("last.ts").cast("timestamp")).alias("last_seen"), "services",
        F.when(F.col("count") == 1, F.array(shown("first"))).otherwise(F.array(shown("first"), shown("last"))).alias("samples"),
        F.filter(F.transform("evidence", lambda e: e["evidence"]), lambda e: e.isNotNull()).alias("evidence"),
        F.when(T.is_protected(F.col("severity")), "protected_severity").otherwise("dominant_frequency").alias("retention_reason"),
        F.when(F.size("stacks") == 1, F.element_at("stacks", 1)).alias("exception_fingerprint"),
    )
    length = F.length("template") + F.aggregate("samples", F.lit(0), lambda total, s: total + F.length(python_repr(s)))
    return out.withColumn("cost", (F.lit(LEAST_COST) + F.floor(length / 4)).cast("long"))


def ranked(patterns: DataFrame) -> list:
    """Sort keys: severity, then count, both falling, then fingerprint."""
    return [T.severity_rank(F.col("severity")).desc(), F.col("count").desc(), F.col("fingerprint").asc()]


def within_budget(items: DataFrame, budget: int, order: list, protected: str = "protected", key: str = "fingerprint", cost: str = "cost", least: int = LEAST_COST) -> DataFrame:
    """Rows kept by the greedy budget: protected ones always, others in order if they still fit.

    Rows of one cost that are kept are the first of that cost, and no more than
    available / cost of them, so the fold runs over a number of rows that the
    budget bounds, however many there are.
    """
    used = items.where(protected).agg(F.coalesce(F.sum(cost), F.lit(0)).alias("used"))
    free = items.where(f"not {protected} and {cost} <= {budget}").crossJoin(F.broadcast(used)).withColumn("left", F.lit(budget) - F.col("used"))
    by_cost = Window.partitionBy(cost).orderBy(*order)
    few = free.where(F.col(cost) <= F.col("left")).withColumn("nth", F.row_number().over(by_cost)).where(F.col("nth") <= F.floor(F.lit(budget) / F.greatest(F.col(cost), F.lit(least))))
    few = few.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    listed = few.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", F.col(cost).alias("cost"), F.col(key).alias("key")))).alias("all"), F.max("left").alias("left"))
    none = F.array().cast(f"array<{few.schema[key].dataType.simpleString()}>")
    fold = F.aggregate(
        "all",
        F.struct(F.col("left").cast("long").alias("left"), none.alias("keys")),
        lambda s, x: F.when(x["cost"] <= s["left"], F.struct((s["left"] - x["cost"]).alias("left"), F.concat(s["keys"], F.array(x["key"])).alias("keys"))).otherwise(s),
        lambda s: s["keys"],
    )
    kept = listed.where("left is not null").select(F.explode(fold).alias(key))
    return items.where(protected).unionByName(items.where(f"not {protected}").join(F.broadcast(kept), key, "left_semi"))


def within_prefix(items: DataFrame, remaining: int, order: list, most: int, cost: str = "cost") -> DataFrame:
    """The first ``most`` rows in order whose running cost stays within ``remaining``; stops at the first that does not."""
    first = items.orderBy(*order).limit(most)
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("running_cost", running).where(F.col("running_cost") <= remaining)


def retained(patterns: DataFrame, token_budget: int) -> DataFrame:
    return within_budget(patterns.withColumn("protected", T.is_protected(F.col("severity"))), max(0, token_budget - ENVELOPE), ranked(patterns)).drop("protected")


def stack_groups(enriched: DataFrame) -> DataFrame:
    """One row for each stack fingerprint."""
    place = F.struct("ts", "seq")
    found = enriched.where("stack is not null")
    has_evidence = "evidence" in enriched.columns
    evidence = F.col("evidence") if has_evidence else F.lit(None).cast("struct<source:string,queryRef:string,start:string,end:string>")
    small = found.withColumn("ev", evidence).groupBy("stack.fingerprint", "ev").agg(
        F.min_by(F.struct("stack.type", "stack.frames"), place).alias("stack"), F.count("*").alias("n"), F.collect_set("service").alias("services"), F.min(place).alias("first"), F.max(place).alias("last"),
    )
    whole = small.groupBy("fingerprint").agg(
        F.min_by("stack", "first").alias("stack"), F.sum("n").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("first", "ev"))).alias("evidence"),
    )
    return whole.select(
        "fingerprint", F.col("stack.type").alias("exception_type"), F.col("stack.frames").alias("frames"), "count", "services",
        T.iso_z(F.col("first.ts").cast("timestamp")).alias("first_seen"), T.iso_z(F.col("last.ts").cast("timestamp")).alias("last_seen"),
        F.filter(F.transform("evidence", lambda e: e["ev"]), lambda e: e.isNotNull()).alias("evidence"),
    )
