"""Many detection rules in one scan.

A rule is a condition over flows with a look-back; a row rule returns the flows that
hold it, a group rule the groups of which a measure over them exceeds a limit.
Conditions are SQL expressions.  All row rules are tested on each flow in one pass; all
group rules of the same keys are conditional aggregates of one grouped pass.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col, bounded, interval
from flowlens.operators.detect import MATCH_SCHEMA

ROW_RULES = "id string, title string, severity string, condition string, minutes int, columns array<string>"
#: measure: `flows`, `sum <column>` or `distinct <column>`, over the flows that hold the condition.
GROUP_RULES = "id string, title string, severity string, condition string, minutes int, keys array<string>, measure string, over double"
ERRORS = "rule_id string, error string"


def _usable(rules: list, flows: DataFrame, need) -> tuple[list, list[tuple[str, str]]]:
    """Rules whose condition and columns resolve, and the others with their error."""
    good, bad = [], []
    for r in rules:
        try:
            # analysed only; a condition that isn't boolean doesn't pass as a filter
            flows.filter(F.expr(r["condition"])).select(*need(r)).schema  # noqa: B018
            good.append(r)
        except (AnalysisException, ParseException) as e:
            bad.append((r["id"], e.getCondition() or type(e).__name__))
    return good, bad


def _errors(spark: SparkSession, bad: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(bad, ERRORS)


def _holds(r, now: Column) -> Column:
    return F.expr(r["condition"]) & (F.col("ts") > now - interval(f"{r['minutes']} MINUTES"))


def run_row_rules(flows: DataFrame, rules: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(matches, errors) of all row rules, in one scan of the flows.

    A match is a row for each flow and rule that it holds, with the rule's columns as
    JSON, as ``detect.run_rules`` gives it.  The driver reads the rules' definitions;
    a rule that doesn't resolve is a row of errors and stops no other.
    """
    spark = flows.sparkSession
    now = as_of_col(flows, as_of)
    good, bad = _usable(rules.orderBy("id").collect(), flows, lambda r: r["columns"])
    if not good:
        return spark.createDataFrame([], MATCH_SCHEMA), _errors(spark, bad)
    recent = bounded(flows, now - interval(f"{max(r['minutes'] for r in good)} MINUTES"))
    tags = F.array_compact(F.array(*[F.when(_holds(r, now), F.lit(i)) for i, r in enumerate(good)]))
    shapes: dict[tuple, list[int]] = {}
    for i, r in enumerate(good):
        shapes.setdefault(tuple(r["columns"]), []).append(i)
    columns = list(dict.fromkeys(c for s in shapes for c in s))
    hits = recent.withColumn("tags", tags).filter(F.size("tags") > 0).select(F.explode("tags").alias("rule"), *columns)
    data = None
    for shape, numbers in shapes.items():
        test, text = F.col("rule").isin(numbers), F.to_json(F.struct(*shape))
        data = F.when(test, text) if data is None else data.when(test, text)
    names = spark.createDataFrame([(i, r["id"], r["title"], r["severity"]) for i, r in enumerate(good)],
                                  "rule int, rule_id string, rule_title string, severity string")
    return hits.select("rule", data.alias("match_data")).join(names, "rule").select(
        "rule_id", "rule_title", "severity", "match_data", now.cast("timestamp").alias("fired_at")), _errors(spark, bad)


def _measure(r, now: Column) -> Column:
    kind, _, column = r["measure"].partition(" ")
    held = _holds(r, now)
    if kind == "flows":
        return F.count_if(held)
    if kind == "sum":
        return F.sum(F.when(held, F.col(column)))
    return F.count_distinct(F.when(held, F.col(column)))


def run_group_rules(flows: DataFrame, rules: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(matches, errors) of all group rules: one grouped pass for each set of keys.

    A match is a row for each group whose measure exceeds the rule's limit, with the
    keys and the measure as JSON.  Distinct counts are planned by Spark in two levels,
    so a hot group is spread over its values.
    """
    spark = flows.sparkSession
    now = as_of_col(flows, as_of)
    measures = ("flows", "sum", "distinct")

    def need(r):
        kind, _, column = r["measure"].partition(" ")
        return [*r["keys"], *([column] if column else [])] if kind in measures else ["measure that isn't known"]

    good, bad = _usable(rules.orderBy("id").collect(), flows, need)
    out = spark.createDataFrame([], MATCH_SCHEMA)
    by_keys: dict[tuple, list] = {}
    for r in good:
        by_keys.setdefault(tuple(r["keys"]), []).append(r)
    for keys, group in by_keys.items():
        recent = bounded(flows, now - interval(f"{max(r['minutes'] for r in group)} MINUTES"))
        sums = recent.groupBy(*keys).agg(*[_measure(r, now).alias(f"m{i}") for i, r in enumerate(group)])
        over = F.array_compact(F.array(*[
            F.when(F.col(f"m{i}") > r["over"], F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["title"]).alias("rule_title"),
                                                        F.lit(r["severity"]).alias("severity"), F.col(f"m{i}").cast("long").alias("value")))
            for i, r in enumerate(group)]))
        m = sums.select(*keys, F.explode(over).alias("m"))
        out = out.unionByName(m.select("m.rule_id", "m.rule_title", "m.severity", F.to_json(F.struct(*keys, "m.value")).alias("match_data"),
                                       now.cast("timestamp").alias("fired_at")))
    return out, _errors(spark, bad)
