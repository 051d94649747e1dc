"""File policy: rules from text, and the first rule that an open or exec breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


class PolicyError(ValueError):
    pass


def parse_policy(text: str) -> list[tuple[int, str, str]]:
    """(rule number, kind, value) of each rule; blank lines and # comments are skipped, anything else is an error."""
    rules = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        kind, _, value = line.partition(" ") if " " in line else line.partition("\t")
        value = value.strip()
        if kind == "deny_open" and value.startswith("/"):
            rules.append((len(rules), kind, value.rstrip("/")))
        elif kind == "deny_exec" and value and "/" not in value:
            rules.append((len(rules), kind, value))
        else:
            raise PolicyError(f"line {number}: {raw!r} is no rule")
    return rules


def rule_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_policy(text), "rule_no int, kind string, value string")


def violations(ops: DataFrame, rules: DataFrame) -> DataFrame:
    """ops(seq, op, path) that break a rule, with the first such rule in file order.

    An exec is denied by its basename. An open is denied by a folder on its path: every folder of the path is looked
    up, so both are equi-joins, however many rules there are.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keys = F.when(F.col("op") == 1, folders).otherwise(F.array(S.basename(F.col("path"))))
    kind = F.when(F.col("op") == 1, F.lit("deny_open")).when(F.col("op") == 2, F.lit("deny_exec"))
    looked = ops.withColumn("kind", kind).withColumn("value", F.explode(keys))
    return (
        looked.join(rules, ["kind", "value"])
        .groupBy("seq", "op", "path")
        .agg(F.min(F.struct("rule_no", "kind", "value")).alias("r"))
        .select("seq", "op", "path", F.concat_ws(" ", "r.kind", "r.value").alias("rule"))
    )


def gate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """detected, missing and unexpected violations against a list of expected (seq)."""
    both = found.select("seq", F.lit(1).alias("f")).join(expected.select("seq", F.lit(1).alias("e")), "seq", "full")
    return both.agg(
        F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("detected"),
        F.count_if(F.col("f").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
    )
