"""Rules of domains, evaluated on the data of the domain's products.

``rules(domain, rule_id, name, severity, condition)``: a condition (see
``functions.conditions``) that every row of every product of the domain must
meet. All rules of a product are counted in one pass over the columns that
they name. A rule whose condition does not fit a product (no such column,
wrong type, no condition at all) is reported as ``error`` for it; it neither
stops the others nor the job.

A row offends a rule where the condition is false; where it is null (a value
is missing) the row is unknown and offends nothing. Rules are metadata: they
and the products' schemas are read on the driver, one entry per rule.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import ConditionError, compile_condition

RESULT_SCHEMA = ("product string, rule_id string, rule_name string, status string, severity string, "
                 "rows_checked long, offending_rows long, unknown_rows long, message string")
#: Conditions counted by one job.
PER_JOB = 100


def _compiled(df: DataFrame, rules):
    """(rule, condition or None, error) of every rule."""
    out = []
    for rule in rules:
        try:
            if rule["condition"] is None:
                raise ConditionError("no condition")
            out.append((rule, compile_condition(rule["condition"], df.schema)[0], ""))
        except ConditionError as e:
            out.append((rule, None, str(e)))
    return out


def _rules_of(products: dict, domains: dict, rules: DataFrame):
    """(product, frame, its rules in order of their ids)."""
    by_domain: dict[str, list] = {}
    for rule in rules.select("domain", "rule_id", "name", "severity", "condition").orderBy("rule_id", "name").collect():
        by_domain.setdefault(rule["domain"], []).append(rule)
    return [(name, df, by_domain.get(domains.get(name), [])) for name, df in products.items()]


def domain_checks(products: dict[str, DataFrame], domains: dict[str, str], rules: DataFrame) -> DataFrame:
    """One row per product and rule of its domain (``domains``: product ->
    domain): ``pass`` without offending rows, else ``fail`` (``warning`` for
    rules of severity warning or info), ``error`` if it cannot be evaluated."""
    out = rules.sparkSession.createDataFrame([], RESULT_SCHEMA)
    for name, df, own in _rules_of(products, domains, rules):
        compiled = _compiled(df, own)
        for lo in range(0, len(compiled), PER_JOB):
            part = compiled[lo:lo + PER_JOB]
            counts = [F.count(F.lit(1)).alias("n")]
            for i, (_, condition, _) in enumerate(part):
                if condition is not None:
                    counts += [F.count_if(~condition).alias(f"bad{i}"), F.count_if(condition.isNull()).alias(f"null{i}")]
            rows = [_result(rule, i, error) for i, (rule, _, error) in enumerate(part)]
            out = out.unionByName(df.agg(*counts).select(F.lit(name).alias("product"), F.inline(F.array(*rows))))
    return out


def _result(rule, i, error):
    none = F.lit(None).cast("long")
    broken = "fail" if rule["severity"] == "error" else "warning"
    if error:
        fields = F.lit("error"), none, none, none, F.lit(f"Rule cannot be evaluated: {error}")
    else:
        bad, unknown = F.col(f"bad{i}"), F.col(f"null{i}")
        message = F.concat(F.format_string("%d of %d rows break the rule", bad, F.col("n")),
                           F.when(unknown > 0, F.format_string(", %d unknown", unknown)).otherwise(""))
        fields = F.when(bad > 0, broken).otherwise("pass"), F.col("n"), bad, unknown, message
    status, n, bad, unknown, message = fields
    return F.struct(F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["name"]).alias("rule_name"),
                    status.alias("status"), F.lit(rule["severity"]).alias("severity"), n.alias("rows_checked"),
                    bad.alias("offending_rows"), unknown.alias("unknown_rows"), message.alias("message"))


def offending_rows(df: DataFrame, rules: DataFrame, domain: str, column: str = "broken_rules") -> DataFrame:
    """The rows of a product that break a rule of its domain, with the ids of
    the broken rules: what to put in quarantine. One pass, no shuffle. A
    column of the same name is replaced."""
    own = _rules_of({"": df}, {"": domain}, rules)[0][2]
    broken = [F.when(~condition, F.lit(rule["rule_id"])) for rule, condition, error in _compiled(df, own) if not error]
    ids = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    return df.withColumn(column, ids).where(F.size(F.col(f"`{column}`")) > 0)


def clean_rows(df: DataFrame, rules: DataFrame, domain: str) -> DataFrame:
    """The rows of a product that break no rule of its domain."""
    own = _rules_of({"": df}, {"": domain}, rules)[0][2]
    for _, condition, error in _compiled(df, own):
        if not error:
            df = df.where(F.coalesce(condition, F.lit(True)))
    return df
