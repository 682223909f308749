"""Service configuration: the dimension table that drives every other operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.text import (
    first_match_by_column,
    java_pattern,
    java_rule,
    substitute,
    substitute_by_column,
    trace_group,
)
from emberlog.operators.joins import is_small, sized
from emberlog.schemas import REGEX_SUB, SERVICE
from emberlog.session import written

# What a new service gets when a field is not given.
DEFAULTS = {
    "is_train": False,
    "threshold": -470.2,
    "coreset_size": 2,
    "enable_trace": False,
    "top_k": 80,
    "max_pretrain": 10_000,
    "context_size": 512,
    "lr_pretraining": 1e-4,
    "lr_finetuning": 1e-6,
    "train_batch_size": 16,
    "num_episodes": 10,
    "num_epochs": 10,
    "vocab_size": 500,
}
# Smallest accepted settings, and the longest description.
MINIMUMS = {
    "top_k": 1,
    "max_pretrain": 1000,
    "vocab_size": 1,
    "train_batch_size": 1,
    "num_episodes": 1,
    "num_epochs": 1,
    "coreset_size": 1,
}
MAX_DESCRIPTION = 450

CONFIG_FIELDS = [f.name for f in SERVICE if f.name not in ("id", "name", "description")]
# more services, or more different settings, than this are joined instead of being held as literals
MAX_LITERAL_SERVICES = 1_000
MAX_LITERALS = 32


def conform(services: DataFrame) -> DataFrame:
    """Add the fields that are missing, as NULL, and cast the others to the service schema."""
    return services.select(
        *[
            (F.col(f.name) if f.name in services.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SERVICE
        ]
    )


def with_defaults(services: DataFrame) -> DataFrame:
    services = conform(services)
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULTS.items()}
    filled["regex_subs"] = F.coalesce(F.col("regex_subs"), F.array().cast(T.ArrayType(REGEX_SUB)))
    return services.withColumns({n: c.cast(SERVICE[n].dataType) for n, c in filled.items()})


def create(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """New service rows with defaults; a name that exists or repeats is not created twice."""
    fresh = conform(requests).join(existing.select("name"), "name", "left_anti").select(*SERVICE.names)
    first = fresh.groupBy("name").agg(F.min_by(F.struct(*SERVICE.names), F.col("id")).alias("s")).select("s.*")
    return with_defaults(first)


def patch(services: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite the fields that a patch row (by ``id``) supplies."""
    fields = [f for f in SERVICE.names if f != "id" and f in patches.columns]
    given = patches.select("id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = services.join(sized(given), "id", "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{f}").cast(SERVICE[f].dataType), F.col(f)).alias(f) if f in fields else F.col(f)
            for f in services.columns
        ]
    )


def delete(services: DataFrame, ids: DataFrame) -> DataFrame:
    return services.join(ids.select("id"), "id", "left_anti")


def config_by_name(services: DataFrame) -> DataFrame:
    """Lookup table: name → config struct, without ids and descriptions."""
    return services.select("name", F.struct(*CONFIG_FIELDS).alias("config"))


def clean_rules(services: DataFrame) -> DataFrame:
    """Drop substitution rows whose fields are both empty."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    kept = F.filter("regex_subs", lambda r: ~(blank(r["pattern"]) & blank(r["replacement"])))
    return services.withColumn("regex_subs", kept)


def violations() -> Column:
    """Names of the fields that break a rule, as ``array<string>``."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = {
        "name": blank(F.col("name")),
        "description": F.length("description") > MAX_DESCRIPTION,
        "regex_subs": F.exists("regex_subs", lambda r: blank(r["pattern"]) & ~blank(r["replacement"])),
        **{field: F.col(field) < low for field, low in MINIMUMS.items()},
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(field)) for field, broken in checks.items()]))


def validate(services: DataFrame) -> DataFrame:
    return clean_rules(services).withColumn("violations", violations())


def attach(logs: DataFrame, services: DataFrame, fields: list[str]) -> DataFrame:
    """Left-join config ``fields`` onto rows with a ``service`` column."""
    wanted = services.select(F.col("name").alias("service"), *fields)
    return logs.join(sized(wanted, of=services), "service", "left")


_RULES = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("replacement", T.StringType())]))
_TRACE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("index", T.IntegerType())])


def _java_rules(subs: list | None) -> list[tuple]:
    return [java_rule(r["pattern"], r["replacement"]) for r in subs or []]


def _java_trace(enabled: bool | None, pattern: str | None) -> tuple | None:
    return (java_pattern(pattern), trace_group(pattern)) if enabled and pattern else None


def compiled(services: DataFrame) -> DataFrame:
    """service, _rules and _trace of every service, translated once per service and not per log."""
    rules, trace = F.udf(_java_rules, _RULES), F.udf(_java_trace, _TRACE)
    return services.select(
        F.col("name").alias("service"),
        rules("regex_subs").alias("_rules"),
        trace("enable_trace", "trace_regex").alias("_trace"),
    )


def few_kinds(kinds: DataFrame) -> bool:
    """True for so few different settings that they may be literals in a plan."""
    return is_small(kinds, MAX_LITERALS)


def by_service(services: DataFrame, field: str, literal, joined, default: Column):
    """Function logs → Column and logs to take it from, for a setting that differs by service.

    Up to ``MAX_LITERALS`` different settings become one expression each, chosen by the service's
    name, so that patterns are compiled once per task and nothing is joined; more are joined.
    Both read the same translated setting.
    """
    # stored, as distinct settings of services that are made from a larger table may be translated once per row of that
    table = written(compiled(services).select("service", field), "service-settings")
    grouped = table.filter(F.col(field).isNotNull()).groupBy(field).agg(F.collect_set("service").alias("names"))
    if is_small(table, MAX_LITERAL_SERVICES) and few_kinds(table.select(field).distinct()):
        kinds = [(row[field], row["names"]) for row in grouped.collect()]
        chosen = [F.when(F.col("service").isin(names), literal(kind)) for kind, names in kinds]
        return lambda logs: (logs, F.coalesce(*chosen, default) if chosen else default)

    def by_join(logs: DataFrame) -> tuple[DataFrame, Column]:
        found = logs.join(sized(table), "service", "left")
        return found, F.when(F.col(field).isNotNull(), joined(F.col(field))).otherwise(default)

    return by_join


def clean_text(services: DataFrame, text: str = "original_text"):
    """Function logs → logs that adds ``cleaned_text``: the service's rules as ``re.sub`` applies them, in order."""

    def literal(rules) -> Column:
        return substitute(F.col(text), [(r["pattern"], r["replacement"]) for r in rules])

    choose = by_service(services, "_rules", literal, lambda rules: substitute_by_column(F.col(text), rules), F.col(text))

    def cleaned(logs: DataFrame) -> DataFrame:
        found, column = choose(logs)
        return found.withColumn("cleaned_text", column).drop("_rules")

    return cleaned


def trace_ids(services: DataFrame, text: str = "original_text"):
    """Function logs → logs that adds ``trace_id``; NULL when tracing is off or nothing matches."""

    def literal(trace) -> Column:
        found = F.regexp_extract(F.col(text), trace["pattern"], trace["index"])
        return F.when(F.regexp_like(F.col(text), F.lit(trace["pattern"])), found)

    choose = by_service(
        services,
        "_trace",
        literal,
        lambda t: first_match_by_column(F.col(text), t["pattern"], t["index"]),
        F.lit(None).cast("string"),
    )

    def traced(logs: DataFrame) -> DataFrame:
        found, column = choose(logs)
        return found.withColumn("trace_id", column).drop("_trace")

    return traced
