"""Service table operators; registrations come from ``customer``, patches from ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import services as s
from emberlog.plans import views as v
from emberlog.plans.registry import query


def requests(spark, sf_dir):
    """Registrations with some fields left open; every name appears twice, customers 0 mod 5 exist already."""
    customer = v.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return customer.select(
        F.lpad(key.cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("service-"), F.floor(key / 2).cast("string")).alias("name"),
        F.when(key % 7 == 0, F.repeat(F.lit("x"), (key % 900).cast("int"))).otherwise(F.col("c_mktsegment")).alias("description"),
        F.when(key % 3 == 0, F.col("c_nationkey") % 2 == 0).alias("is_train"),
        F.when(key % 4 == 0, F.col("c_acctbal")).alias("threshold"),
        F.when(key % 5 != 0, (key % 6).cast("int")).alias("top_k"),
        F.when(key % 6 != 0, (key % 3000).cast("int")).alias("max_pretrain"),
        F.when(key % 8 == 0, (key % 3).cast("int")).alias("num_epochs"),
    )


def existing(spark, sf_dir):
    return requests(spark, sf_dir).filter(F.col("id").cast("long") % 10 == 0)


def stored(spark, sf_dir):
    """A stored table: one service per customer, defaults filled in."""
    return s.with_defaults(requests(spark, sf_dir).withColumn("name", F.concat("name", F.lit("/"), "id")))


REQUESTS = """requests AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, 'service-' || (c_custkey // 2) AS name,
  CASE WHEN c_custkey % 7 = 0 THEN repeat('x', CAST(c_custkey % 900 AS INTEGER)) ELSE c_mktsegment END AS description,
  CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 2 = 0 END AS is_train,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS threshold,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 6 END AS top_k,
  CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 3000 END AS max_pretrain,
  CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 3 END AS num_epochs FROM customer)"""
FILLED = """coalesce(is_train, false) AS is_train, coalesce(threshold, -470.2) AS threshold, coalesce(top_k, 80) AS top_k,
  coalesce(max_pretrain, 10000) AS max_pretrain, coalesce(num_epochs, 10) AS num_epochs, 2 AS coreset_size,
  false AS enable_trace, CAST(NULL AS VARCHAR) AS trace_regex, 512 AS context_size, 1e-4 AS lr_pretraining,
  1e-6 AS lr_finetuning, 16 AS train_batch_size, 10 AS num_episodes, 500 AS vocab_size"""
FLAT = [
    "is_train", "threshold", "top_k", "max_pretrain", "num_epochs", "coreset_size", "enable_trace", "trace_regex",
    "context_size", "lr_pretraining", "lr_finetuning", "train_batch_size", "num_episodes", "vocab_size",
]
STORED = f"{REQUESTS}, stored AS (SELECT id, name || '/' || id AS name, description, {FILLED} FROM requests)"


@query(
    "B1_create_services",
    f"""WITH {REQUESTS} SELECT id, name, description, {FILLED} FROM (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM requests
        WHERE name NOT IN (SELECT name FROM requests WHERE CAST(id AS BIGINT) % 10 = 0)) WHERE rn = 1""",
)
def create(spark, sf_dir):
    return s.create(existing(spark, sf_dir), requests(spark, sf_dir)).select("id", "name", "description", *FLAT)


@query(
    "B2_patch_services",
    f"""WITH {STORED} SELECT id, name, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, description) AS description,
        coalesce(s_suppkey % 2 = 1, is_train) AS is_train, top_k, coalesce(s_acctbal, threshold) AS threshold
        FROM stored LEFT JOIN supplier ON s_suppkey * 3 = CAST(id AS BIGINT)""",
)
def patch(spark, sf_dir):
    patches = v.table(spark, sf_dir, "supplier").select(
        F.lpad((F.col("s_suppkey") * 3).cast("string"), 12, "0").alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("description"),
        (F.col("s_suppkey") % 2 == 1).alias("is_train"),
        F.col("s_acctbal").alias("threshold"),
    )
    return s.patch(stored(spark, sf_dir), patches).select("id", "name", "description", "is_train", "top_k", "threshold")


@query(
    "B3_delete_services",
    f"""WITH {STORED} SELECT id, name FROM stored WHERE CAST(id AS BIGINT) NOT IN (SELECT s_suppkey * 3 FROM supplier)""",
)
def delete(spark, sf_dir):
    ids = v.table(spark, sf_dir, "supplier").select(F.lpad((F.col("s_suppkey") * 3).cast("string"), 12, "0").alias("id"))
    return s.delete(stored(spark, sf_dir), ids).select("id", "name")


@query(
    "B4_config_by_name",
    f"WITH {STORED} SELECT name, is_train, threshold, top_k, max_pretrain, context_size, vocab_size FROM stored",
)
def by_name(spark, sf_dir):
    lookup = s.config_by_name(stored(spark, sf_dir))
    fields = ("is_train", "threshold", "top_k", "max_pretrain", "context_size", "vocab_size")
    return lookup.select("name", *[F.col(f"config.{f}").alias(f) for f in fields])


@query(
    "B4_attach_config",
    v.with_views("logs", "services")
    + "SELECT log_id, is_train, threshold, top_k FROM logs JOIN services ON service = name",
)
def attach(spark, sf_dir):
    joined = s.attach(v.logs(spark, sf_dir), v.services(spark, sf_dir), ["is_train", "threshold", "top_k"])
    return joined.select("log_id", "is_train", "threshold", "top_k")


@query(
    "B6_validate_services",
    f"""WITH {STORED} SELECT id, concat_ws(',', CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'name' END,
          CASE WHEN length(description) > 450 THEN 'description' END,
          CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 'regex_subs' END,
          CASE WHEN top_k < 1 THEN 'top_k' END, CASE WHEN max_pretrain < 1000 THEN 'max_pretrain' END,
          CASE WHEN num_epochs < 1 THEN 'num_epochs' END) AS violations,
        CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS n_rules FROM stored""",
)
def validate(spark, sf_dir):
    kind = F.col("id").cast("long") % 4
    rule = F.struct(
        F.when(kind.isin(0, 3), "a+").otherwise("").alias("pattern"),
        F.when(kind.isin(0, 1), "B").otherwise("").alias("replacement"),
    )
    drafts = stored(spark, sf_dir).withColumns(
        {"name": F.when(F.col("id").cast("long") % 13 == 0, "").otherwise(F.col("name")), "regex_subs": F.array(rule)}
    )
    return s.validate(drafts).select(
        "id", F.array_join("violations", ",").alias("violations"), F.size("regex_subs").alias("n_rules")
    )
