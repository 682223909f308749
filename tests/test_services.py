from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.operators import services as ops


def table(spark):
    return ops.with_defaults(
        spark.createDataFrame([("1", "api", "main"), ("2", "web", None)], "id string, name string, description string")
    )


def test_defaults(spark):
    row = table(spark).filter("id = '1'").first()
    assert {k: row[k] for k in ops.DEFAULTS} == ops.DEFAULTS
    assert row.regex_subs == [] and row.trace_regex is None


def test_create_skips_known_and_repeated_names(spark):
    requests = spark.createDataFrame(
        [("3", "web", None), ("4", "db", 7), ("5", "db", 9)], "id string, name string, top_k int"
    )
    made = ops.create(table(spark), requests).collect()
    assert [(r.id, r.name, r.top_k, r.coreset_size) for r in made] == [("4", "db", 7, 2)]


def test_patch_and_delete(spark):
    patches = spark.createDataFrame([("1", None, False, 3), ("9", "x", True, 1)], "id string, description string, is_train boolean, top_k int")
    by_id = {r.id: r for r in ops.patch(table(spark), patches).collect()}
    assert set(by_id) == {"1", "2"}
    assert by_id["1"].description == "main" and by_id["1"].top_k == 3 and by_id["2"].top_k == 80
    left = ops.delete(table(spark), spark.createDataFrame([("2",)], "id string"))
    assert [r.id for r in left.collect()] == ["1"]


def test_config_lookup(spark):
    row = ops.config_by_name(table(spark)).filter("name = 'api'").first()
    assert row.config.threshold == -470.2 and "description" not in row.config.asDict() and "id" not in row.config.asDict()


def test_validate(spark):
    rule = "array<struct<pattern:string,replacement:string>>"
    drafts = spark.createDataFrame(
        [
            ("1", "ok", "d", 5, 5000, [("a", "b"), ("", "")]),
            ("2", "", "d" * 451, 0, 10, [("", "b")]),
            ("3", "empty replacement", None, 1, 1000, [("a", "")]),
        ],
        f"id string, name string, description string, top_k int, max_pretrain int, regex_subs {rule}",
    )
    got = {r.id: (r.violations, len(r.regex_subs)) for r in ops.validate(ops.with_defaults(drafts)).collect()}
    assert got == {"1": ([], 1), "2": (["name", "description", "regex_subs", "top_k", "max_pretrain"], 1), "3": ([], 1)}


@pytest.mark.parametrize("limit", [0, 100])
def test_attach_and_clean_without_literals(spark, limit, monkeypatch):
    """The join path gives the same text as the literal path."""
    monkeypatch.setattr(ops, "MAX_LITERAL_SERVICES", limit)
    services = ops.with_defaults(
        spark.createDataFrame(
            [("1", "api", [("[0-9]+", "N"), ("N", "M")])],
            "id string, name string, regex_subs array<struct<pattern:string,replacement:string>>",
        )
    )
    logs = spark.createDataFrame([("api", "a 12"), ("other", "a 12")], "service string, original_text string")
    got = {r.service: r.cleaned_text for r in ops.clean_text(services)(logs).collect()}
    assert got == {"api": "a M", "other": "a 12"}
    assert ops.attach(logs, services, ["top_k"]).filter(F.col("top_k").isNull()).count() == 1


@pytest.mark.parametrize("n_services", [3, 5000])
def test_any_number_of_rule_sets(spark, n_services):
    """Different rules and trace patterns for every service, in both dialects."""
    rows = [
        (str(i), f"s{i}", [(rf"n(\d)-{i}(?P<e>!)", r"\g<e>\1$")], True, rf"b[(]\d" if i % 2 else rf"\p{{Alpha}}{i}=(\w+)")
        for i in range(n_services)
    ]
    services = ops.with_defaults(
        spark.createDataFrame(
            rows,
            "id string, name string, regex_subs array<struct<pattern:string,replacement:string>>, enable_trace boolean, trace_regex string",
        )
    )
    logs = spark.createDataFrame(
        [(f"s{i}", f"n7-{i}! b(3 k{i}=v{i}") for i in (0, 1, n_services - 1)] + [("other", "n7-1! b(3")],
        "service string, original_text string",
    )
    got = {r.service: (r.cleaned_text, r.trace_id) for r in ops.trace_ids(services)(ops.clean_text(services)(logs)).collect()}
    assert got.pop("other") == ("n7-1! b(3", None)
    for name, found in got.items():
        i = int(name[1:])
        assert found == (f"!7$ b(3 k{i}=v{i}", "b(3" if i % 2 else f"v{i}")


def test_rules_are_translated_once_per_service(spark, monkeypatch, tmp_path):
    """Also where the services are the distinct values of a larger table and share one setting."""
    calls, real = tmp_path / "calls", ops._java_rules
    calls.touch()

    def counted(subs):
        with open(calls, "a") as file:
            file.write("x")
        return real(subs)

    monkeypatch.setattr(ops, "_java_rules", counted)
    names = spark.range(3000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("name")).distinct()
    rule = F.struct(F.lit("[0-9]+").alias("pattern"), F.lit("N").alias("replacement"))
    services = ops.with_defaults(names.withColumn("regex_subs", F.array(rule)))
    logs = spark.createDataFrame([("s1", "a 12")], "service string, original_text string")
    assert ops.clean_text(services)(logs).first().cleaned_text == "a N"
    assert len(calls.read_text()) == 3
