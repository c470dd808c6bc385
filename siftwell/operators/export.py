"""Results of retrieval tests for people and for build servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def junit_cases(judged: DataFrame, name: str = "query_id", passed: str = "passed", reason: str = "reason") -> DataFrame:
    """(name, xml): a test case element for each row."""
    head = F.concat(F.lit('  <testcase name="'), _escaped(F.col(name).cast("string")), F.lit('" classname="golden"'))
    bad = F.concat(head, F.lit('>\n    <failure message="'), _escaped(F.coalesce(F.col(reason), F.lit(""))), F.lit('"/>\n  </testcase>'))
    return judged.select(F.col(name), F.when(F.col(passed), F.concat(head, F.lit("/>"))).otherwise(bad).alias("xml"))


def write_junit(judged: DataFrame, path: str, name: str = "query_id", passed: str = "passed", reason: str = "reason") -> None:
    """One text file in a folder, case by case in order of name; for reports, which are as long as the list of questions."""
    total, failed = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col(passed)).cast("long")), F.lit(0))).first()
    spark = judged.sparkSession
    head = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="GoldenDataset" tests="{total}" failures="{failed}" errors="0">'), (2, "</testsuite>")], "place int, xml string")
    cases = junit_cases(judged, name, passed, reason).select(F.lit(1).alias("place"), F.col(name).alias("name"), "xml")
    head.withColumn("name", F.lit(None).cast(judged.schema[name].dataType)).select("place", "name", "xml").unionByName(cases).coalesce(1).sortWithinPartitions("place", "name").select("xml").write.text(path)
