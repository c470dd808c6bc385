"""python -m siftwell.cli validate PATH [--format json|jsonl|csv|parquet] [--threshold 0.6] [--output FOLDER]
python -m siftwell.cli health STORE [--as-of TIMESTAMP] [--topics A,B]"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunk_score as C
from .operators import duplicates as D
from .operators import health as H
from .operators.ingest import validated_batch
from .operators.store import Store
from .sources.readers import load_chunks


def validate(spark: SparkSession, path: str, kind: str = "json", threshold: float = 0.6, output: str | None = None) -> DataFrame:
    """The batch report of a file's chunks; a chunk passes from the threshold on and without an error. output: the chunks with their verdicts, as JSON lines."""
    v = validated_batch(load_chunks(spark, path, kind))
    v = v.withColumn("passed", (F.col("score") >= threshold) & ~F.exists("issues", lambda x: x["severity"] == "error"))
    if output:
        v.select("id", "score", "passed", "issues").write.mode("overwrite").json(output)
    return C.report(v)


def health(spark: SparkSession, store: str, as_of: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """One row about a store: see operators.health.roll_up."""
    rows = Store(spark, store).get_all()
    if rows is None:
        raise ValueError(f"there is no store at {store}")
    when = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    found = D.near(D.item_sets(rows, D.shingles(F.col("text"))), 0.9)
    stale = H.staleness_report(H.staleness(rows, when, created="created_at" if "created_at" in rows.columns else None))
    return H.roll_up(stale, rows.agg(F.avg("quality_score").alias("avg_quality")), D.group_report(rows, found), H.coverage(rows, topics) if topics else None)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("validate")
    a.add_argument("path")
    a.add_argument("--format", default="json")
    a.add_argument("--threshold", type=float, default=0.6)
    a.add_argument("--output")
    b = sub.add_parser("health")
    b.add_argument("store")
    b.add_argument("--as-of")
    b.add_argument("--topics", type=lambda x: x.split(","))
    args = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = validate(spark, args.path, args.format, args.threshold, args.output) if args.command == "validate" else health(spark, args.store, args.as_of, args.topics)
    print(df.toJSON().first())


if __name__ == "__main__":
    main()
