"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name: what it measures
HEADLINE = (
    "links", "paragraph_text", "tag_histogram", "descendant", "child_chain", "sibling_chain", "selector_list", "nth_odd", "attr_substr", "select_first_link",
    "scoped_select", "xpath_desc", "xpath_abs", "xpath_text", "ancestors_depth", "bfs_order", "to_html", "document_text_length", "tokens_by_kind", "delimiters",
    "parse_bytes", "stream_chunks", "early_stop_first_article", "escape_text", "unescape_roundtrip", "find_by_class", "document_index",
)
#: How often the pages are repeated to measure speed.
COPIES = 10


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "1m")  # the tables are small, and parsing is what takes time
        .config("spark.checkpoint.dir", f"file://{folder}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomdoc.plans.inside import Path, find
    from loomdoc.queries import QUERIES
    from loomdoc.sources import dom

    def run(f) -> float:
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    run(lambda: QUERIES["links"](spark, sf_dir))  # starts the workers
    seconds = {name: round(run(lambda name=name: QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}
    # many pages, so that what a page costs counts and not what a job costs
    many = pages.withColumn("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(COPIES)), lambda i: i * 1_000_000 + F.col("page_id")))).repartition(4 * int(cpus), "page_id")
    many.write.parquet(f"{folder}/many")
    many = spark.read.parquet(f"{folder}/many")
    megabytes = many.agg(F.sum(F.octet_length("html"))).first()[0] / (1 << 20)
    speeds = {"parse": lambda: dom.parse(many), "path": lambda: find(many, Path().select("nav li a[href]"), ("attrs", "text_content")), "tokens": lambda: dom.tokens(many)}
    rates = {f"{name}_mib_per_s": round(megabytes / run(f), 2) for name, f in speeds.items()}
    rates |= {f"{k}_per_core": round(v / int(cpus), 2) for k, v in rates.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "mib": round(megabytes, 1), **rates, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
