"""Headline queries, timed on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and is then timed once more in full, written to the
``noop`` sink so that all rows and columns are computed.  The given tables are files of a
single row group, which one task would read alone; they are first written anew, untimed,
as two files for each core, as a large table would be found.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from quire.plans.queries import queries
from quire.session import build_session

HEADLINE = (
    "partition_text",
    "partition_html",
    "element_language",
    "page_numbers",
    "text_metrics",
    "type_counts",
    "contacts",
    "clean_text",
    "chunk_basic",
    "chunk_by_title",
    "image_hash_prefix",
    "image_manifest",
    "rag_jsonl",
    "rag_pages",
    "rag_image_join",
    "vision_enrich",
    "all_formats",
    "render_html",
    "render_markdown",
    "render_slides",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "quire-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    split_dir = tempfile.mkdtemp(prefix="quire-bench-")
    for name in ("documents", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2 * int(cpus)).write.parquet(f"{split_dir}/{name}.parquet")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, split_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "documents": documents,
                "cpus": int(cpus),
                "files": 2 * int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
