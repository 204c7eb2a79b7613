"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship",
    "preprocess_text",
    "valid_pairs",
    "cap_per_language",
    "load_stats",
    "build_corpus",
    "parse_tagged_lines",
    "seeded_shuffle",
    "split_exact",
    "split_hash",
    "assign_batches",
    "split_sentences",
    "word_freq",
    "vocab_lookup",
    "pad_or_trim",
    "bigram_scores",
    "beam_prune",
    "corpus_bleu",
    "best_and_worst",
    "masked_token_loss",
    "running_loss",
    "average_vectors",
    "translate_documents",
    "process_requests",
    "pivot_pairs",
    "debounce",
]


def main() -> None:
    from bitexture.plans.catalog import QUERIES
    from bitexture.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        # every output column is computed, nothing is collected
        QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    def parse(lines: int = 255_000) -> float:
        """Parsing of a prepared file of so many tagged lines."""
        from pyspark.sql import functions as F

        from bitexture.plans.inputs import tagged_lines
        from bitexture.session import shared_dir
        from bitexture.sources.text import read_tagged_tsv

        some = tagged_lines(spark, sf).select("value")
        path = f"{shared_dir(spark)}/bench-lines"
        copies = F.explode(F.sequence(F.lit(0), F.lit(lines // max(1, some.count()))))
        some.withColumn("k", copies).select("value").limit(lines).write.mode("overwrite").text(path)
        start = time.perf_counter()
        read_tagged_tsv(spark, path)[0].write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in ("strip_control", "valid_pairs", "flagship"):  # starts workers, compiles code
        run(name)
    times = {name: run(name) for name in names if name != "parse_255k_lines"}
    if names is HEADLINE or names == ["parse_255k_lines"]:
        times["parse_255k_lines"] = parse()
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
