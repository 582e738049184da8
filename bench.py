"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every job is run once to warm up and then BENCH_RUNS times (2 by default); the median counts.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakegauge.operators import findings as fi, numeric as nu, values as va
from lakegauge.plans import profile as pr
from lakegauge.sources import readers as rd
from workload import anomalies, business, findings, quality, relations, sources
from workload.common import table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def docs(s, d):
    """The test file has one row group, hence one scan task: spread it over the cores first."""
    return rd.spread(findings.docs(s, d), int(CPUS))


def jobs():
    return {
        "scan_sums": lambda s, d: sources.QUERIES["a1_scan"](s, d),
        "moments_lineitem": lambda s, d: nu.moments(nu.numbers(table(s, d, "lineitem"), "lineitem")),
        "exact_quantiles_lineitem": lambda s, d: nu.quantiles(nu.numbers(table(s, d, "lineitem"), "lineitem"),
                                                              {**nu.QUARTILES, **nu.PERCENTILES}),
        "value_frequencies_lineitem": lambda s, d: va.uniqueness(va.value_counts(va.cells(table(s, d, "lineitem"), "lineitem"))),
        "full_profile_lineitem": lambda s, d: pr.column_profile(table(s, d, "lineitem"), "lineitem"),
        "full_profile_documents": lambda s, d: pr.column_profile(table(s, d, "documents"), "documents"),
        "text_quality": quality.QUERIES["e1_text_quality"],
        "value_verified_relationships": relations.QUERIES["g14_value_containment"],
        "series_spikes": anomalies.QUERIES["d8_spikes"],
        "dimension_pairs": business.QUERIES["i3_dimension_pairs"],
        "type2_dimension": business.QUERIES["i10_scd2"],
        "findings_parse_and_tag": lambda s, d: fi.findings(docs(s, d)),
        "title_dedup": lambda s, d: fi.deduplicate(fi.titled(fi.items(fi.sections(docs(s, d)))).select(
            "doc_id", "section", "item", "title"), findings.ORDER),
    }


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    seconds = {}
    for name, job in jobs().items():
        if wanted and name not in wanted:
            continue
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            job(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, [round(t, 2) for t in took], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


main()
