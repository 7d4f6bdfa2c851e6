import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PAGE = "site_id string, run_id string, page_id long, url string, final_url string, status int, content_type string, headers map<string,string>, html string, redirect_chain array<struct<url:string,status:int,location:string>>, depth int, ord long"


@pytest.fixture(scope="session")
def make_pages(spark):
    def build(rows):
        """rows: dicts with at least url and html."""
        full = []
        for i, r in enumerate(rows):
            url = r["url"]
            site = "/".join(url.split("/")[:3])
            full.append(
                (
                    r.get("site_id", site), "r0", i, url, r.get("final_url", url), r.get("status", 200),
                    r.get("content_type", "text/html"), r.get("headers", {"cache-control": "public, max-age=60"}), r["html"],
                    r.get("redirect_chain", []), r.get("depth", 0), i,
                )
            )
        return spark.createDataFrame(full, PAGE)

    return build
