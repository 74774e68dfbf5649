"""Rules on texts against plain Python."""

import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx


def test_document_ids_look_for_what_stays(spark):
    """The rule by replacement, on odd texts; the column itself looks for what stays, which is faster on long texts."""
    texts = [None, "", " ", "?!", "_", "__a__", " a b ", "a_ b", "a _b", "\ta\n", "가 힣_나?", "é1é", "a" * 50 + "?" * 50, "-.-", "😀x😀y", "_?_", "x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.doc_id(F.col("t")).alias("clean"))
    want = [re.sub("[^0-9a-zA-Z가-힣_.-]+", "_", (t or "").strip(" ")).strip("_") or "doc" for t in texts]
    assert [r["clean"] for r in df.orderBy("i").collect()] == want
    assert "regexp_extract_all" in df._jdf.queryExecution().toString() and "regexp_replace" not in df._jdf.queryExecution().toString()
