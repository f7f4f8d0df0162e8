"""Labels of every fold count for sites."""

import zlib

from tessera.llm import quality_classifier


def test_sites_count_the_held_out_fold(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0][:10]
    rest = [i for i in range(200) if i not in held]
    docs = spark.createDataFrame([(i, "some words here", "tiny" if i in held else "big", "a") for i in range(200)], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, 0) for i in held] + [(i, 1) for i in rest], "doc_id long, quality int")
    rates, s = quality_classifier.site_rates(docs, labels)
    by = {r["host"]: r for r in rates.collect()}
    assert by["tiny"]["labelled"] == 10 and by["big"]["labelled"] == 190 and abs(s.mean - 191 / 202) < 1e-9
    assert by["tiny"]["path_rate"] < 0.5 < by["big"]["path_rate"]
