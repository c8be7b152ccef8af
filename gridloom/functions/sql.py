"""Our scalar operators as SQL functions of a session: SQL bodies that Catalyst inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BODIES = {
    "smoothstep(x DOUBLE)": "pow(least(1D, greatest(0D, x)), 2) * (3 - 2 * least(1D, greatest(0D, x)))",
    "smootherstep(x DOUBLE)": "pow(least(1D, greatest(0D, x)), 3) * (least(1D, greatest(0D, x)) * (least(1D, greatest(0D, x)) * 6 - 15) + 10)",
    "decibels(x DOUBLE)": "20 * log10(greatest(x, 1e-8D))",
    "related_bpm(source DOUBLE, target DOUBLE)": (
        "element_at(array_sort(transform(array(0.5D, 1D, 2D), (m, i) -> struct(abs(log2(greatest(source * m, 1e-6D) / greatest(target, 1e-6D))) AS d, i AS i, source * m AS b))), 1).b"
    ),
    "fold_bpm(bpm DOUBLE)": "CASE WHEN bpm < 70 THEN bpm * pow(2, ceil(log2(70 / bpm))) WHEN bpm > 190 THEN bpm * pow(2, -ceil(log2(bpm / 190))) ELSE bpm END",
    "clock_text(seconds DOUBLE)": "format_string('%02d:%02d', CAST(floor(greatest(seconds, 0D) / 60) AS BIGINT), CAST(floor(greatest(seconds, 0D)) AS BIGINT) % 60)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for head, body in BODIES.items():
        kind = "STRING" if head.startswith("clock") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in BODIES]
