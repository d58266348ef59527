"""Small lookup dimensions and their DataFrame form.

All of them are fixed, tiny tables (44, 44, 10, 7, 5 and 12 rows), which is what makes broadcasting them safe
at any data size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .guides import FIX_GUIDES
from .rules import DEFAULT_RULES, Rule

# Keys, labels and colours of the report's dimensions, in catalogue order.
SEVERITIES = ((1, "info"), (2, "minore"), (3, "media"), (4, "alta"), (5, "critica"))
CATEGORIES = (
    ("compute", "Calcolo / CPU", "#e4572e"),
    ("memory", "Memoria", "#f3a712"),
    ("network", "Rete & I/O", "#2e86ab"),
    ("data", "Dati & Storage", "#8d6a9f"),
    ("observability", "Osservabilità", "#5b8c5a"),
    ("dependencies", "Dipendenze", "#b07156"),
    ("energy", "Energia & Runtime", "#d64550"),
    ("assets", "Asset", "#5e7ce2"),
    ("infra", "Infrastruttura", "#3a7ca5"),
    ("sci", "Software Carbon Intensity (SCI)", "#1b998b"),
)
# Letter, lowest score of the band, colour, label.
GRADE_BANDS = (
    ("A", 90.0, "#2e7d32", "Eccellente"),
    ("B", 80.0, "#558b2f", "Ottimo"),
    ("C", 70.0, "#9e9d24", "Buono"),
    ("D", 60.0, "#f9a825", "Sufficiente"),
    ("E", 45.0, "#ef6c00", "Migliorabile"),
    ("F", 25.0, "#d84315", "Scarso"),
    ("G", 0.0, "#b71c1c", "Critico"),
)
# Package names counted as heavy; the remarks are our own.
HEAVY_DEPENDENCIES = (
    ("tensorflow", "very large machine learning framework"),
    ("torch", "very large machine learning framework"),
    ("pytorch", "very large machine learning framework"),
    ("selenium", "starts a complete browser"),
    ("puppeteer", "downloads and runs a browser"),
    ("playwright", "downloads several browsers"),
    ("electron", "ships a browser runtime"),
    ("moment", "large date library with lighter successors"),
    ("pandas", "large memory footprint for simple uses"),
    ("scipy", "large scientific library"),
    ("opencv-python", "large computer vision library"),
    ("lodash", "often replaceable by built-in methods"),
)


def rules_df(spark: SparkSession, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    rows = [
        (r.id, r.name, r.category, r.severity, r.detector, list(r.languages), r.pattern, r.require_absent,
         r.ignore_case, r.linear, list(r.hints), r.description, r.remediation)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, name string, category string, severity int, detector string, languages array<string>, "
        "pattern string, require_absent string, ignore_case boolean, linear string, hints array<string>, "
        "description string, remediation string",
    )


def severities_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES), "severity int, severity_label string")


def categories_df(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, category string, label string, color string")


def grade_bands_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(GRADE_BANDS), "grade string, min_score double, grade_color string, grade_label string"
    )


def heavy_dependencies_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HEAVY_DEPENDENCIES), "name string, note string")


def fix_guides_df(spark: SparkSession) -> DataFrame:
    rows = [
        (rule_id, list(g.steps), g.bad, g.good, g.language, g.note, g.has_example) for rule_id, g in FIX_GUIDES.items()
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, steps array<string>, bad string, good string, language string, note string, "
        "has_example boolean",
    )
