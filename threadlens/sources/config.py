"""Search terms and stop words from configuration files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from threadlens.operators.selection import term_rows
from threadlens.runtime import snapshot
from threadlens.schemas import STOPWORDS, TERMS


def load_config(path: str | Path) -> dict:
    """A YAML or JSON configuration file as a dict."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML needs PyYAML; give the configuration as JSON instead") from error
    return yaml.safe_load(text)


def terms_table(spark: SparkSession, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """(lang, term, lang_rank, term_rank) in configured order.

    Written once, so that the planner knows its size: rows made on the driver count as a table of unknown size, and
    a join with it would send all texts of a language to one task.
    """
    rows = [(r["lang"], r["term"], r["lang_rank"], r["term_rank"]) for r in term_rows(terms)]
    return snapshot(spark.createDataFrame(rows, TERMS), "terms")


def stopwords_table(spark: SparkSession, config: Mapping[str, Sequence[str]]) -> DataFrame:
    return snapshot(spark.createDataFrame([(k, w) for k, listed in config.items() for w in listed], STOPWORDS), "stopwords")
