"""Descriptors of a run, read from its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a run's name spells its descriptors (fixed formats).
PARTS = {
    "loss_version": (r"(?:^|-)lv_(\d+)", "int"),
    "batch_size": (r"(?:^|-)bs_(\d+)", "int"),
    "epochs": (r"(?:^|-)epochs?_(\d+)", "int"),
    "condvec": (r"(?:^|-)condvec_(\d+)", "int"),
    "rownum": (r"(?:^|-)rownum_(\d+)", "int"),
    "weight_corr": (r"losscorcorr_([0-9.eE+-]+?)(?=-[a-z]|$)", "double"),
    "weight_dis": (r"lossdis_([0-9.eE+-]+?)(?=-[a-z]|$)", "double"),
}


def descriptors(name: Column) -> list[Column]:
    """Dataset, model, whether it is a test run, and every part that the name holds (null where it does not)."""
    bare = F.regexp_replace(name, "^test-", "")
    found = [F.regexp_extract(bare, p, 1).try_cast(t).alias(k) for k, (p, t) in PARTS.items()]
    return [F.element_at(F.split(bare, "-"), 1).alias("dataset"), F.get(F.split(bare, "-"), 1).alias("model"), name.startswith("test-").alias("is_test"), *found]


def parse_runs(df: DataFrame, name: str = "run") -> DataFrame:
    return df.select(name, *descriptors(F.col(name)))
