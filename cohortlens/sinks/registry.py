"""Fitted models by key: a folder per model and a table of what is there."""

from __future__ import annotations

import warnings

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.operators.frames import last_by
from cohortlens.operators.sequential import StepIntervalModel

KEYS = ["family", "year", "model", "n", "method"]
SCHEMA = "family string, year int, model string, n int, method string, kind string, path string, saved timestamp"
KINDS = {
    "pipeline": PipelineModel,
    "interval": StepIntervalModel,
    "forest": RandomForestClassificationModel,
}


class ModelRegistry:
    """Models saved under ``root``, found by (family, year, model, n, method)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model, family: str, year: int, name: str, n: int, method: str = "") -> str:
        kind = next(k for k, c in KINDS.items() if isinstance(model, c))
        path = f"{self.root}/models/{family}/{year}/{name}/{n}/{method or 'default'}"
        if kind == "interval":
            model.save(path)
        else:
            model.write().overwrite().save(path)
        row = self.spark.createDataFrame(
            [(family, year, name, n, method, kind, path)], SCHEMA.rsplit(", saved", 1)[0]
        )
        row.withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.root}/entries"
        )
        return path

    def entries(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/entries")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return last_by(rows, KEYS, ["saved"])

    def preferred(self, family: str, years: list[int]) -> DataFrame:
        """Entries of the first of ``years`` that has the family at all."""
        order = F.array_position(F.array(*[F.lit(y) for y in years]), F.col("year"))
        listed = self.entries().where((F.col("family") == family) & F.col("year").isin(years))
        best = Window.partitionBy("family")
        ranked = listed.withColumn("_o", order).withColumn("_best", F.min("_o").over(best))
        return ranked.where(F.col("_o") == F.col("_best")).drop("_o", "_best")

    def load_all(self, family: str, years: list[int]) -> dict[tuple, object]:
        """Models of the preferred year by (model, n, method); a later choice warns."""
        rows = self.preferred(family, years).collect()
        if not rows:
            raise FileNotFoundError(f"no {family} models for {years}")
        if rows[0].year != years[0]:
            warnings.warn(f"no {family} models for {years[0]}, using {rows[0].year}", stacklevel=2)
        return {(r.model, r.n, r.method): KINDS[r.kind].load(r.path) for r in rows}
