"""Settings of a run, read from the Spark session (``spark.finquill.*``); nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    provider: str = "local"
    ocr_model: str = "ocr"
    extraction_model: str = "rules"
    output_dir: str = ""
    max_retries: int = 3
    request_timeout_seconds: float = 120.0
    ocr_start_page: int = 1

    def __post_init__(self):
        if self.ocr_start_page < 1:
            raise ValueError("ocr_start_page is at least 1")

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Each field from spark.finquill.<provider>.<field>, then spark.finquill.<field>, then its default."""
        provider = spark.conf.get("spark.finquill.provider", cls.provider)

        def value(name: str, default):
            raw = spark.conf.get(f"spark.finquill.{provider}.{name}", spark.conf.get(f"spark.finquill.{name}", str(default)))
            return type(default)(raw)

        return cls(**{f.name: provider if f.name == "provider" else value(f.name, f.default) for f in fields(cls)})
