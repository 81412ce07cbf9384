"""The catalogue of loaded, versioned index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableRepository:
    """Index tables by ``name-version``; each is a temporary view, cached until it is removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.loaded: dict[tuple[str, str], DataFrame] = {}

    @staticmethod
    def view(name: str, version: str) -> str:
        return f"{name}_{version}".replace("-", "_").replace(".", "_")

    def create(self, name: str, version: str, source: DataFrame | str, cache: bool = True) -> DataFrame:
        """Load a table from a frame or a Parquet path; a loaded one is returned as it is."""
        if (name, version) not in self.loaded:
            df = self.spark.read.parquet(source) if isinstance(source, str) else source
            if cache:
                df = df.cache()
            df.createOrReplaceTempView(self.view(name, version))
            self.loaded[name, version] = df
        return self.loaded[name, version]

    def get(self, name: str, version: str) -> DataFrame | None:
        return self.loaded.get((name, version))

    def remove(self, name: str, version: str) -> None:
        """Drop a table; one that isn't loaded is no error."""
        df = self.loaded.pop((name, version), None)
        if df is not None:
            self.spark.catalog.dropTempView(self.view(name, version))
            df.unpersist()

    def remove_unused(self, used: dict[str, set[str]]) -> list[tuple[str, str]]:
        """Drop every table that isn't listed; returns those dropped."""
        gone = [key for key in self.loaded if key[1] not in used.get(key[0], set())]
        for key in gone:
            self.remove(*key)
        return gone
