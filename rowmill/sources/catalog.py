"""Table definitions and the views made from them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rowmill.sources.ddl import TableDef, parse_create_table
from rowmill.sources.delimited import read_delimited
from rowmill.sources.loader import load_table


class Catalog:
    """Definitions by case-insensitive name. ``data`` holds ``NAME.dat`` files, ``store`` loaded Parquet tables.

    A table is read from the store once it has been loaded there, else from its text file.
    """

    def __init__(self, spark: SparkSession, data: str | None = None, store: str | None = None):
        self.spark, self.data, self.store = spark, data, store
        self.tables: dict[str, TableDef] = {}

    def define(self, sql: str) -> TableDef:
        definition = parse_create_table(sql)
        self.tables[definition.name.upper()] = definition
        return definition

    def text_path(self, name: str) -> str:
        if not self.data:
            raise ValueError(f"table {name}: no data directory was given")
        return f"{self.data}/{name.upper()}.dat"

    def stored_path(self, name: str) -> str:
        if not self.store:
            raise ValueError(f"table {name}: no store directory was given")
        return f"{self.store}/{name.upper()}.parquet"

    def is_stored(self, name: str) -> bool:
        """Whether the store has a finished load of the table, asked of the file system that Spark uses."""
        if not self.store:
            return False
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.stored_path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def register(self, sql: str) -> None:
        """CREATE TABLE: note the definition and put a view over the table's data."""
        definition = self.define(sql)
        name = definition.name
        frame = self.spark.read.parquet(self.stored_path(name)) if self.is_stored(name) else read_delimited(self.spark, self.text_path(name), definition.schema)
        frame.createOrReplaceTempView(name)

    def load(self, sql: str) -> None:
        """CREATE TABLE in load mode: convert the text file into the store."""
        definition = self.define(sql)
        load_table(self.spark, definition, self.text_path(definition.name), self.stored_path(definition.name))
