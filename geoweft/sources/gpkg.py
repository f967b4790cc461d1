"""GeoPackage tables as a Spark data source: one partition per range of row ids."""
from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# ---- fixed values: GeoPackage column types and Spark's ----
COLUMN_TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "smallint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint",
    "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "BLOB": "binary",
}
# -----------------------------------------------------------
ROWS_PER_PARTITION = 200_000


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoweft_gpkg"

    def _table(self, con) -> str:
        return self.options.get("table") or con.execute("SELECT table_name FROM gpkg_contents ORDER BY rowid LIMIT 1").fetchone()[0]

    def _layout(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            table = self._table(con)
            found = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
            cols = [(r[1], r[2].split("(")[0].upper()) for r in con.execute(f'PRAGMA table_info("{table}")')]
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        return table, found and found[0], cols, low, high

    def schema(self):
        _, geom, cols, _, _ = self._layout()
        fields = ["__rowid BIGINT"]
        for name, kind in cols:
            quoted = "`" + name.replace("`", "``") + "`"
            fields.append("__blob BINARY" if name == geom else f"{quoted} {COLUMN_TYPES.get(kind, 'string')}")
        return ", ".join(fields)

    def reader(self, schema):
        table, geom, cols, low, high = self._layout()
        return GeoPackageReader(self.options["path"], table, [c for c, _ in cols], dict(cols), geom, low, high)


class GeoPackageReader(DataSourceReader):
    def __init__(self, path, table, names, kinds, geom, low, high):
        self.path, self.table, self.names, self.kinds, self.geom, self.low, self.high = path, table, names, kinds, geom, low, high

    def partitions(self):
        if self.low is None:
            return [RowRange(0, -1)]
        return [RowRange(a, min(a + ROWS_PER_PARTITION - 1, self.high)) for a in range(self.low, self.high + 1, ROWS_PER_PARTITION)]

    def read(self, partition):
        listed = ", ".join('"' + n.replace('"', '""') + '"' for n in self.names)
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            for row in con.execute(f'SELECT rowid, {listed} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield (row[0], *[self._value(n, v) for n, v in zip(self.names, row[1:])])
        finally:
            con.close()

    def _value(self, name, value):
        kind = COLUMN_TYPES.get(self.kinds[name], "string")
        if value is None or name == self.geom:
            return value
        if kind == "boolean":
            return bool(value)
        return float(value) if kind == "double" else str(value) if kind == "string" else value
