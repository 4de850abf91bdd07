"""A streaming source of Parquet files whose offset is a high-water mark, as a pull of a mailbox keeps one.

    spark.dataSource.register(CursorSource)
    spark.readStream.format("cursor").option("path", …).option("cursor", "received").option("cap", 10_000).load()

The offset is the greatest cursor value that was seen, not one of rows that were kept. A batch holds the rows from
the mark before (included, as more rows with the same value may come) to the new one, so rows at the border come twice: sinks go
by key. A batch that reaches the cap is refused, as a pull that was cut off may have lost older rows; the mark then
stays, and the same window is pulled again, with a larger cap. A first run needs the option bootstrap, and one
that sees nothing leaves no mark. Rows without a cursor value are never pulled.

The driver reads footers of new files, and up to `cap` values where those don't tell how many rows a window has; rows
are read by the tasks, from the row groups that the window meets. The path is one that pyarrow.fs can open on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class BootstrapRequired(RuntimeError):
    """There is no mark yet, and the option bootstrap was not given."""


class Truncated(RuntimeError):
    """A window has as many rows as the cap: the mark must not move over it."""


@dataclass
class Window(InputPartition):
    path: str
    groups: list[int]
    low: int | None
    high: int


def _numbers(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Cursor values as whole numbers, times in microseconds."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz))
    return column.cast(pa.int64())


def _inside(column, low: int | None, high: int):
    values = _numbers(column)
    return pc.and_(pc.less_equal(values, high), pc.greater_equal(values, low)) if low is not None else pc.less_equal(values, high)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> StructType:
        fs, base = _open(self.options["path"])
        first = next(f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet"))
        return from_arrow_schema(pq.read_schema(first, filesystem=fs))

    def streamReader(self, schema: StructType) -> CursorReader:  # noqa: N802
        return CursorReader(self.options, schema)


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.cursor, self.cap = options["path"], options["cursor"], int(options.get("cap", 10_000))
        self.bootstrap = options.get("bootstrap", "false").lower() == "true"
        self.names = schema.names
        #: Of each file: (rows, least, greatest) of its row groups; what has no values is left out.
        self.known: dict[str, list[tuple[int, int, int, int]]] = {}

    def _look(self) -> None:
        fs, base = _open(self.path)
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.path in self.known or not name.endswith(".parquet") or name.startswith(("_", ".")):
                continue
            file = pq.ParquetFile(info.path, filesystem=fs)
            at = file.schema_arrow.get_field_index(self.cursor)
            found = []
            for g in range(file.metadata.num_row_groups):
                group = file.metadata.row_group(g)
                stats = group.column(at).statistics if len(file.schema_arrow) == group.num_columns else None
                kind = file.schema_arrow.field(at).type
                if stats is not None and stats.has_min_max:
                    low, high = _numbers(pa.array([stats.min, stats.max], kind)).to_pylist()
                else:
                    ends = pc.min_max(_numbers(file.read_row_group(g, [self.cursor]).column(0)))
                    low, high = ends["min"].as_py(), ends["max"].as_py()
                if low is not None:
                    found.append((g, group.num_rows, low, high))
            self.known[info.path] = found

    def initialOffset(self) -> dict:  # noqa: N802
        if not self.bootstrap:
            raise BootstrapRequired(f"{self.path}: there is no mark yet; give the option bootstrap to begin with all that is there")
        return {"at": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        self._look()
        top = max((high for found in self.known.values() for _, _, _, high in found), default=None)
        return {"at": "" if top is None else str(top)}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        if not end["at"]:
            return []
        self._look()
        low, high = int(start["at"]) if start["at"] else None, int(end["at"])
        out, most = [], 0
        for path, found in sorted(self.known.items()):
            groups = [(g, n) for g, n, least, greatest in found if least <= high and (low is None or greatest >= low)]
            if groups:
                out.append(Window(path, [g for g, _ in groups], low, high))
                most += sum(n for _, n in groups)
        if most >= self.cap and self._counted(out) >= self.cap:
            raise Truncated(f"{self.path}: a window of {self.cap} rows or more, the cap; the mark stays at {start['at'] or 'none'}")
        return out

    def _counted(self, windows: list[Window]) -> int:
        """The rows after the mark, counted up to the cap."""
        fs, n = _open(self.path)[0], 0
        for w in windows:
            for g in w.groups:
                values = pq.ParquetFile(w.path, filesystem=fs).read_row_group(g, [self.cursor]).column(0)
                n += pc.sum(_inside(values, None if w.low is None else w.low + 1, w.high)).as_py() or 0
                if n >= self.cap:
                    return n
        return n

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        fs = _open(self.path)[0]
        file = pq.ParquetFile(partition.path, filesystem=fs)
        for batch in file.iter_batches(row_groups=partition.groups, columns=self.names):
            yield batch.filter(_inside(batch.column(batch.schema.get_field_index(self.cursor)), partition.low, partition.high)).select(self.names)

    def commit(self, end: dict) -> None:
        pass


def cursor_stream(spark, path: str, cursor: str, schema: str, cap: int, bootstrap: bool = False):
    """The rows of path as a stream that goes by a high-water mark."""
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("cursor").schema(schema).option("path", path).option("cursor", cursor).option("cap", cap).option("bootstrap", str(bootstrap).lower()).load()
