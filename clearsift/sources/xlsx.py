"""Workbooks as a Spark data source: `xlsx` reads sheets row by row from their zip members and writes one workbook or more for each task."""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Namespaces and numbers of the workbook format (ECMA-376).
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
MOST_ROWS = 1_048_576
EPOCHS = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}

_IN_QUOTES = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
_NOT_XML = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


_CELL, _ROW, _SHEET_DATA, _V = _tag("c"), _tag("row"), _tag("sheetData"), _tag("v")
_WHOLE = re.compile(r"-?\d{1,18}")


def filesystem(path: str):
    """The file system of a path or URI and the path in it: local, HDFS and object stores, as pyarrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """The workbooks of a path: itself, or the .xlsx files of a folder; what begins with _ or . is not finished."""
    from pyarrow import fs

    system, inner = filesystem(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.is_file]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found) if n.lower().endswith(".xlsx") and n[0] not in "_."]


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


@dataclass
class Workbook:
    """An open workbook; only what is asked for is read, and sheets are streamed."""

    package: zipfile.ZipFile

    def _root(self, member: str) -> ElementTree.Element | None:
        return ElementTree.parse(self.package.open(member)).getroot() if member in self.package.namelist() else None

    def sheets(self) -> list[tuple[str, str]]:
        """(name, member) of the sheets in their order."""
        links = self._root("xl/_rels/workbook.xml.rels")
        target = {r.get("Id"): r.get("Target") for r in links}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        return [(s.get("name"), place(target[s.get(f"{{{RELATIONS}}}id")])) for s in self._root("xl/workbook.xml").iter(_tag("sheet"))]

    def epoch(self) -> dt.datetime:
        settings = self._root("xl/workbook.xml").find(_tag("workbookPr"))
        return EPOCHS[settings is not None and settings.get("date1904") in ("1", "true")]

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show a number as a date or a time."""
        styles = self._root("xl/styles.xml")
        if styles is None:
            return set()
        own = {int(f.get("numFmtId")) for f in styles.iter(_tag("numFmt")) if re.search("[ymdhs]", _IN_QUOTES.sub("", f.get("formatCode") or ""), re.IGNORECASE)}
        formats = styles.find(_tag("cellXfs"))
        return {i for i, x in enumerate([] if formats is None else formats) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}

    def shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.package.namelist():
            return []
        out = []
        for _, e in ElementTree.iterparse(self.package.open("xl/sharedStrings.xml")):
            if e.tag == _tag("si"):
                out.append(_text(e))
                e.clear()
        return out

    def rows(self, member: str) -> Iterator[list[object]]:
        """The cells of each row that has any, as Python values, None in gaps; memory is that of one row."""
        shared, dates, epoch = self.shared_strings(), self.date_styles(), self.epoch()
        parent = None
        for event, e in ElementTree.iterparse(self.package.open(member), ("start", "end")):
            if event == "start":
                parent = e if e.tag == _SHEET_DATA else parent
            elif e.tag == _ROW:
                row: list[object] = []
                for cell in e.iter(_CELL):
                    reference = cell.get("r")
                    at = column_number(reference) if reference else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _value(cell, shared, dates, epoch)
                if any(v is not None for v in row):
                    yield row
                parent.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of a rich or plain string, without the readings of its characters."""
    runs = [t.text or "" for part in e if part.tag in (_tag("t"), _tag("r")) for t in ([part] if part.tag == _tag("t") else part.findall(_tag("t")))]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(runs))


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], epoch: dt.datetime) -> object:
    kind, value = cell.get("t", "n"), cell.findtext(_V)
    if kind == "inlineStr":
        inline = cell.find(_tag("is"))
        return None if inline is None else _text(inline)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "str":
        return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)
    if kind == "b":
        return value == "1"
    if kind == "d":
        return dt.datetime.fromisoformat(value)
    number = float(value)
    style = cell.get("s")
    if (int(style) if style else 0) in dates:
        return epoch + dt.timedelta(milliseconds=round(number * 86_400_000))
    return int(value) if _WHOLE.fullmatch(value) else number


#: Types of cells that are values of a column's type as they are.
_AS_READ = {T.StringType: str, T.BooleanType: bool, T.DoubleType: float, T.FloatType: float, T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int, T.TimestampType: dt.datetime, T.TimestampNTZType: dt.datetime}


def convert(value: object, kind: T.DataType) -> object:
    """A cell as a value of a column's type; null where it is none."""
    try:
        if value is None or type(value) is _AS_READ.get(type(kind)):
            return value
        if isinstance(kind, T.StringType):
            if isinstance(value, dt.datetime):
                return value.date().isoformat() if value.time() == dt.time() else value.isoformat(" ")
            if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
                return str(int(value))
            return str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).strip().lower())
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            moment = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip())
            return moment.date() if isinstance(kind, T.DateType) else moment
        if isinstance(kind, T.IntegralType):
            whole = value if isinstance(value, int) else float(str(value).strip())
            return int(whole) if whole == int(whole) else None
        if isinstance(kind, T.FractionalType):
            return float(value if isinstance(value, int | float) else str(value).strip())
    except (ValueError, OverflowError):
        return None
    raise ValueError(f"no column of a workbook can be read as {kind.simpleString()}")


@dataclass
class SheetPartition(InputPartition):
    path: str
    member: str


class XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet", "first")

    def partitions(self) -> list[SheetPartition]:
        """One for each sheet that is asked for: the first of each workbook, all, or those of a name."""
        out = []
        for path in workbook_files(self.path):
            system, inner = filesystem(path)
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as package:
                sheets = Workbook(package).sheets()
            wanted = sheets[:1] if self.sheet == "first" else [s for s in sheets if self.sheet in ("all", s[0])]
            out.extend(SheetPartition(path, member) for _, member in wanted)
        return out or [SheetPartition("", "")]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, inner = filesystem(partition.path)
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as package:
            rows = Workbook(package).rows(partition.member)
            at = {str(h): i for i, h in enumerate(next(rows, [])) if h is not None}
            columns = [(at.get(f.name), f.dataType) for f in self.schema]
            for row in rows:
                yield tuple(convert(row[i], kind) if i is not None and i < len(row) else None for i, kind in columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class XlsxWriter(DataSourceWriter):
    """Each task writes under names that readers pass over; the commit gives all of them their names."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.most = min(int(options.get("rowsPerWorkbook", MOST_ROWS)), MOST_ROWS) - 1  # one row is the header

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        files, rows, more = [], iter(iterator), True
        while more:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            with system.open_output_stream(f"{inner}/_{name}") as f:
                more = write_workbook(f, self.schema, rows, self.most)
            files.append(name)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        new = [n for m in messages if m for n in m.files]
        old = workbook_files(self.path) if self.overwrite else []
        for n in new:
            system.move(f"{inner}/_{n}", f"{inner}/{n}")
        for path in old:
            system.delete_file(filesystem(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = filesystem(self.path)
        for n in (n for m in messages if m for n in m.files):
            system.delete_file(f"{inner}/_{n}")


def write_workbook(target: io.RawIOBase, schema: T.StructType, rows: Iterator[tuple], most: int) -> bool:
    """Writes up to `most` rows as a workbook of one sheet; whether rows may be left. Texts are shared: a sheet's row limit bounds them."""
    shared: dict[str, int] = {}
    names = [f.name for f in schema]

    def cell(value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f"<c><v>{value!r}</v></c>"
        if isinstance(value, dt.date):
            whole = not isinstance(value, dt.datetime)
            moment = dt.datetime.combine(value, dt.time()) if whole else value.replace(tzinfo=None)
            return f'<c s="{1 if whole else 2}"><v>{(moment - EPOCHS[False]) / dt.timedelta(days=1)!r}</v></c>'
        return f'<c t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'

    line = lambda values: ("<row>" + "".join(map(cell, values)) + "</row>").encode()
    escaped = lambda s: escape(_NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", _ESCAPED.sub(lambda m: f"_x005F{m[0]}", s)))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
        with package.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"{head}<worksheet xmlns={quoteattr(MAIN)}><sheetData>".encode() + line(names))
            while n < most and (row := next(rows, None)) is not None:
                f.write(line(row))
                n += 1
            f.write(b"</sheetData></worksheet>")
        with package.open("xl/sharedStrings.xml", "w") as f:
            f.write(f"{head}<sst xmlns={quoteattr(MAIN)}>".encode())
            for text in shared:
                f.write(f'<si><t xml:space="preserve">{escaped(text)}</t></si>'.encode())
            f.write(b"</sst>")
        parts = {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"), ("sharedStrings", "sharedStrings")))
            + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Type="{RELATIONS}/{k}" Target="{p}.xml"/>' for i, (k, p) in enumerate((("worksheet", "worksheets/sheet1"), ("styles", "styles"), ("sharedStrings", "sharedStrings")))) + "</Relationships>",
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="rows" sheetId="1" r:id="r0"/></sheets></workbook>',
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        for name, text in parts.items():
            package.writestr(name, head + text)
    return n == most


class XlsxDataSource(DataSource):
    """`path` is a workbook or a folder of them; `sheet` is first (the default), all, or a name. The first row names the columns.

    Without a schema, the columns are those of the first workbook, as texts. Rows without a value are passed over; of equal column
    names the last counts; a cell that is none of its column's type, or an error, is null.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        partition = XlsxReader(T.StructType(), self.options).partitions()[0]
        if not partition.path:
            raise ValueError(f"{self.options['path']} has no workbook to take columns from; give a schema")
        system, inner = filesystem(partition.path)
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as package:
            header = next(Workbook(package).rows(partition.member), [])
        return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(str(h) for h in header if h is not None)])

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, self.options, overwrite)


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: str = "first") -> DataFrame:
    """The rows of the sheets of a workbook, or of a folder of workbooks, one partition for each sheet."""
    spark.dataSource.register(XlsxDataSource)
    reader = spark.read.format("xlsx").option("sheet", sheet)
    return (reader.schema(schema) if schema else reader).load(path)


def write_xlsx(df: DataFrame, path: str, rows_per_workbook: int = MOST_ROWS) -> None:
    """Replaces a folder's workbooks by df's rows: one or more for each task, all named at the commit."""
    df.sparkSession.dataSource.register(XlsxDataSource)
    df.write.format("xlsx").option("rowsPerWorkbook", rows_per_workbook).mode("overwrite").save(path)
