"""The first sheet of each .xlsx workbook in a folder, one task per
file.

``spark.read.format('binaryFile')`` lists the files; ``mapInPandas`` opens
each workbook (a zip of XML parts) with the standard library and yields its
rows, typed by the given schema.  Nothing passes through the driver.  The
first row is the header; cells are matched to schema fields by header name.
Sheets are parsed and written as streams: a task holds the file as it is
stored, its shared strings and some thousand cells, however long the sheet.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from array import array
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship_package

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Fixed value: day zero of spreadsheet serial dates (1900 date system).
_EPOCH = datetime(1899, 12, 30)
_EPOCH_1904 = datetime(1904, 1, 1)
# Fixed value: rows a sheet can have.
_SHEET_ROWS = 1_048_576
#: Bytes of a sheet's XML after which a writer begins another workbook.
_SHEET_BYTES = 64 << 20
#: Cells that a reader holds as values at once.
_BATCH_CELLS = 20_000


def _col_index(ref: str) -> int:
    letters = "".join(ch for ch in ref if ch.isalpha())
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def date_base(content: bytes) -> datetime:
    """Day zero of the workbook's serial dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    return _EPOCH_1904 if props is not None and props.get("date1904") in ("1", "true") else _EPOCH


def _elements(part, *path: str):
    """The elements at ``path`` under the root of an XML part, in order.  The
    tree never holds more than a block of them: each is dropped when the next
    is asked for."""
    tags = [f"{{{_NS['m']}}}{t}" for t in path]
    above = []
    for event, node in ET.iterparse(part, events=("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if len(above) <= len(tags):
            if len(above) == len(tags) and node.tag == tags[-1] and all(x.tag == t for x, t in zip(above[1:], tags)):
                yield node
            if above:
                above[-1].remove(node)


class _Strings:
    """Texts by number, as one block of bytes: a table of shared strings
    takes little more than its own length."""

    def __init__(self, texts):
        self.block, self.ends = bytearray(), array("q", [0])
        for t in texts:
            self.block += t.encode()
            self.ends.append(len(self.block))

    def __getitem__(self, k: int) -> str:
        k = range(len(self.ends) - 1)[k]
        return self.block[self.ends[k] : self.ends[k + 1]].decode()


def first_sheet_rows(content: bytes):
    """The rows of the first worksheet, one after the other, as lists of
    Python values (None for an empty cell)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        sheet = wb.find("m:sheets/m:sheet", _NS)
        rid = sheet.get(f"{{{_NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("p:Relationship", _NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        shared = _Strings(())
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = _Strings(_text(si) for si in _elements(part, "si"))
        with z.open(target) as part:
            for row in _elements(part, "sheetData", "row"):
                yield _row_values(row, shared)


def _row_values(row, shared: _Strings) -> list:
    cells = {}
    at = -1
    for c in row.findall("m:c", _NS):
        kind = c.get("t", "n")
        # a cell without a reference follows the one before it
        at = _col_index(c.get("r")) if c.get("r") else at + 1
        v = c.find("m:v", _NS)
        if kind == "s":
            val = shared[int(v.text)] if v is not None else None
        elif kind == "inlineStr":
            val = _text(c)
        elif kind in ("str", "e", "d"):
            val = v.text if v is not None else None
        elif kind == "b":
            val = (v.text == "1") if v is not None else None
        else:
            val = float(v.text) if v is not None and v.text not in (None, "") else None
        cells[at] = val
    width = max(cells) + 1 if cells else 0
    return [cells.get(i) for i in range(width)]


def _convert(value, dtype: T.DataType, base: datetime = _EPOCH):
    if value is None:
        return None
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return base + timedelta(days=float(value)) if isinstance(value, float) else pd.Timestamp(value)
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return int(float(value))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(dtype, T.BooleanType):
        return bool(value) if not isinstance(value, str) else value.lower() == "true"
    if isinstance(dtype, T.StringType):
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
        return str(value)
    return value


def _header(batches):
    for pdf in batches:
        for content in pdf["content"]:
            yield pd.DataFrame({"name": [str(h) for h in next(first_sheet_rows(bytes(content)), []) if h is not None]})


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   glob: str = "*.xlsx") -> DataFrame:
    """Rows of the first sheet of every workbook under ``path``.  Without a
    schema the columns are those of one workbook's header and their types are
    inferred, as for CSV."""
    ship_package(spark)
    # files differ in size: a batch for Python is bounded by bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    if schema is None:
        from quarry.sources.files import NA_TOKENS, infer_types

        one = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").limit(1)
        head = one.mapInPandas(_header, "name string").collect()          # one row per column
        text = read_workbooks(spark, path, T.StructType([T.StructField(r["name"], T.StringType()) for r in head]), glob)
        return infer_types(text.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns]))
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    fields = schema.fields

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = first_sheet_rows(bytes(content))
                first = next(rows, None)
                if first is None:
                    continue
                base = date_base(bytes(content))
                header = [str(h) if h is not None else "" for h in first]
                pos = {h: i for i, h in enumerate(header)}
                missing = [f.name for f in fields if f.name not in pos]
                if missing:
                    raise ValueError(f"workbook lacks columns {missing}")
                while part := list(itertools.islice(rows, max(1, _BATCH_CELLS // max(1, len(fields), len(header))))):
                    yield pd.DataFrame({f.name: [_convert(r[pos[f.name]] if pos[f.name] < len(r) else None, f.dataType, base)
                                                 for r in part] for f in fields})

    return files.mapInPandas(parse, schema)


def workbook_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """A minimal one-sheet .xlsx (inline strings, numbers, booleans): used
    to write test inputs."""
    buf = io.BytesIO()
    _write_workbook(buf, columns, iter(rows))
    return buf.getvalue()


def _write_workbook(out, columns: list[str], rows, most_rows: int | None = None, most_bytes: int | None = None) -> int:
    """Write rows of the iterator to the open file ``out`` as they come, until
    the sheet has so many (its header not counted) or so many bytes of XML.
    Returns the number of rows written."""
    from xml.sax.saxutils import escape

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{repr(float(v)) if isinstance(v, float) else v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def letters(ci):
        s, n = "", ci + 1
        while n:
            n, rem = divmod(n - 1, 26)
            s = chr(65 + rem) + s
        return s

    names = [letters(ci) for ci in range(len(columns))]

    def line(ri, r):
        return (f'<row r="{ri}">' + "".join(cell(f"{s}{ri}", v) for s, v in zip(names, r, strict=True)) + "</row>").encode()

    parts = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" '
            'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" '
            'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '</Types>'),
        "_rels/.rels": (
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["p"]}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        "xl/workbook.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["p"]}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'),
    }
    done = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        # without a limit the size is not known: the entry may pass 2 GB
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=most_bytes is None) as sheet:
            size = sheet.write(('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                                f'<worksheet xmlns="{_NS["m"]}"><sheetData>').encode() + line(1, columns))
            while (most_rows is None or done < most_rows) and (most_bytes is None or size < most_bytes):
                r = next(rows, None)
                if r is None:
                    break
                done += 1
                size += sheet.write(line(done + 1, r))
            sheet.write(b"</sheetData></worksheet>")
    return done


def write_workbooks(df: DataFrame, path: str) -> int:
    """Write ``df`` as workbooks under ``path`` (any filesystem pyarrow can
    open: local, HDFS, S3), from the executors, row by row; the driver
    receives one count per partition.  A partition becomes one workbook, or
    several where its rows pass what a sheet holds.  Returns the number of
    rows.  Used to produce workbook inputs at scale."""
    import uuid

    ship_package(df.sparkSession)
    columns = df.columns
    tag = uuid.uuid4().hex[:8]
    # a path without a scheme belongs to the cluster's default filesystem
    sc = df.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def write(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        rows = (tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in r)
                for pdf in batches for r in pdf.itertuples(index=False, name=None))
        part = TaskContext.get().partitionId()
        done = 0
        for number, first in enumerate(rows):                # each pass takes a workbook's rows
            filesystem, base = pafs.FileSystem.from_uri(uri)
            filesystem.create_dir(base, recursive=True)
            name = f"part-{part:05d}-{tag}" + (f"-{number}" if number else "")
            with filesystem.open_output_stream(f"{base}/{name}.xlsx") as out:
                done += _write_workbook(out, columns, itertools.chain([first], rows), _SHEET_ROWS - 1, _SHEET_BYTES)
        yield pd.DataFrame({"rows": [done]})

    written = df.mapInPandas(write, "rows long").agg(F.sum("rows")).first()[0]
    return int(written or 0)
