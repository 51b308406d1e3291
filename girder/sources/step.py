"""STEP files as records: one row per instance, with its arguments split at the top level and their lists into members.

Files are read by Spark and parsed by one streaming pass per file; model_id is the SHA-256 of the file's bytes. Bytes that are
no UTF-8 are taken as Latin-1, which older files are written in, so no file fails a load.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.sources.geometry_classes import GEOMETRY_CLASSES, PLACEMENT_CLASSES

RECORD_SCHEMA = "model_id string, schema string, entity_id int, ifc_type string, args string, ord long, arg_list array<string>, members array<array<string>>"
_TEXTS = pa.list_(pa.string())
_RECORDS = pa.schema(
    [("model_id", pa.string()), ("schema", pa.string()), ("entity_id", pa.int32()), ("ifc_type", pa.string()), ("args", pa.string()), ("ord", pa.int64()), ("arg_list", _TEXTS), ("members", pa.list_(_TEXTS))]
)
_COMMENT = re.compile(r"'(?:[^']|'')*+'|/\*.*?\*/", re.DOTALL)
_INSTANCE = re.compile(r"#(\d+)\s*=\s*([A-Za-z][A-Za-z0-9_]*)\s*\(((?:[^';]|'(?:[^']|'')*+')*+);")
_BREAK = re.compile(r"[ \t]*\r?\n\s*")
_PIECE = re.compile(r"'(?:[^']|'')*+'|[(),]|[^'(),]+")
_SCHEMA = re.compile(r"FILE_SCHEMA\s*\(\s*\(\s*'([^']+)'", re.IGNORECASE)
_SHAPES = frozenset((*GEOMETRY_CLASSES, *PLACEMENT_CLASSES))
_BATCH = 20_000


def split_arguments(args: str) -> list[str]:
    """Arguments at the top level, trimmed; quoted text and nested lists stay whole; a blank last one is dropped."""
    out, depth, now = [], 0, []
    for piece in _PIECE.findall(args):
        if piece == "," and depth == 0:
            out.append("".join(now).strip())
            now = []
            continue
        depth += (piece == "(") - (piece == ")")
        now.append(piece)
    last = "".join(now).strip()
    return [*out, last] if last else out


def list_members(arg: str) -> list[str] | None:
    """Members of a list argument; None of anything else."""
    return split_arguments(arg[1:-1]) if arg.startswith("(") and arg.endswith(")") else None


def parse_step(text: str) -> Iterator[tuple[int, str, str]]:
    """(id, class in capitals, arguments) of every instance; line breaks in arguments become one space, comments go."""
    if "/*" in text:
        text = _COMMENT.sub(lambda found: found[0] if found[0][0] == "'" else " ", text)
    data = text.find("DATA;")
    for found in _INSTANCE.finditer(text, data + 5 if data >= 0 else 0):
        args = _BREAK.sub(" ", found[3]).strip()
        if args.endswith(")"):
            yield int(found[1]), found[2].upper(), args[:-1].strip()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for model, text in zip(batch.column("model_id"), batch.column("text"), strict=True):
            model, text = model.as_py(), text.as_py() or ""
            named = _SCHEMA.search(text)
            schema = named[1].upper() if named else "UNKNOWN"
            rows: list[tuple] = []

            def made(model=model, schema=schema) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [()] * 6
                whole = [[model] * len(rows), [schema] * len(rows), *columns]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(whole, _RECORDS, strict=True)], schema=_RECORDS)

            for order, (number, kind, args) in enumerate(parse_step(text)):
                split = split_arguments(args)
                members = [None] * len(split) if kind in _SHAPES else [list_members(x) for x in split]
                rows.append((number, kind, args, order, split, members))
                if len(rows) == _BATCH:
                    yield made()
                    rows.clear()
            yield made()


def schema_name(text: Column) -> Column:
    """The schema that a file names in its header, in capitals; UNKNOWN without one."""
    said = F.upper(F.regexp_extract(text, r"(?i)FILE_SCHEMA\s*\(\s*\(\s*'([^']+)'", 1))
    return F.when(said != "", said).otherwise("UNKNOWN")


def content_id(content: Column) -> Column:
    """The id of a model: SHA-256 of its file's bytes, in lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, path, text, schema) of the STEP files below ``path``; a file of no bytes is none."""
    files = spark.read.format("binaryFile").load(path)
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(content_id(F.col("content")).alias("model_id"), "path", text.alias("text")).withColumn("schema", schema_name(F.col("text")))


def records(texts: DataFrame) -> DataFrame:
    """Records of (model_id, text) rows; of geometry and placement classes no list is split into members."""
    return texts.select("model_id", "text").mapInArrow(_parse, RECORD_SCHEMA)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_args(args):
    """Column form of :func:`split_arguments`, for text that is no record's; records come split."""
    return args.map(lambda a: None if a is None else split_arguments(a))


# Argument readers: columns from columns.


def unquoted(args: Column) -> Column:
    """The text without its quoted strings, so that what they say is not taken for syntax."""
    return F.regexp_replace(args, "'(?:[^']|'')*'", "''")


def open_depth(args: Column) -> Column:
    bare = unquoted(args)
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    return count("(") - count(")")


def ref_id(arg: Column) -> Column:
    return F.regexp_extract(F.trim(arg), r"^#([0-9]+)$", 1).try_cast("int")


def list_refs(arg: Column) -> Column:
    return F.transform(F.regexp_extract_all(unquoted(arg), F.lit(r"#([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def cast_name(arg: Column) -> Column:
    """The type name that a value is wrapped in, or null."""
    name = F.regexp_extract(arg, r"^\s*([A-Z][A-Z0-9_]*)\(", 1)
    return F.when(name != "", name)


def strip_cast(arg: Column) -> Column:
    inner = F.regexp_extract(F.trim(arg), r"(?s)^[A-Z0-9_]+\((.+)\)$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(arg))


def decode_text(arg: Column) -> Column:
    return F.replace(F.substring(arg, 2, F.length(arg) - 2), F.lit("''"), F.lit("'"))


def decode_arg(arg: Column) -> Column:
    """The value of an argument as text: null for nothing, strings without quotes, enumeration names, TRUE and FALSE."""
    bare = strip_cast(arg)
    inner = decode_text(bare)
    value = (
        F.when(bare.isin("", "$", "*", ".U."), None)
        .when(bare == ".T.", "TRUE")
        .when(bare == ".F.", "FALSE")
        .when(bare.rlike(r"(?s)\A'.*'\z"), inner)
        .when(bare.rlike(r"\A\.[A-Za-z0-9_]+\.\z"), F.substring(bare, 2, F.length(bare) - 2))
        .otherwise(bare)
    )
    return F.nullif(F.trim(value), F.lit(""))


def is_empty_text(arg: Column) -> Column:
    return F.trim(arg) == "''"


def encode_text(value: Column) -> Column:
    """A STEP string of the value, ``$`` of null."""
    return F.when(value.isNull(), "$").otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def encode_ref(value: Column) -> Column:
    return F.when(value.isNull(), "$").otherwise(F.concat(F.lit("#"), value.cast("string")))


def encode_enum(value: Column) -> Column:
    return F.when(value.isNull(), "$").otherwise(F.concat(F.lit("."), value, F.lit(".")))


def encode_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("0"))


def encode_list(members: Column) -> Column:
    """A list of encoded members (array of string); a null array is ``$``, null members are ``$``."""
    inner = F.array_join(F.transform(members, lambda m: F.coalesce(m, F.lit("$"))), ",")
    return F.when(members.isNull(), "$").otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def encode_args(*arguments: Column) -> Column:
    """The arguments of a record as its line has them."""
    return F.concat_ws(",", *[F.coalesce(a, F.lit("$")) for a in arguments])
