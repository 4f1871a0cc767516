"""Framed record payloads: a zero byte, the schema id in four big-endian bytes, then the record.

The record is Avro where the Avro functions are on the classpath, else JSON behind the same frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

HEADER_BYTES = 5


def header(schema_id: int) -> bytes:
    return b"\x00" + schema_id.to_bytes(4, "big")


def has_avro(spark: SparkSession) -> bool:
    """Whether the Avro functions can be used in this session."""
    try:
        spark.sql("""SELECT to_avro(1, '"int"')""").schema  # noqa: B018
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroDataToCatalyst")
        return True
    except Exception:  # noqa: BLE001  the class or the function is absent
        return False


def framed(body: Column, schema_id: int) -> Column:
    return F.concat(F.lit(header(schema_id)), body.cast("binary"))


def encode(df: DataFrame, schema_id: int, avro: str | None = None) -> DataFrame:
    """All columns as one framed ``value``. ``avro`` is the Avro schema text where Avro can be used."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if avro is not None:
        from pyspark.sql.avro.functions import to_avro

        return df.select(framed(to_avro(record, avro), schema_id).alias("value"))
    return df.select(framed(F.to_json(record, {"ignoreNullFields": "false"}), schema_id).alias("value"))


def _is_whole(v: Column) -> Column:
    return (F.length(v) > HEADER_BYTES) & (F.hex(F.substring(v, 1, 1)) == "00")


def _body(v: Column) -> Column:
    return F.substring(v, HEADER_BYTES + 1, 2_147_483_647)


def decode(df: DataFrame, schema, avro: str | None = None, value: str = "value", schema_id: int | None = None) -> DataFrame:
    """``df`` with ``data``, the record of a framed value; a short value or a wrong first byte gives a null record.

    With ``schema_id`` so does any other id; topics with several ids are read by :func:`decode_by_id`.
    """
    v = F.col(value)
    whole, body = _is_whole(v), _body(v)
    if schema_id is not None:
        whole = whole & (schema_id_of(v) == schema_id)
    if avro is not None:
        from pyspark.sql.avro.functions import from_avro

        return df.withColumn("data", F.when(whole, from_avro(body, avro)))
    return df.withColumn("data", F.when(whole, F.from_json(body.cast("string"), schema)))


def schema_id_of(value: Column) -> Column:
    """Schema id of a framed value."""
    return F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")


@dataclass(frozen=True)
class Writer:
    """A schema that records of a topic were written with: Spark's for JSON bodies, with ``avro`` the Avro schema text."""

    schema: str | StructType
    avro: str | None = None

    def layout(self) -> StructType:
        return self.schema if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema)


#: Numbers from narrow to wide: a field that writers disagree on takes the widest, and text if one of them has no number.
_WIDENING = ("tinyint", "smallint", "int", "bigint", "float", "double")
_BROKEN = "_broken"
#: Why a value has no record.
BAD_FRAME, UNKNOWN_SCHEMA, BAD_BODY = "bad frame", "unknown schema", "bad body"


def unified(writers: dict[int, Writer]) -> StructType:
    """All writers' fields by name, in order of schema id and place; every field may be null."""
    kinds: dict[str, list] = {}
    for _, writer in sorted(writers.items()):
        for f in writer.layout():
            kinds.setdefault(f.name, []).append(f.dataType)
    out = StructType()
    for name, types in kinds.items():
        names = {t.simpleString() for t in types}
        widest = types[0] if len(names) == 1 else max(types, key=lambda t: _WIDENING.index(t.simpleString())) if names <= set(_WIDENING) else StringType()
        out = out.add(name, widest, True)
    return out


def decode_by_id(df: DataFrame, writers: dict[int, Writer], value: str = "value") -> DataFrame:
    """``df`` with ``schema_id``, ``data`` and ``problem``: each value is read with the schema that its frame names.

    ``data`` has the fields of all writers (see :func:`unified`), null where a record's writer had none. It is null where
    ``problem`` says why: the frame is too short or begins otherwise, nobody gave its schema, or its body does not fit it
    (Avro bodies that do not fit fail the query, as Spark's function does, unless its mode is set otherwise).
    """
    v, together = F.col(value), unified(writers)
    whole, number = _is_whole(v), schema_id_of(v)
    data, broken = F.lit(None).cast(together), F.lit(False)
    for k, writer in sorted(writers.items()):
        mine, layout = whole & (number == k), writer.layout()
        if writer.avro is not None:
            from pyspark.sql.avro.functions import from_avro

            record, fits = from_avro(F.when(mine, _body(v)), writer.avro), F.lit(True)
        else:
            record = F.from_json(F.when(mine, _body(v)).cast("string"), StructType([*layout.fields, StructField(_BROKEN, StringType())]), {"columnNameOfCorruptRecord": _BROKEN})
            fits = record[_BROKEN].isNull()
        fields = [(record[f.name] if f.name in layout.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in together]
        data, broken = F.when(mine & fits, F.struct(*fields)).otherwise(data), broken | (mine & ~fits)
    problem = F.when(v.isNull() | ~whole, BAD_FRAME).when(broken, BAD_BODY).when(~number.isin(*writers), UNKNOWN_SCHEMA)
    return df.withColumns({"schema_id": F.when(whole, number), "data": data, "problem": problem})


def records_and_rejects(decoded: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """What :func:`decode_by_id` could read, as columns, and a side table of the rest with the raw values: no value is lost."""
    return decoded.where("problem is null").select("schema_id", "data.*"), decoded.where("problem is not null").select("schema_id", "problem", value)
