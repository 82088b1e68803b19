"""Filters, record classes and data quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spotflow.functions.columns import as_ts, hours_ago, parse_iso
from spotflow.schema import EVENT_SCHEMA, EVENT_TYPES, UNIDENTIFIED

# -- filters -------------------------------------------------------------------


def by_event_type(df: DataFrame, *types: str, exclude: bool = False) -> DataFrame:
    """Rows of these types (or of the others; a row without a type is in neither)."""
    kept = F.col("type").isin(*types)
    return df.where(~kept if exclude else kept)


def identified_only(df: DataFrame) -> DataFrame:
    """Rows whose plate names a vehicle."""
    return df.where(
        F.col("license").isNotNull() & ~F.upper(F.trim("license")).isin(*UNIDENTIFIED)
    )


def drop_bad_timestamps(df: DataFrame, text: str, name: str = "ts") -> DataFrame:
    """Parse a text time; rows where it is missing or no time are dropped."""
    return df.withColumn(name, parse_iso(text)).where(F.col(name).isNotNull())


def in_time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """start <= ts < end; either may be absent."""
    if start is not None:
        df = df.where(F.col(ts) >= as_ts(start))
    return df if end is None else df.where(F.col(ts) < as_ts(end))


def drop_reset(df: DataFrame) -> DataFrame:
    return df.where(F.col("type").isNotNull() & (F.col("type") != "reset"))


def since_hours_ago(df: DataFrame, hours: float, now, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) > hours_ago(now, hours))


def in_map_bounds(df: DataFrame, south, west, north, east) -> DataFrame:
    """Rows inside the view rectangle; one that spans the date line has west > east."""
    lon = (
        F.col("lon").between(west, east)
        if west <= east
        else (F.col("lon") >= west) | (F.col("lon") <= east)
    )
    return df.where(F.col("lat").between(south, north) & lon)


# -- record classes -------------------------------------------------------------


def _of(types: tuple[str, ...]) -> Column:
    return F.coalesce(F.col("type").isin(*types), F.lit(False))


def is_spot() -> Column:
    return F.col("spot").isNotNull() & _of(("parked", "pulled", "empty"))


def is_parked() -> Column:
    return F.col("spot").isNotNull() & _of(("parked",))


def is_empty() -> Column:
    return F.col("spot").isNotNull() & _of(("empty",))


def is_pulled() -> Column:
    return F.col("spot").isNotNull() & _of(("pulled",))


def is_aisle(in_aisle: Column | None = None) -> Column:
    """A vehicle on the way: the place has an aisle, entrance or exit (``in_aisle``)."""
    where = F.col("level").isNotNull() if in_aisle is None else in_aisle
    return where & _of(("entry", "exit", "moving", "stopped"))


def with_record_flags(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        is_spot().alias("is_spot"),
        is_parked().alias("is_parked"),
        is_empty().alias("is_empty"),
        is_pulled().alias("is_pulled"),
        is_aisle().alias("is_aisle"),
    )


def classify_records(df: DataFrame) -> DataFrame:
    """``record_class``: parked, emptySpots, moving or others; null for a pulled spot."""
    return df.withColumn(
        "record_class",
        F.when(is_parked(), "parked")
        .when(is_empty(), "emptySpots")
        .when(is_pulled(), F.lit(None))
        .when(is_aisle(), "moving")
        .otherwise("others"),
    )


# -- validation -------------------------------------------------------------------

# Members an event must have, and members no rule covers.
REQUIRED = ("event", "place", "@timestamp", "object", "object.vehicle")
UNCHECKED = ("used", "event.source", "event.email")
# How JSON types read as the type of a variant.
VARIANT_TYPES = {
    "string": ("STRING",), "null": ("VOID",), "object": ("OBJECT",), "array": ("ARRAY",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
}


def _members(schema: T.StructType, path: str = ""):
    for f in schema.fields:
        here = f"{path}{f.name}"
        if here in UNCHECKED:
            continue
        yield here, f.dataType
        if isinstance(f.dataType, T.StructType):
            yield from _members(f.dataType, f"{here}.")


def _loose(kind: T.DataType) -> T.DataType:
    """The schema with leaves of any type."""
    if not isinstance(kind, T.StructType):
        return T.VariantType()
    return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])


def _allowed(name: str, kind: T.DataType) -> tuple[str, ...]:
    if isinstance(kind, T.StructType):
        return ("object",)
    if isinstance(kind, T.ArrayType):
        return ("array",)
    if isinstance(kind, T.DoubleType):
        return ("number", "null")
    return ("string",) if name == "@timestamp" else ("string", "null")


def _types(values: list[Column]) -> Column:
    """Types of variants as one text; empty where a member is absent."""
    return F.concat_ws(";", *[F.coalesce(F.schema_of_variant(v), F.lit("")) for v in values])


def _ill_typed(types: Column, names: list[str], allowed: list[tuple]) -> Column:
    """Messages of the members whose type is not an allowed one."""
    rules = F.array(
        *[
            F.struct(
                F.array(*[F.lit(t) for v in a for t in VARIANT_TYPES[v]]).alias("ok"),
                F.lit(f"{n}: not of type {'/'.join(a)}").alias("text"),
            )
            for n, a in zip(names, allowed)
        ]
    )

    def fault(t, r):
        plain = F.substring_index(F.substring_index(t, "<", 1), "(", 1)
        return F.when((plain != "") & ~F.array_contains(r.ok, plain), r.text)

    return F.zip_with(F.split(types, ";"), rules, fault)


def _type_pattern(allowed: list[tuple]) -> str:
    """Pattern of the types of well-typed members."""
    texts = {"number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\([^;]*\)", "string": "STRING", "null": "VOID",
             "array": r"ARRAY<(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL\([^;]*\))?>"}
    return "^" + ";".join("(" + "|".join([texts[t] for t in a] + [""]) + ")" for a in allowed) + "$"


def validate_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``flag`` (valid?) and ``message`` (one line per broken rule).

    The text is parsed once into leaves of any type, and one pattern over the
    leaf types clears nearly every row. Only rows that look odd (a struct of
    another type, a null, a required member absent) are taken apart a second time.
    """
    loose = _loose(EVENT_SCHEMA).add("_odd", "string")
    members = list(_members(EVENT_SCHEMA))
    leaves = [n for n, k in members if not isinstance(k, T.StructType)]
    allowed = [_allowed(n, k) for n, k in members if not isinstance(k, T.StructType)]
    structs = [n for n, k in members if isinstance(k, T.StructType)]

    def at(name):
        return F.col("_j." + ".".join(f"`{p}`" for p in name.split(".")))

    def inside(name):
        path = "$" + "".join(f"['{p}']" for p in name.split("."))
        return F.try_variant_get("_doc", path, "variant")

    options = {"columnNameOfCorruptRecord": "_odd"}
    parsed = df.withColumn("_j", F.from_json(F.col(value), loose, options))
    odd = at("_odd").isNotNull() | F.col("_j").isNull() | F.contains(F.col(value), F.lit("null"))
    for n in REQUIRED:
        odd = odd | at(n).isNull()
    parsed = parsed.withColumn("_is_odd", odd).withColumn(
        "_doc", F.when(F.col("_is_odd"), F.try_parse_json(F.col(value)))
    )
    seen = parsed.select(
        *df.columns,
        _types([at(n) for n in leaves]).alias("_leaf"),
        F.when(
            F.col("_is_odd"), _types([F.col("_doc"), *[inside(n) for n in structs], inside("@timestamp")])
        ).alias("_second"),
        F.try_variant_get(at("event.type"), "$", "string").alias("_type"),
        F.coalesce(F.schema_of_variant(at("event.type")), F.lit("")).alias("_type_is"),
        F.coalesce(F.schema_of_variant(at("object.signature")), F.lit("")).alias("_items"),
    )
    second = F.split("_second", ";")
    root = second[0]
    of = {n: second[i] for i, n in enumerate(["$", *structs, "@timestamp"])}
    missing = [F.when(of[n] == "", f"{n}: missing") for n in REQUIRED if n != "object.vehicle"]
    missing.append(
        F.when(of["object"].startswith("OBJECT") & (of["object.vehicle"] == ""), "object.vehicle: missing")
    )
    body = F.slice(second, 2, len(structs))
    structured = F.when(F.col("_second").isNull(), F.array().cast("array<string>")).when(
        ~root.startswith("OBJECT"), F.array(F.lit("not a JSON object"))
    ).otherwise(
        F.concat(F.array(*missing), _ill_typed(F.array_join(body, ";"), structs, [("object",)] * len(structs)))
    )
    known = F.coalesce(F.col("_type").isin(*EVENT_TYPES), F.lit(False))
    values = F.array(
        F.when((F.col("_type_is") != "") & ~known, "event.type: not one of the known values"),
        F.when((F.col("_type_is") == "STRING") & (F.length("_type") < 1), "event.type: shorter than 1"),
        F.when(
            F.col("_items").startswith("ARRAY") & ~F.col("_items").rlike(_type_pattern([("array",)])),
            "object.signature: items not number/null",
        ),
    )
    found = F.array_compact(F.concat(structured, _ill_typed(F.col("_leaf"), leaves, allowed), values))
    fine = (
        F.col("_second").isNull() & F.col("_leaf").rlike(_type_pattern(allowed))
        & (known | (F.col("_type_is") == ""))
    )
    text = F.when(fine, F.lit("")).otherwise(F.array_join(found, "\n"))
    # As a generated column the text is computed once: filters on it are not
    # pushed below, where they would repeat the whole expression.
    return seen.select(*df.columns, F.explode(F.array(text)).alias("message")).select(
        *df.columns, (F.col("message") == "").alias("flag"), "message"
    )


def invalid_events(df: DataFrame, value: str = "value") -> DataFrame:
    return validate_events(df, value).where(~F.col("flag"))
