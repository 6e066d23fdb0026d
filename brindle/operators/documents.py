"""Schema-flexible documents: types, validation rules, defaults and schema evolution, all as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
    "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampType(), "duration": T.LongType(), "any": T.VariantType(),
    "datetime": T.StructType([T.StructField("secs", T.LongType()), T.StructField("nanos", T.IntegerType())]),
    "geopoint": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "reference": T.StructType([T.StructField("collection", T.StringType()), T.StructField("id", T.BinaryType())]),
}
#: Largest value of the unsigned types, which are held in the next wider signed one.
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
#: What each type may be widened to, one step at a time.
WIDER = [("int8", "int16"), ("int16", "int32"), ("int32", "int64"), ("uint8", "uint16"), ("uint16", "uint32"), ("uint32", "uint64"), ("float32", "float64")]


# ---- rules


@dataclass(frozen=True)
class Rule:
    """A name and a condition; a document violates it where the condition is false. Null fields violate nothing."""

    name: str
    ok: Column

    @classmethod
    def pattern(cls, c: str, regex: str) -> Rule:
        return cls(f"{c}: pattern", F.col(c).rlike(regex))

    @classmethod
    def between(cls, c: str, low=None, high=None) -> Rule:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(c) >= low)
        if high is not None:
            ok = ok & (F.col(c) <= high)
        return cls(f"{c}: range", ok)

    @classmethod
    def at_least(cls, c: str, low) -> Rule:
        return cls.between(c, low=low)

    @classmethod
    def bytes_at_most(cls, c: str, most: int, least: int = 0) -> Rule:
        return cls(f"{c}: length", F.octet_length(c).between(least, most))

    @classmethod
    def items(cls, c: str, least: int = 0, most: int = 2**31 - 1) -> Rule:
        return cls(f"{c}: items", F.size(c).between(least, most))

    @classmethod
    def compare(cls, a: str, op: str, b: str) -> Rule:
        x, y = F.col(a), F.col(b)
        ok = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return cls(f"{a} {op} {b}", ok)


def violations(rules: list[Rule]) -> Column:
    """The names of the rules that a row violates."""
    all_of = F.array(*[F.when(~F.coalesce(r.ok, F.lit(True)), F.lit(r.name)) for r in rules])
    return F.filter(all_of, lambda x: x.isNotNull())


def not_unique(df: DataFrame, c: str) -> DataFrame:
    """Values of a field that must be unique and aren't, with their count; nulls don't collide."""
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- schemas


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    default: object = None
    max_length: int | None = None
    optional: bool = False
    deprecated: bool = False
    values: tuple[str, ...] = ()


class EvolutionError(ValueError):
    pass


@dataclass(frozen=True)
class Schema:
    """mode: typed (these fields only), dynamic (any, up to max_extra) or mixed (these and up to max_extra others)."""

    fields: tuple[Field, ...]
    mode: str = "typed"
    max_extra: int = 0
    version: int = 1
    indexes: tuple[str, ...] = field(default=())

    def get(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise EvolutionError(f"no field {name}")

    def struct(self) -> T.StructType:
        """Null is allowed where a value may be missing; a mixed or dynamic schema keeps the rest as one variant."""
        own = [T.StructField(f.name, TYPES[f.type], not f.required or f.optional) for f in self.fields]
        return T.StructType(own + ([] if self.mode == "typed" else [T.StructField("extra", T.VariantType())]))

    def violations(self, data: str) -> Column:
        """Of a JSON text column: not an object, required fields that are missing, unknown or too many fields, wrong types."""
        obj = F.from_json(F.col(data), "map<string,string>")
        v = F.try_parse_json(F.col(data))
        names = [f.name for f in self.fields]
        out = [F.when(obj.isNull(), F.lit("not an object"))]
        for f in self.fields:
            here = F.array_contains(F.map_keys(obj), f.name)
            if f.required and f.default is None:
                out.append(F.when(obj.isNotNull() & ~here, F.lit(f"{f.name}: missing")))
            if f.type in TYPES and f.type not in ("any", "binary", "datetime", "geopoint", "reference"):
                kind = TYPES[f.type].simpleString()
                cast = F.try_variant_get(v, f"$['{f.name}']", kind)
                fits = cast.isNotNull()
                if f.type in UNSIGNED:
                    fits = fits & (cast >= 0) & (cast <= F.lit(UNSIGNED[f.type]).cast("decimal(20,0)"))
                text = F.schema_of_variant(F.try_variant_get(v, f"$['{f.name}']", "variant"))
                if f.type == "string":
                    fits = fits & (text == "STRING")
                elif f.type.startswith(("int", "uint", "float")):
                    fits = fits & (text != "STRING") & (text != "BOOLEAN")
                missing = obj[f.name].isNull()
                out.append(F.when(here & ~missing & ~F.coalesce(fits, F.lit(False)), F.lit(f"{f.name}: not {f.type}")))
            if f.max_length is not None:
                out.append(F.when(F.octet_length(obj[f.name]) > f.max_length, F.lit(f"{f.name}: too long")))
            if f.values:
                out.append(F.when(~obj[f.name].isin(*f.values), F.lit(f"{f.name}: not one of its values")))
        unknown = F.size(F.array_except(F.map_keys(obj), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
        if self.mode == "typed":
            out.append(F.when(unknown > 0, F.lit("unknown fields")))
        else:
            out.append(F.when(unknown > self.max_extra, F.lit("too many fields")))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    def with_defaults(self, df: DataFrame, collection_defaults: dict | None = None) -> DataFrame:
        """Missing fields get the field's default, else the collection's."""
        more = collection_defaults or {}
        for f in self.fields:
            value = f.default if f.default is not None else more.get(f.name)
            if value is not None:
                own = F.col(f.name) if f.name in df.columns else F.lit(None)
                df = df.withColumn(f.name, F.coalesce(own, F.lit(value)).cast(TYPES[f.type]))
        return df

    # -- evolution: nothing is removed or narrowed

    def _with(self, f: Field) -> Schema:
        return replace(self, fields=tuple(f if x.name == f.name else x for x in self.fields), version=self.version + 1)

    def add_field(self, f: Field) -> Schema:
        if any(x.name == f.name for x in self.fields):
            raise EvolutionError(f"{f.name} exists")
        if f.required and f.default is None:
            raise EvolutionError("a new required field needs a default")
        return replace(self, fields=(*self.fields, f), version=self.version + 1)

    def make_optional(self, name: str) -> Schema:
        return self._with(replace(self.get(name), required=False, optional=True))

    def widen(self, name: str, to: str) -> Schema:
        f = self.get(name)
        if not widens(f.type, to):
            raise EvolutionError(f"{f.type} can't become {to}")
        return self._with(replace(f, type=to))

    def longer(self, name: str, max_length: int | None) -> Schema:
        f = self.get(name)
        if f.max_length is None or max_length is not None and max_length < f.max_length:
            raise EvolutionError("a length can't shrink")
        return self._with(replace(f, max_length=max_length))

    def add_default(self, name: str, value) -> Schema:
        return self._with(replace(self.get(name), default=value))

    def deprecate(self, name: str) -> Schema:
        return self._with(replace(self.get(name), deprecated=True))

    def add_value(self, name: str, value: str) -> Schema:
        f = self.get(name)
        return self._with(replace(f, values=(*f.values, value)))

    def add_index(self, name: str) -> Schema:
        return replace(self, indexes=(*self.indexes, name), version=self.version + 1)

    def read_as(self, df: DataFrame) -> DataFrame:
        """Rows of an older version in this one: casts where a type was widened, nulls or defaults where a field is new."""
        old = set(df.columns)
        out = df.select(*[(F.col(f.name) if f.name in old else F.lit(None)).cast(TYPES[f.type]).alias(f.name) for f in self.fields])
        return self.with_defaults(out)


def widens(a: str, b: str) -> bool:
    """Can values of a be read as b by a chain of steps within signed, unsigned or floating numbers?"""
    if a == b:
        return True
    return any(x == a and widens(y, b) for x, y in WIDER)


def vector_violation(c: str, dimensions: int) -> Column:
    return F.size(c) != dimensions
