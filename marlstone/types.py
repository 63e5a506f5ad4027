"""The type contract: parsing, widening, supertypes, nullability, and the Spark type behind each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

# Names without parameters, and the Spark type that stores each.
SIMPLE = {
    "String": T.StringType(),
    "Integer": T.LongType(),
    "Float": T.DoubleType(),
    "Boolean": T.BooleanType(),
    "Date": T.DateType(),
    "Time": T.LongType(),  # microseconds since midnight
    "DateTime": T.TimestampNTZType(),
    "DateTimeTz": T.TimestampType(),
    "Binary": T.BinaryType(),
    "Opaque": T.StringType(),
}
# Geometry subtypes, each also with Z, M and ZM.
GEOMETRIES = ("Any", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
MAX_PRECISION = 38
DEFAULT_DECIMAL = (38, 18)
MAX_VECTOR = 16000


class TypeProblem(ValueError):
    """A type that can't be written, joined, or stored."""


class Nullability(IntEnum):
    """How sure we are that a column holds no null. The meet of two is the smaller."""

    NULLABLE = 0
    DERIVED = 1
    GUARANTEED = 2

    def downstream(self) -> Nullability:
        """A guarantee belongs to the declaring column; what is computed from it is only derived."""
        return min(self, Nullability.DERIVED)


@dataclass(frozen=True)
class Type:
    name: str
    precision: int | None = None
    scale: int | None = None
    unit: str | None = None
    item: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()
    size: int | None = None
    crs: str | None = None

    def __str__(self) -> str:
        match self.name:
            case "Decimal":
                return "Decimal" if self.precision is None else f"Decimal<{self.precision},{self.scale}>"
            case "Money" | "Quantity":
                return f"{self.name}<{self.unit},{self.scale}>"
            case "list":
                return f"list<{self.item}>"
            case "Struct":
                return f"Struct<{', '.join(f'{n}: {t}' for n, t in self.fields)}>"
            case "Vector":
                return f"Vector<{self.size}>"
            case "Geometry":
                return f"Geometry<{self.unit},{self.crs}>"
            case "Geography":
                return f"Geography<{self.unit}>"
            case "Media":
                return f"Media<{self.unit}>"
        return self.name

    @property
    def digits(self) -> tuple[int, int]:
        """Precision and scale of a decimal type."""
        return DEFAULT_DECIMAL if self.precision is None else (self.precision, self.scale or 0)


def decimal(p: int, s: int) -> Type:
    if not (1 <= p <= MAX_PRECISION and 0 <= s <= p):
        raise TypeProblem(f"no Decimal<{p},{s}>")
    return Type("Decimal", p, s)


def _split(text: str) -> list[str]:
    """Parts at commas that no bracket holds."""
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def parse(text: str) -> Type:
    """'Decimal<12,2>', 'list<String>', 'Struct<a: Integer, b: Date>', ... -> Type."""
    text = text.strip()
    m = re.fullmatch(r"(\w+)\s*(?:<(.*)>)?", text, re.S)
    if not m:
        raise TypeProblem(f"not a type: {text!r}")
    name, inner = m[1], m[2]
    if inner is None:
        if name in SIMPLE or name in ("Decimal", "Anchor", "Imported"):
            return Type(name)
        raise TypeProblem(f"unknown type {name!r}")
    args = _split(inner)
    match name:
        case "Decimal":
            if len(args) != 2 or not all(a.isdigit() for a in args):
                raise TypeProblem(f"Decimal takes precision and scale: {text!r}")
            return decimal(int(args[0]), int(args[1]))
        case "Money" | "Quantity":
            places = int(args[1]) if len(args) > 1 else DEFAULT_DECIMAL[1]
            return Type(name, MAX_PRECISION, min(places, DEFAULT_DECIMAL[1]), unit=args[0])
        case "list":
            item = parse(inner)
            if item.name in ("list", "Vector"):
                raise TypeProblem(f"a list holds no {item.name}")
            return Type("list", item=item)
        case "Struct":
            pairs = []
            for a in args:
                n, sep, t = a.partition(":")
                if not sep or not re.fullmatch(r"[a-z_][a-z0-9_]*", n.strip()):
                    raise TypeProblem(f"bad field {a!r}")
                pairs.append((n.strip(), parse(t)))
            if len({n for n, _ in pairs}) != len(pairs):
                raise TypeProblem("a field name comes twice")
            return Type("Struct", fields=tuple(pairs))
        case "Vector":
            if not inner.strip().isdigit() or not 1 <= int(inner) <= MAX_VECTOR:
                raise TypeProblem(f"a vector has 1 to {MAX_VECTOR} components")
            return Type("Vector", size=int(inner))
        case "Geometry" | "Geography":
            base = re.sub(r"(ZM|Z|M)$", "", args[0]) if args[0] != "Any" else "Any"
            if base not in GEOMETRIES:
                raise TypeProblem(f"unknown geometry {args[0]!r}")
            return Type(name, unit=args[0], crs=(args[1] if len(args) > 1 else "OGC:CRS84") if name == "Geometry" else None)
        case "Media":
            return Type("Media", unit=inner.strip())
    raise TypeProblem(f"{name} takes no parameters")


def to_spark(t: Type) -> T.DataType:
    if t.name in SIMPLE:
        return SIMPLE[t.name]
    match t.name:
        case "Decimal":
            return T.DecimalType(*t.digits)
        case "Money" | "Quantity":
            return T.DecimalType(MAX_PRECISION, t.scale)
        case "list":
            return T.ArrayType(to_spark(t.item))
        case "Struct":
            return T.StructType([T.StructField(n, to_spark(f)) for n, f in t.fields])
        case "Vector":
            return T.ArrayType(T.FloatType(), False)
        case "Geometry" | "Geography":
            return T.BinaryType()
        case "Media":
            return T.StructType([T.StructField(n, T.StringType()) for n in ("collection", "path", "version", "digest")])
        case "Anchor":
            return T.StructType([T.StructField(n, T.StringType()) for n in ("id", "parent", "kind", "location")])
    return T.StringType()


def from_spark(t: T.DataType) -> Type:
    """The contract's type of a Spark column; integers of all widths are Integer."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Type("Integer")
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Type("Float")
    if isinstance(t, T.ArrayType):
        return Type("list", item=from_spark(t.elementType))
    if isinstance(t, T.StructType):
        return Type("Struct", fields=tuple((f.name, from_spark(f.dataType)) for f in t.fields))
    for name in ("String", "Boolean", "Date", "DateTime", "DateTimeTz", "Binary"):
        if type(SIMPLE[name]) is type(t):
            return Type(name)
    raise TypeProblem(f"no type for {t.simpleString()}")


def common_decimal(a: Type, b: Type) -> Type:
    """The decimal that holds both without loss. Spark would drop digits over 38; here it's an error."""
    (p1, s1), (p2, s2) = a.digits, b.digits
    s = max(s1, s2)
    p = max(p1 - s1, p2 - s2) + s
    if p > MAX_PRECISION:
        raise TypeProblem(f"{a} and {b} need {p} digits")
    return decimal(p, s)


def widens(a: Type, b: Type) -> bool:
    """Whether a value of a may stand where b is asked for: the only silent conversions there are."""
    if a == b:
        return True
    if b.name == "Decimal":
        p, s = b.digits
        if a.name == "Integer":
            return p - s >= 19
        if a.name == "Decimal":
            return p - s >= a.digits[0] - a.digits[1] and s >= a.digits[1]
    return a.name == "Opaque" and b.name == "Binary"


def comparable(a: Type, b: Type) -> bool:
    number = ("Integer", "Decimal")
    return a == b or (a.name in number and b.name in number) or widens(a, b) or widens(b, a)


def sum_type(t: Type) -> Type:
    if t.name == "Decimal":
        return decimal(MAX_PRECISION, t.digits[1])
    if t.name in ("Integer", "Float", "Money", "Quantity"):
        return t
    raise TypeProblem(f"no sum of {t}")


def avg_type(t: Type) -> Type:
    if t.name == "Integer":
        return decimal(MAX_PRECISION, 9)
    if t.name == "Decimal":
        return decimal(MAX_PRECISION, max(t.digits[1], 9))
    if t.name in ("Float", "Money", "Quantity"):
        return t
    raise TypeProblem(f"no average of {t}")


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    nullability: Nullability = Nullability.NULLABLE
    metadata: dict = field(default_factory=dict, compare=False)

    def to_spark(self) -> T.StructField:
        meta = dict(self.metadata) | ({"unit": self.type.unit} if self.type.unit else {}) | ({"crs": self.type.crs} if self.type.crs else {})
        if self.nullability is not Nullability.NULLABLE:
            meta["never_null"] = self.nullability.name.lower()
        return T.StructField(self.name, to_spark(self.type), self.nullability is Nullability.NULLABLE, meta)
