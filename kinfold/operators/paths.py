"""Output paths compiled to columns: a value, and whether it is present (missing isn't null)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# The four path forms.
_PROJECTION, _INDEX, _DOT = re.compile(r"^(\w+)\[\]\.(.+)$"), re.compile(r"^(\w+)\[(\d+)\]$"), re.compile(r"^(\w+)\.(.+)$")

Resolved = tuple[Column, Column, DataType] | None


def _nested(value: Column, present: Column, kind: DataType, path: str) -> Resolved:
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        value, present, kind = value[name], present & value.isNotNull(), kind[name].dataType
    return value, present, kind


def compile_path(path: str, schema: StructType) -> Resolved:
    """(value, present, type) of field, field[i], field[].a.b or field.a.b; None for a path that no record has.

    A null field is present and null. An index outside the list, an empty projection and a path through a null
    are missing. Nulls inside a projection stay.
    """
    whole = F.lit(True)
    if found := _PROJECTION.match(path):
        base, rest = found.groups()
        if base not in schema.names or not isinstance(kind := schema[base].dataType, ArrayType):
            return None
        if (inner := _nested(F.col(base), whole, kind.elementType, rest)) is None:
            return None
        steps = rest.split(".")

        def leaf(x: Column) -> Column:
            for name in steps:
                x = x[name]
            return x

        def there(x: Column) -> Column:
            ok = x.isNotNull()
            for name in steps[:-1]:
                x = x[name]
                ok = ok & x.isNotNull()
            return ok

        value = F.transform(F.filter(F.col(base), there), leaf)
        return value, F.coalesce(F.size(value) > 0, F.lit(False)), ArrayType(inner[2])
    if found := _INDEX.match(path):
        base, i = found[1], int(found[2])
        if base not in schema.names or not isinstance(kind := schema[base].dataType, ArrayType):
            return None
        return F.get(F.col(base), i), F.coalesce(F.size(base) > i, F.lit(False)), kind.elementType
    if found := _DOT.match(path):
        base, rest = found.groups()
        return _nested(F.col(base), whole, schema[base].dataType, rest) if base in schema.names else None
    return (F.col(path), whole, schema[path].dataType) if path in schema.names else None
