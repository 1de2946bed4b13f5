"""Masking of secrets in every text column, as literal replacements in the JVM; it runs after all analysis."""

from __future__ import annotations

import base64
from collections.abc import Callable
from urllib.parse import quote, quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

MASK = "[redacted]"


def variants(secret: str) -> list[str]:
    """The forms a secret may take, longest first; those below three characters are matched whole only."""
    forms = {secret, quote(secret, safe="!~*'()"), quote_plus(secret)}
    scheme, _, payload = secret.partition(" ")
    if scheme.lower() in ("bearer", "basic") and payload:
        forms.add(payload)
        if scheme.lower() == "basic":
            try:
                forms.add(base64.b64decode(payload).decode())
            except ValueError:
                pass
    for form in list(forms):
        raw = base64.b64encode(form.encode()).decode()
        forms |= {raw, raw.rstrip("="), raw.replace("+", "-").replace("/", "_").rstrip("=")}
    return sorted((f for f in forms if f), key=lambda f: (-len(f), f))


def redact(value: Column, secrets: list[str]) -> Column:
    out = value
    forms = sorted({f for s in secrets for f in variants(s)}, key=lambda f: (-len(f), f))
    for form in forms:
        out = F.replace(out, F.lit(form), F.lit(MASK)) if len(form) >= 3 else F.when(out == form, MASK).otherwise(out)
    return out


def _struct_redactor(fields: list[StructField], secrets: list[str]) -> Callable[[Column], Column]:
    """Masks the strings of a struct, but for the key and type of evidence entries."""
    masked = lambda x, f: redact(x[f.name], secrets) if f.dataType.simpleString() == "string" and f.name not in ("k", "t") else x[f.name]
    return lambda x: F.struct(*[masked(x, f).alias(f.name) for f in fields])


def redact_table(df: DataFrame, secrets: list[str], columns: list[str]) -> DataFrame:
    """`df` with the listed string, array<string>, map and evidence columns masked; enumerations are left alone."""
    kinds, out = dict(df.dtypes), {}
    for c in columns:
        kind = kinds[c]
        if kind == "string":
            out[c] = redact(F.col(c), secrets)
        elif kind == "array<string>":
            out[c] = F.transform(c, lambda x: redact(x, secrets))
        elif kind.startswith("map<string,string"):
            out[c] = F.transform_values(c, lambda _, v: redact(v, secrets))
        else:
            out[c] = F.transform(c, _struct_redactor(df.schema[c].dataType.elementType.fields, secrets))
    return df.withColumns(out)
