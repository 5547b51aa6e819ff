"""Message validation with reasons.

A JSON text column is parsed once to a VARIANT; each field is looked up
by its camelCase alias first (an alias key wins even when its value is
null) and then by its snake_case name. Lax coercion follows the message
schema of the reference:
  str    JSON string only
  float  JSON number, numeric string, or boolean (1.0 / 0.0)
  int    integral JSON number (3.0 accepted, 3.5 refused), string of
         digits, or boolean; within 64 bits, read without a detour by double
  bool   JSON boolean, number 0/1, or one of the usual words, not padded
A key given twice counts with its last value.
Non-negative fields refuse negatives and NaN. Missing optional fields take
their default; unknown keys are ignored, or refused with ``strict=True``.

Output: input columns + ``is_valid``, ``errors`` (``field:code`` joined by
``;`` in field order) and one typed column per field (snake_case).
Everything is a JVM expression: no Python, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.schemas import LEGACY_PAYLOAD_FIELDS, REQUEST_FIELDS

# fixed values: words accepted for booleans
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]
# number texts: digits with a point or exponent as the type allows, and the float words
INT_TEXT = r"^ *[+-]?[0-9]+(\.0+)? *$"
FLOAT_TEXT = r"(?i)^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)? *$|^ *[+-]?(nan|inf|infinity) *$"
SPARK_TYPES = {"str": "string", "float": "double", "int": "bigint", "bool": "boolean"}


def _kind_of(raw: Column, t: Column) -> Column:
    """``t``: the value's schema text, taken once, as writing it costs more than all comparisons."""
    return (F.when(raw.isNull(), F.lit("missing"))
             .when(F.is_variant_null(raw), F.lit("null"))
             .when(t == "STRING", F.lit("string"))
             .when(t == "BOOLEAN", F.lit("bool"))
             .when((t == "BIGINT") | (t == "DOUBLE") | (t == "FLOAT") | (t == "INT") | (t == "SMALLINT")
                   | (t == "TINYINT") | t.startswith("DECIMAL"), F.lit("number"))
             .otherwise(F.lit("other")))


def _coerce(raw: Column, k: Column, kind: str) -> tuple[Column, Column]:
    """(value, ok) for a present, non-null JSON value of kind ``k``."""
    text = F.try_variant_get(raw, "$", "string")
    num = F.try_variant_get(raw, "$", "double")
    boolv = F.try_variant_get(raw, "$", "boolean")
    if kind == "str":
        return F.when(k == "string", text), k == "string"
    if kind == "float":
        val = (F.when(k == "number", num)
                .when((k == "string") & text.rlike(FLOAT_TEXT), F.trim(text).try_cast("double"))
                .when(k == "bool", boolv.cast("double")))
        return val, val.isNotNull()
    if kind == "int":
        digits = F.regexp_replace(F.trim(text), r"\.0+$", "")
        val = (F.when((k == "number") & (num == F.floor(num)), F.try_variant_get(raw, "$", "bigint"))
                .when((k == "string") & text.rlike(INT_TEXT), digits.try_cast("bigint"))
                .when(k == "bool", boolv.cast("bigint")))
        return val, val.isNotNull()
    if kind == "bool":
        word = F.lower(text)
        val = (F.when(k == "bool", boolv)
                .when((k == "number") & (num == 1), F.lit(True))
                .when((k == "number") & (num == 0), F.lit(False))
                .when((k == "string") & word.isin(*TRUE_WORDS), F.lit(True))
                .when((k == "string") & word.isin(*FALSE_WORDS), F.lit(False)))
        return val, val.isNotNull()
    raise ValueError(kind)


def validate_json(df: DataFrame, value: str = "value", fields=REQUEST_FIELDS, strict: bool = False,
                  accept_snake: bool = True) -> DataFrame:
    # Staged projections: parse once, then per field raw value -> kind ->
    # typed value / error code. Each stage references the previous one's
    # columns, so no sub-expression is repeated inside a stage.
    specs = [_spec(s) for s in fields]
    out = df.withColumn("_v", F.try_parse_json(F.col(value).cast("string")))
    out = out.withColumn("_obj", F.coalesce(F.col("_v").isNotNull()
                                             & F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    raws, known = {}, []
    for snake, alias, kind, required, default, nonneg in specs:
        known += [alias] + ([snake] if accept_snake and snake != alias else [])
        a = F.variant_get("_v", f"$.{alias}", "variant")
        raw = a
        if accept_snake and snake != alias:
            raw = F.coalesce(a, F.variant_get("_v", f"$.{snake}", "variant"))
        raws[f"_r_{snake}"] = raw
    out = out.withColumns(raws)
    out = out.withColumns({f"_t_{s[0]}": F.schema_of_variant(f"_r_{s[0]}") for s in specs})
    out = out.withColumns({f"_k_{s[0]}": _kind_of(F.col(f"_r_{s[0]}"), F.col(f"_t_{s[0]}")) for s in specs})
    vals, oks = {}, {}
    for snake, alias, kind, required, default, nonneg in specs:
        val, ok = _coerce(F.col(f"_r_{snake}"), F.col(f"_k_{snake}"), kind)
        if not required:
            val = F.when(F.col(f"_k_{snake}") == "missing", F.lit(default)).otherwise(val)
        vals[f"_x_{snake}"] = val.cast(SPARK_TYPES[kind])
    out = out.withColumns(vals)
    codes = {}
    for snake, alias, kind, required, default, nonneg in specs:
        k, val = F.col(f"_k_{snake}"), F.col(f"_x_{snake}")
        code = (F.when(k == "missing", F.lit(None if not required else "missing"))
                 .when(k == "null", F.lit("null"))
                 .when(val.isNull(), F.lit("type")))
        if nonneg:
            code = F.when(code.isNull() & (F.isnan(val.cast("double")) | (val < 0)), F.lit("negative")).otherwise(code)
        codes[f"_c_{snake}"] = code
    out = out.withColumns(codes)
    # concat_ws skips NULL codes: no array or lambda, so this stays in generated code
    parts = [F.concat(F.lit(s[1] + ":"), F.col(f"_c_{s[0]}")) for s in specs]
    if strict:
        keys = F.json_object_keys(F.col(value).cast("string"))
        extra = F.sort_array(F.array_except(keys, F.array(*[F.lit(x) for x in known])))
        parts.append(F.when(F.size(extra) > 0,
                            F.concat(F.array_join(extra, ":extra_forbidden;"), F.lit(":extra_forbidden"))))
    errors = F.when(F.col("_obj"), F.concat_ws(";", *parts)).otherwise(F.lit("json:malformed"))
    typed = [F.when(F.col("_obj") & F.col(f"_c_{s[0]}").isNull(), F.col(f"_x_{s[0]}")).alias(s[0]) for s in specs]
    # a generator, so that a filter on the outcome is not moved below the stages, where it would repeat them all inline
    out = out.select(*df.columns, F.inline(F.array(F.struct(errors.alias("errors"), *typed))))
    return out.withColumn("is_valid", F.col("errors") == "")


def _spec(spec):
    if len(spec) == 6:
        return spec
    name, kind = spec
    return name, name, kind, True, None, False


def validate_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """L7 evaluation requests: camelCase or snake_case keys, unknown keys ignored."""
    return validate_json(df, value, REQUEST_FIELDS, strict=False)


def strict_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """L9 legacy payload: snake_case keys only, unknown keys refused."""
    return validate_json(df, value, LEGACY_PAYLOAD_FIELDS, strict=True, accept_snake=False)


def with_outcome(checked: DataFrame, valid: bool, flag: str = "is_valid") -> DataFrame:
    """The rows whose ``flag`` equals ``valid``.

    A generator, not a filter: the optimizer would move a filter below the
    staged projections, inline the whole error expression into it and
    evaluate everything twice."""
    row = F.array(F.struct(*checked.columns))
    return checked.select(F.inline(F.when(F.col(flag) == valid, row).otherwise(F.slice(row, 1, 0))))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons). Nothing is cached, so each side reads the input;
    :func:`write_outcomes` gets both from one pass."""
    return with_outcome(validated, True), with_outcome(validated, False)


def write_outcomes(checked: DataFrame, path: str, mode: str = "error") -> None:
    """Valid and rejected rows by one job, as ``is_valid=true`` and ``is_valid=false`` below ``path``."""
    checked.write.mode(mode).partitionBy("is_valid").parquet(path)
