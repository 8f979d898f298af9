"""Property values as Catalyst expressions, and checks of generated columns."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.rng import hash_bits, int_between, long_between, pick, uniform

# Bounds of the stored number types.
INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1
LONG_MIN, LONG_MAX = -(2 ** 63), 2 ** 63 - 1
KINDS = ("int", "integer", "long", "double", "bool", "boolean", "string", "date", "list")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
COMPANY_NAMES = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Ginkgo", "Hazel", "Ivy", "Juniper",
                 "Katsura", "Larch", "Maple", "Nutmeg", "Oak", "Pine", "Quince", "Rowan", "Spruce", "Teak"]
COMPANY_FORMS = ["Inc", "LLC", "Ltd", "Group", "PLC", "and Sons"]


# ---- specs with explicit ranges ---------------------------------------------

def check_spec(name: str, spec: Mapping) -> None:
    """Raise for an unknown kind, a reversed or out-of-bounds range, or a nested list."""
    kind = str(spec.get("type", "")).lower()
    if kind not in KINDS:
        raise ValueError(f"{name}: unknown type {spec.get('type')!r}")
    limits = {"int": (INT_MIN, INT_MAX), "integer": (INT_MIN, INT_MAX), "long": (LONG_MIN, LONG_MAX)}
    pairs = {"int": ("min", "max"), "integer": ("min", "max"), "long": ("min", "max"), "double": ("min", "max"),
             "string": ("min_size", "max_size"), "date": ("min_year", "max_year"),
             "list": ("min_length", "max_length")}
    if kind in pairs:
        lo, hi = (spec[k] for k in pairs[kind])
        if lo > hi:
            raise ValueError(f"{name}: {pairs[kind][0]} {lo} exceeds {pairs[kind][1]} {hi}")
        if kind in limits and (lo < limits[kind][0] or hi > limits[kind][1]):
            raise ValueError(f"{name}: range outside {kind}")
        if kind in ("string", "list") and lo < 0:
            raise ValueError(f"{name}: negative length")
    if kind == "string" and not spec.get("allowed_chars"):
        raise ValueError(f"{name}: no allowed characters")
    if kind in ("bool", "boolean") and not 0 <= spec["true_chance"] <= 100:
        raise ValueError(f"{name}: true_chance outside 0..100")
    if kind == "list":
        if str(spec["element"].get("type", "")).lower() == "list":
            raise ValueError(f"{name}: lists may not be nested")
        check_spec(f"{name}[]", spec["element"])


def _repeat(length: Column, item: Callable[[Column], Column], sql_type: str) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1)).cast("int")), item)
    return F.when(length > 0, made).otherwise(F.array().cast(f"array<{sql_type}>"))


def _text(length: Column, chars: str, seed: int, stream: str, keys, algo) -> Column:
    letters = F.array(*[F.lit(c) for c in chars])
    def one(i):
        u = uniform(seed, f"{stream}/chars", *keys, i, algo=algo)
        return F.element_at(letters, (F.floor(u * float(len(chars))) + 1).cast("int"))
    return F.array_join(_repeat(length, one, "string"), "")


def random_value(spec: Mapping, seed: int, stream: str, *keys: Column, algo: str = "xxhash64") -> Column:
    """Int, long, double, string, bool, date or list value for a row key."""
    kind = str(spec["type"]).lower()
    u = uniform(seed, stream, *keys, algo=algo)
    if kind in ("int", "integer"):
        return int_between(u, spec["min"], spec["max"]).cast("int")
    if kind == "long":
        return long_between(seed, stream, spec["min"], spec["max"], *keys, algo=algo)
    if kind == "double":
        lo, hi = float(spec["min"]), float(spec["max"])
        return F.lit(lo) + u * F.lit(hi - lo)
    if kind in ("bool", "boolean"):
        return u < F.lit(spec["true_chance"] / 100.0)
    if kind == "string":
        return _text(int_between(u, spec["min_size"], spec["max_size"]), spec["allowed_chars"],
                     seed, stream, keys, algo)
    if kind == "date":
        year = int_between(u, spec["min_year"], spec["max_year"]).cast("int")
        month = int_between(uniform(seed, f"{stream}/month", *keys, algo=algo), 1, 12).cast("int")
        first = F.make_date(year, month, F.lit(1))
        day = F.floor(uniform(seed, f"{stream}/day", *keys, algo=algo) * F.day(F.last_day(first)))
        return F.date_add(first, day.cast("int"))
    if kind == "list":
        length = int_between(u, spec["min_length"], spec["max_length"])
        return _repeat(length, lambda i: random_value(spec["element"], seed, f"{stream}[]", *keys, i, algo=algo),
                       sql_type(spec["element"]["type"]))
    raise ValueError(f"unknown type {spec['type']!r}")


def sql_type(kind: str) -> str:
    return {"int": "int", "integer": "int", "long": "bigint", "double": "double", "bool": "boolean",
            "boolean": "boolean", "string": "string", "date": "date"}[kind.lower()]


def property_columns(specs: Mapping[str, Mapping], seed: int, stream: str, key: Column) -> list[Column]:
    return [random_value(s, seed, f"{stream}.{name}", key).alias(name) for name, s in (specs or {}).items()]


# ---- named providers --------------------------------------------------------

def _pyint(seed, stream, keys, min_value=0, max_value=9999, step=1):
    slot = long_between(seed, stream, 0, (max_value - min_value) // step, *keys)
    return F.lit(min_value).cast("bigint") + slot * F.lit(step).cast("bigint")


def _pyfloat(seed, stream, keys, min_value=-1e9, max_value=1e9):
    return F.lit(float(min_value)) + uniform(seed, stream, *keys) * F.lit(float(max_value) - float(min_value))


def _pybool(seed, stream, keys, truth_probability=50):
    return uniform(seed, stream, *keys) < F.lit(truth_probability / 100.0)


def _pystr(seed, stream, keys, min_chars=0, max_chars=20):
    length = int_between(uniform(seed, stream, *keys), min_chars, max_chars)
    return _text(length, LETTERS, seed, stream, keys, "xxhash64")


def _date(seed, stream, keys, first_year=1970, last_year=2025):
    return random_value({"type": "date", "min_year": first_year, "max_year": last_year}, seed, stream, *keys)


def _company(seed, stream, keys):
    return F.concat_ws(" ", pick(COMPANY_NAMES, uniform(seed, stream, *keys)),
                       pick(COMPANY_FORMS, uniform(seed, f"{stream}/form", *keys)))


def _random_element(seed, stream, keys, elements=("a", "b", "c")):
    return pick(list(elements), uniform(seed, stream, *keys))


def _pylist(seed, stream, keys, nb_elements=10, allowed_types=("str",)):
    inner = {"str": _pystr, "int": _pyint, "float": _pyfloat, "bool": _pybool}[str(allowed_types[0])]
    return F.transform(F.sequence(F.lit(1), F.lit(nb_elements)),
                       lambda i: inner(seed, f"{stream}[]", (*keys, i)))


# name -> expression builder; add an entry to extend.
PROVIDERS: dict[str, Callable[..., Column]] = {
    "pyint": _pyint, "pyfloat": _pyfloat, "pybool": _pybool, "pystr": _pystr, "date": _date,
    "company": _company, "random_element": _random_element, "pylist": _pylist,
}


def register_provider(name: str, build: Callable[[Column], Column]) -> None:
    """Add a provider: ``build`` maps a uniform column to a value column."""
    PROVIDERS[name] = lambda seed, stream, keys, **_: build(uniform(seed, stream, *keys))


def provider_call(text: str) -> tuple[str, list, dict]:
    """``name(args, key=value)`` with literal arguments (bare type names count as text)."""
    node = ast.parse(text, mode="eval").body
    if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
        raise ValueError(f"not a provider call: {text!r}")

    def literal(x):
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, (ast.List, ast.Tuple)):
            return [literal(e) for e in x.elts]
        return ast.literal_eval(x)

    if any(k.arg is None for k in node.keywords):
        raise ValueError("** is not allowed in a provider call")
    return node.func.id, [literal(a) for a in node.args], {k.arg: literal(k.value) for k in node.keywords}


def provided_value(spec: Mapping, seed: int, stream: str, *keys: Column) -> Column:
    """Value of ``spec``: generator, type, pool_size (20), prefer_unique.

    A pool of p values is the provider applied to ``hash % p`` instead of the row key, so no
    list is ever built; ``prefer_unique`` uses the row key itself.
    """
    name, args, kwargs = provider_call(spec["generator"])
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    if args:
        import inspect

        params = list(inspect.signature(PROVIDERS[name]).parameters)[3:]
        kwargs = {**dict(zip(params, args)), **kwargs}
    pool = int(spec.get("pool_size") or 20)
    if not spec.get("prefer_unique"):
        keys = (F.pmod(hash_bits(seed, f"{stream}/pool", *keys), F.lit(pool)),)
    value = PROVIDERS[name](seed, stream, keys, **kwargs)
    kind = str(spec.get("type", "string")).lower()
    return value if kind == "list" else value.cast(sql_type(kind))


def provided_columns(specs: Mapping[str, Mapping] | None, seed: int, stream: str, key: Column) -> list[Column]:
    return [provided_value(s, seed, f"{stream}.{name}", key).alias(name) for name, s in (specs or {}).items()]


# ---- checks ----------------------------------------------------------------

def check_values(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``column, checked, bad`` in one pass: NULLs, out-of-range, non-finite, non-ISO, NULL elements."""
    tests = {}
    for name, kind in kinds.items():
        c, k = F.col(name), kind.lower()
        if k not in KINDS:
            raise ValueError(f"{name}: unknown type {kind!r}")
        if k in ("int", "integer"):
            ok = c.cast("decimal(38,0)").between(F.lit(INT_MIN), F.lit(INT_MAX))
        elif k == "double":
            ok = ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
        elif k == "date":
            from hopframe.functions.scalars import is_iso_date

            ok = is_iso_date(c.cast("string"))
        elif k == "list":
            ok = ~F.exists(c, lambda x: x.isNull())
        else:
            ok = c.isNotNull()
        tests[name] = F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    row = df.agg(F.count(F.lit(1)).alias("_all"), *[t.alias(n) for n, t in tests.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col("_all").alias("checked"), F.col(n).alias("bad"))
                      for n in tests])
    return row.select(F.explode(cells).alias("r")).select("r.*")
