"""Integrity rules as distributed table checks.

Every check returns a violations DataFrame ``(table_name, rule, key,
detail)``; a clean table gives zero rows. Checks are aggregations (key
uniqueness), filters (NOT NULL, CHECK, ENUM, widths) and anti-joins
(foreign keys, total participation) — no row is collected anywhere.

``key`` is the row's primary key as text, parts joined by ``|`` and NULL
parts written ``NULL``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from storeline.functions.expressions import collated
from storeline.schemas import SPECS, VIOLATION_SCHEMA, TableSpec

NULL_TEXT = "NULL"


def key_text(cols: Iterable[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))
                              for c in cols])


def _v(df: DataFrame, table: str, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     key.alias("key"), detail.cast("string").alias("detail"))


def _row_rules(df: DataFrame, table: str, key_cols, rules,
               spec: TableSpec | None = None) -> DataFrame | None:
    """All row-level rules of one table in a single pass.

    ``rules`` is a list of ``(rule, column, failed_condition, detail)``;
    each row yields one violation per failed rule (array of structs,
    exploded), so the table is scanned once however many rules it carries.
    A column the frame does not carry counts as NULL in every row: its NOT
    NULL rule fails for every row, its other rules pass (as NULL does).
    """
    if not rules:
        return None
    types = {f.name: f.dataType for f in (spec or SPECS[table]).schema.fields} \
        if (spec or table in SPECS) else {}
    for c in dict.fromkeys(col for _, col, _, _ in rules):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    rules = [(r, cond, detail) for r, _, cond, detail in rules]
    hits = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
        for rule, cond, detail in rules]))
    # The OR of the failure conditions goes first as a filter: when every
    # condition is a plain comparison or NULL test it reaches the Parquet scan,
    # and row groups whose statistics rule out a failure are skipped (on
    # clean data only footers are read).
    any_failed = rules[0][1]
    for _, cond, _ in rules[1:]:
        any_failed = any_failed | cond
    return (df.filter(any_failed)
            .select(key_text(key_cols).alias("key"), F.explode(hits).alias("_v"))
            .select(F.lit(table).alias("table_name"), F.col("_v.rule").alias("rule"),
                    "key", F.col("_v.detail").alias("detail")))


def _union(tables: Mapping[str, DataFrame], parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return _spark(tables).createDataFrame([], VIOLATION_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _items(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None, rules=None):
    """(name, spec, frame) for each table; ``specs`` may rename a frame's spec.

    With ``rules``, a table of whose spec it gives nothing is passed over: its frame, which may have to be built first
    (``Tables``), is not asked for.
    """
    for name in tables:
        spec = (specs or {}).get(name) or SPECS.get(name)
        if spec is not None and (rules is None or rules(spec)):
            yield name, spec, tables[name]


def _spark(tables):
    for n in tables:
        return tables[n].sparkSession
    raise ValueError("no tables")


# I1 ----------------------------------------------------------------------

def check_primary_key(tables: Mapping[str, DataFrame],
                      specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """Primary keys: one row per duplicated key value, one per NULL-key row."""
    parts = []
    for name, spec, df in _items(tables, specs):
        pk = list(spec.primary_key)
        any_null = F.lit(False)
        for c in pk:
            any_null = any_null | F.col(c).isNull()
        dup = (df.select(*pk).filter(~any_null).groupBy(*pk).count()
                 .filter(F.col("count") > 1))
        parts.append(_v(dup, name, "PRIMARY_KEY_DUPLICATE", key_text(pk),
                        F.concat(F.lit("rows="), F.col("count").cast("string"))))
        parts.append(_v(df.filter(any_null), name, "PRIMARY_KEY_NULL", key_text(pk),
                        F.lit(",".join(pk))))
    return _union(tables, parts)


# I2 ----------------------------------------------------------------------

def unique_key(df: DataFrame, c: str) -> Column:
    """What a unique column is compared by: texts without regard to case and accents."""
    return collated(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)


def check_unique(tables: Mapping[str, DataFrame],
                 specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """Secondary unique columns; NULLs never collide. Texts that differ in case or accents
    only are equal; the smallest of them is the key."""
    parts = []
    for name, spec, df in _items(tables, specs, lambda spec: spec.unique):
        for c in spec.unique:
            dup = (df.select(c).filter(F.col(c).isNotNull())
                     .groupBy(unique_key(df, c).alias("_k")).agg(F.count(F.lit(1)).alias("count"), F.min(c).alias(c))
                     .filter(F.col("count") > 1).drop("_k"))
            parts.append(_v(dup, name, "UNIQUE", F.col(c).cast("string"),
                            F.concat(F.lit(f"{c} rows="), F.col("count").cast("string"))))
    return _union(tables, parts)


# I3 ----------------------------------------------------------------------

def _not_null_rules(spec: TableSpec):
    return [("NOT_NULL", c, F.col(c).isNull(), F.lit(c)) for c in spec.not_null]


def check_not_null(tables: Mapping[str, DataFrame],
                   specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    parts = [_row_rules(df, name, spec.primary_key, _not_null_rules(spec), spec)
             for name, spec, df in _items(tables, specs, _not_null_rules)]
    return _union(tables, [p for p in parts if p is not None])


# I4 ----------------------------------------------------------------------

def check_foreign_key(tables: Mapping[str, DataFrame],
                      specs: Mapping[str, TableSpec] | None = None,
                      parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Child rows (all FK columns set) without a parent row: a left anti-join.

    The parent key set is the only thing shuffled besides the child keys;
    AQE broadcasts it when it is small.
    """
    parents = parents if parents is not None else tables
    parts = []
    for name, spec, df in _items(tables, specs, lambda spec: spec.foreign_keys):
        for fk in spec.foreign_keys:
            if fk.parent not in parents:
                continue
            child = df
            for c in fk.columns:
                child = child.filter(F.col(c).isNotNull())
            pk = [f"_p{i}" for i in range(len(fk.columns))]
            parent = (parents[fk.parent]
                      .select([F.col(pc).alias(a) for pc, a in zip(fk.parent_columns, pk)]))
            cond = [child[c] == parent[a] for c, a in zip(fk.columns, pk)]
            orphans = child.join(parent, cond, "left_anti")
            detail = f"({','.join(fk.columns)})->{fk.parent}"
            parts.append(_v(orphans, name, "FOREIGN_KEY", key_text(spec.primary_key),
                            F.lit(detail)))
    return _union(tables, parts)


# I5 ----------------------------------------------------------------------

def _range_rules(spec: TableSpec):
    # a CHECK fails when its predicate is FALSE; NULL passes
    return [("CHECK", c, ~F.expr(pred), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
            for c, pred in spec.ranges.items()]


def check_range(tables: Mapping[str, DataFrame],
                specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """CHECK constraints: a row fails when the predicate is FALSE (NULL passes)."""
    parts = [_row_rules(df, name, spec.primary_key, _range_rules(spec), spec)
             for name, spec, df in _items(tables, specs, _range_rules)]
    return _union(tables, [p for p in parts if p is not None])


# I6 ----------------------------------------------------------------------

def outside_domain(c: str, allowed: Sequence[str]) -> Column:
    """Whether a set value is none of the labels, which are compared without regard to case and accents."""
    return F.col(c).isNotNull() & ~collated(F.col(c)).isin(*allowed)


def _domain_rules(spec: TableSpec):
    return [("DOMAIN", c, outside_domain(c, allowed),
             F.concat(F.lit(f"{c}="), F.col(c))) for c, allowed in spec.domains.items()]


def check_domain(tables: Mapping[str, DataFrame],
                 specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """ENUM columns: a set value outside the declared domain."""
    parts = [_row_rules(df, name, spec.primary_key, _domain_rules(spec), spec)
             for name, spec, df in _items(tables, specs, _domain_rules)]
    return _union(tables, [p for p in parts if p is not None])


# I7 ----------------------------------------------------------------------

def _width_rules(spec: TableSpec):
    rules = [("WIDTH", c, F.char_length(F.col(c)) > n,
              F.concat(F.lit(f"{c} chars="), F.char_length(c).cast("string")))
             for c, n in spec.widths.items()]
    rules += [("PRECISION", c, F.col(c).isNotNull()
               & F.expr(f"try_cast({c} AS decimal({p},{s}))").isNull(),
               F.lit(f"{c} decimal({p},{s})")) for c, (p, s) in spec.decimals.items()]
    rules += [("UNSIGNED", c, F.col(c) < 0, F.lit(c)) for c in spec.unsigned]
    return rules


def check_width(tables: Mapping[str, DataFrame],
                specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """VARCHAR(n) length, DECIMAL(p,s) precision and unsigned columns."""
    parts = [_row_rules(df, name, spec.primary_key, _width_rules(spec), spec)
             for name, spec, df in _items(tables, specs, _width_rules)]
    return _union(tables, [p for p in parts if p is not None])


# I9 ----------------------------------------------------------------------

def check_sale_has_items(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every sale has at least one line item (total participation)."""
    bare = (tables["sale"].select("sale_id")
            .join(tables["sale_line_item"].select("sale_id"), "sale_id", "left_anti"))
    return _v(bare, "sale", "TOTAL_PARTICIPATION", key_text(["sale_id"]),
              F.lit("no sale_line_item"))


def check_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every rule over every table, one violations frame.

    Row rules of a table take two scans: NOT NULL and CHECK together (their
    filter pushes down to Parquet statistics), ENUM and widths together; key
    rules are one aggregate each; references one anti-join each.
    """
    row = []
    for name, spec, df in _items(tables, None):
        # rules whose failure tests push down to the scan, then the rest
        row.append(_row_rules(df, name, spec.primary_key,
                              _not_null_rules(spec) + _range_rules(spec), spec))
        row.append(_row_rules(df, name, spec.primary_key,
                              _domain_rules(spec) + _width_rules(spec), spec))
    parts = [check_primary_key(tables), check_unique(tables), check_foreign_key(tables)]
    parts += [p for p in row if p is not None]
    if "sale" in tables and "sale_line_item" in tables:
        parts.append(check_sale_has_items(tables))
    return _union(tables, parts)
