"""Bulk load under a declared schema with every rule enforced.

``load_validated`` takes raw rows (any column types, matched by name) and
returns ``(valid, violations)``: rows that satisfy every declared rule,
conformed to the table's schema, and the rule breaches in the
``(table_name, rule, key, detail)`` form of ``operators.checks``.

Row rules (type, NOT NULL, CHECK, ENUM, width, unsigned) are per-row
expressions evaluated in one projection; key rules (primary key, unique,
foreign key) are aggregations and anti-joins of the keys alone: the rows
then meet what broke a rule, and are shuffled only where that is much.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from storeline.functions.expressions import collated, seconds_of_day
from storeline.functions.sizing import bounded_broadcast
from storeline.operators.checks import key_text, outside_domain, unique_key
from storeline.schemas import SPECS, TableSpec
from storeline.session import stored as kept
from storeline.sources.tables import conform


FEW_KEYS = 1_000_000  # keys that broke a rule are sent to the rows up to this many; beyond it rows and keys are shuffled


def _with_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add omitted columns: the declared default, else NULL.

    A default applies only to a column that is absent; an explicit NULL in a
    present column stays NULL.
    """
    out = df
    for f in spec.schema.fields:
        if f.name not in df.columns:
            v = spec.defaults.get(f.name)
            out = out.withColumn(f.name, F.lit(v).cast(f.dataType))
    return out


# Text columns a raw load may carry instead of a stored column:
# stored column -> (raw text column, parser). Times of day are stored as
# seconds so that '24:00' (86400) stays distinct from '00:00' (0).
TEXT_SOURCES = {
    "store": {"open_s": ("open_time", seconds_of_day),
              "close_s": ("close_time", seconds_of_day)},
}


def _from_text(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, list[Column]]:
    """Parse raw text columns (e.g. ``open_time``) into stored columns.

    Returns the frame and the issue expressions for text that does not parse.
    """
    issues = []
    for col, (raw_col, parse) in TEXT_SOURCES.get(spec.name, {}).items():
        if col in df.columns or raw_col not in df.columns:
            continue
        df = df.withColumn(col, parse(raw_col))
        issues.append(_issue(F.col(raw_col).isNotNull() & F.col(col).isNull(), f"TYPE:{raw_col}"))
    return df, issues


def _issue(cond: Column, text: str | Column) -> Column:
    return F.when(cond, text if isinstance(text, Column) else F.lit(text))


def _loses_fraction(raw: DataFrame, field: T.StructField) -> Column:
    have = raw.schema[field.name].dataType
    if isinstance(field.dataType, T.IntegralType) and isinstance(have, T.FractionalType):
        return F.col(field.name) != F.floor(F.col(field.name))
    return F.lit(False)


def load_validated(raw: DataFrame, name: str | TableSpec,
                   parents: Mapping[str, DataFrame] | None = None,
                   atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Validate ``raw`` against table ``name``; see module docstring.

    ``parents`` supplies parent tables for foreign-key checks (missing parents
    are skipped). Rows of a duplicated key are all refused: without an
    arrival order there is no first copy. ``atomic=True`` refuses every row
    when any row breaks a rule, as a single multi-row INSERT statement does.
    """
    spec = SPECS[name] if isinstance(name, str) else name
    return _split(judged(raw, spec, parents), spec, atomic)


def load_into(raw: DataFrame, name: str | TableSpec, stored: DataFrame,
              parents: Mapping[str, DataFrame] | None = None,
              atomic: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load ``raw`` into a table that holds rows: its keys and unique values must not be stored yet.

    Returns ``(new_table, valid, violations)``; a clash with a stored row is PRIMARY_KEY_STORED or UNIQUE_STORED.
    Only stored rows in the batch's range of the first key column can clash, so the range (one small aggregate of the
    batch) is pushed into the scan of the stored table, whose files are clustered by it; the keys
    inside meet by a join, which Spark may precede with a bloom filter of the batch's keys.
    """
    spec = SPECS[name] if isinstance(name, str) else name
    valid, violations = _split(judged(raw, spec, parents, stored), spec, atomic)
    return stored.select(*spec.columns).unionByName(valid), valid, violations


def load_all(raws: Mapping[str, DataFrame], participation: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load a whole database: every table through its rules, parents before children.

    A child is checked against the *accepted* rows of its parents, so a rejected row takes its children and
    theirs along, each with its own FOREIGN_KEY violation. With ``participation`` a sale none of whose line items is
    accepted is rejected too (SALE_WITHOUT_ITEMS), and then what points at it. Tables that are not given
    are not checked against. Each table is read once for each of its key rules and once for its rows: give stored
    tables or files. Returns the accepted rows by table, and all violations.
    """
    order, left = [], [n for n in SPECS if n in raws]
    while left:  # the references have no cycle
        ready = [n for n in left if not any(fk.parent in left for fk in SPECS[n].foreign_keys if fk.parent != n)]
        order += ready
        left = [n for n in left if n not in ready]
    done: dict[str, DataFrame] = {}
    broken: list[DataFrame] = []
    for n in order:
        # each table's verdicts are kept: its accepted rows are read by every child
        staged = kept(judged(raws[n], SPECS[n], done, write=False), f"judged-{n}")
        done[n], found = _split(staged, SPECS[n])
        broken.append(found)
    if participation and {"sale", "sale_line_item"} <= set(done):
        empty = _few(done["sale"].select("sale_id").join(done["sale_line_item"].select("sale_id").distinct(), "sale_id", "left_anti"))
        broken.append(empty.select(F.lit("sale").alias("table_name"), F.lit(SALE_WITHOUT_ITEMS).alias("rule"),
                                   key_text(["sale_id"]).alias("key"), F.lit("sale_line_item").alias("detail")))
        done["sale"] = done["sale"].join(empty, "sale_id", "left_anti")
        # line items of such a sale are rejected already; other children go with it
        for n in order:
            fks = [fk for fk in SPECS[n].foreign_keys if fk.parent == "sale"]
            if n != "sale_line_item" and fks:
                (c,) = fks[0].columns
                gone = done[n].join(empty.select(F.col("sale_id").alias(c)), c, "left_semi")
                broken.append(gone.select(F.lit(n).alias("table_name"), F.lit("FOREIGN_KEY").alias("rule"),
                                          key_text(SPECS[n].primary_key).alias("key"), F.lit(f"{c}->sale").alias("detail")))
                done[n] = done[n].join(empty.select(F.col("sale_id").alias(c)), c, "left_anti")
    violations = broken[0]
    for b in broken[1:]:
        violations = violations.unionByName(b)
    return done, violations


SALE_WITHOUT_ITEMS = "SALE_WITHOUT_ITEMS"


def _few(found: DataFrame) -> DataFrame:
    """``found``, computed once; sent whole to what it is joined with while it holds at most FEW_KEYS rows."""
    return bounded_broadcast(kept(found, "found"), FEW_KEYS)[0]


def _stored_keys(stored: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys of the stored rows within the batch's range of the first column."""
    low, high = batch.agg(F.min(columns[0]), F.max(columns[0])).first()
    c = F.col(columns[0])
    near = stored.filter(c.between(F.lit(low), F.lit(high))) if low is not None else stored.limit(0)
    return near.select(*columns).distinct()


def judged(raw: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None,
           stored: DataFrame | None = None, write: bool = True) -> DataFrame:
    """``raw`` as rows of the table, with the rules that each breaks in ``_issues``.

    The key rules read keys only, each in a pass of its own: ``raw`` is written for them, or (``write`` False) read again.
    """
    raw_d, text_issues = _from_text(raw, spec)
    raw_d = _with_defaults(raw_d, spec)
    # Type issues look at the raw value: set, but not castable to the type, or a
    # fraction for a whole-number column (refused from text and from numbers alike).
    type_issues = text_issues + [_issue(F.col(f.name).isNotNull()
                                        & (F.col(f.name).try_cast(f.dataType).isNull()
                                           | _loses_fraction(raw_d, f)),
                                        f"TYPE:{f.name}") for f in spec.schema.fields]
    staged = raw_d.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in spec.schema.fields],
        F.array_compact(F.array(*type_issues)).alias("_issues"))
    row_issues: list[Column] = []
    for c in spec.not_null:
        row_issues.append(_issue(F.col(c).isNull(), f"NOT_NULL:{c}"))
    for c, pred in spec.ranges.items():
        row_issues.append(_issue(~F.expr(pred), f"CHECK:{c}"))
    for c, allowed in spec.domains.items():
        row_issues.append(_issue(outside_domain(c, allowed), f"DOMAIN:{c}"))
    for c, n in spec.widths.items():
        row_issues.append(_issue(F.char_length(F.col(c)) > n, f"WIDTH:{c}"))
    for c in spec.unsigned:
        row_issues.append(_issue(F.col(c) < 0, f"UNSIGNED:{c}"))
    if row_issues:
        staged = staged.withColumn(
            "_issues", F.concat("_issues", F.array_compact(F.array(*row_issues))))

    # a label is stored as it is declared, however it was written
    for c, allowed in spec.domains.items():
        label = F.coalesce(*[F.when(collated(F.col(c)) == F.lit(a), F.lit(a)) for a in allowed], F.col(c))
        staged = staged.withColumn(c, label)

    # Key rules: duplicated primary key / unique values, missing parents.
    if write:
        staged = kept(staged, f"staged-{spec.name}")
    pk = list(spec.primary_key)
    dup_keys = _few(staged.groupBy(*pk).count().filter(F.col("count") > 1).select(
        *pk, F.lit("PRIMARY_KEY_DUPLICATE").alias("_k")))
    staged = (staged.join(dup_keys, pk, "left")
              .withColumn("_issues", F.when(F.col("_k").isNotNull(),
                                            F.concat("_issues", F.array("_k")))
                          .otherwise(F.col("_issues"))).drop("_k"))
    for c in pk:
        staged = staged.withColumn("_issues", F.when(
            F.col(c).isNull(), F.concat("_issues", F.array(F.lit(f"PRIMARY_KEY_NULL:{c}"))))
            .otherwise(F.col("_issues")))
    for c in spec.unique:
        dup = _few(staged.filter(F.col(c).isNotNull()).groupBy(unique_key(staged, c).alias("_k")).count()
                   .filter(F.col("count") > 1).select("_k", F.lit(f"UNIQUE:{c}").alias("_u")))
        staged = _marked(staged, dup, unique_key(staged, c) == F.col("_k"))
    if stored is not None:
        keys = _stored_keys(stored, staged, pk).select(
            *[F.col(c).alias(f"_s{i}") for i, c in enumerate(pk)], F.lit("PRIMARY_KEY_STORED").alias("_u"))
        same = F.lit(True)
        for i, c in enumerate(pk):
            same = same & (F.col(c) == F.col(f"_s{i}"))
        staged = _marked(staged, keys, same)
        for c in spec.unique:
            # distinct under the collation: a batch row is marked once
            have = (stored.filter(F.col(c).isNotNull()).select(unique_key(stored, c).alias("_k")).distinct()
                    .withColumn("_u", F.lit(f"UNIQUE_STORED:{c}")))
            staged = _marked(staged, have, unique_key(staged, c) == F.col("_k"))
    for fk in spec.foreign_keys:
        if not parents or fk.parent not in parents:
            continue
        alias = [f"_fk{i}" for i in range(len(fk.columns))]
        par = parents[fk.parent].select([F.col(p).alias(a) for p, a in zip(fk.parent_columns, alias)])
        keys = staged.select(*fk.columns).dropna()
        cond = [keys[c] == par[a] for c, a in zip(fk.columns, alias)]
        if par.count() <= FEW_KEYS:
            missing = keys.join(F.broadcast(par), cond, "left_anti").distinct()
        else:
            missing = keys.distinct().join(par, cond, "left_anti")
        label = f"FOREIGN_KEY:{','.join(fk.columns)}->{fk.parent}"
        missing = _few(missing.toDF(*alias).withColumn("_u", F.lit(label)))
        same = F.lit(True)
        for c, a in zip(fk.columns, alias):
            same = same & (F.col(c) == F.col(a))
        staged = _marked(staged, missing, same)

    return staged


def _marked(staged: DataFrame, found: DataFrame, same: Column) -> DataFrame:
    """``staged`` with the issue ``_u`` of the row of ``found`` that it meets, if any."""
    columns = staged.columns
    return (staged.join(found, same, "left")
            .withColumn("_issues", F.when(F.col("_u").isNotNull(), F.concat("_issues", F.array("_u")))
                        .otherwise(F.col("_issues"))).select(*columns))


def _split(staged: DataFrame, spec: TableSpec, atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and violations of judged rows."""
    pk = list(spec.primary_key)
    staged = staged.withColumn("_ok", F.size("_issues") == 0)
    violations = (staged.filter(~F.col("_ok"))
                  .select(F.lit(spec.name).alias("table_name"),
                          F.explode("_issues").alias("_i"),
                          key_text(pk).alias("key"))
                  .select("table_name",
                          F.split_part("_i", F.lit(":"), F.lit(1)).alias("rule"),
                          "key",
                          F.split_part("_i", F.lit(":"), F.lit(2)).alias("detail")))
    valid = staged.filter(F.col("_ok"))
    if atomic:
        # One statement: any breach refuses every row (an uncorrelated EXISTS
        # subquery, evaluated once, stops at the first violation).
        valid = valid.filter(~violations.exists())
    return conform(valid, spec), violations


def load_positional(raw: DataFrame, name: str | TableSpec,
                    parents: Mapping[str, DataFrame] | None = None,
                    atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Insert without a column list: columns are taken by position."""
    spec = SPECS[name] if isinstance(name, str) else name
    if len(raw.columns) != len(spec.columns):
        raise ValueError(f"{spec.name}: {len(raw.columns)} columns given, "
                         f"{len(spec.columns)} declared")
    return load_validated(raw.toDF(*spec.columns), spec, parents, atomic)


def load_file(spark, path: str, name: str | TableSpec, fmt: str = "csv",
              parents: Mapping[str, DataFrame] | None = None, atomic: bool = False,
              **options) -> tuple[DataFrame, DataFrame]:
    """Read a text source (CSV with a header line, or JSON lines) as text
    columns and load it through ``load_validated``.

    Every column is read as a string, so a malformed value becomes a
    ``TYPE`` violation of its row instead of failing the whole read; no
    schema inference pass runs over the data.
    """
    spec = SPECS[name] if isinstance(name, str) else name
    reader = spark.read.options(**options)
    if fmt == "csv":
        raw = reader.option("header", True).option("inferSchema", False).csv(path)
    elif fmt == "json":
        raw = reader.option("primitivesAsString", True).json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return load_validated(raw, spec, parents, atomic)
