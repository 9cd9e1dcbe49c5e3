"""Receipt guards and referential actions as set-based change operators.

Each operator takes the current table(s) plus a DataFrame of requested
changes and returns the new table version(s) and a decision/reject frame.
All are aggregations and semi/anti-joins on keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeline.schemas import SPECS, ForeignKey
from storeline.session import ensure_checkpoint_dir

ACCEPTED = "ACCEPTED"
LAST_ITEM = "LAST_ITEM"
LAST_ITEM_ZERO = "LAST_ITEM_ZERO"
CHECK_QUANTITY = "CHECK_QUANTITY"
NO_SUCH_ROW = "NO_SUCH_ROW"
NOT_NULL = "NOT_NULL"
RESTRICTED = "RESTRICTED"
DUPLICATE_KEY = "DUPLICATE_KEY"
ROLLED_BACK = "ROLLED_BACK"
CONFLICTING_UPDATE = "CONFLICTING_UPDATE"

ITEM_KEY = ["sale_id", "product_upc"]


def _names(col: str):
    """All distinct labels of a group, sorted, comma-joined (hash aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def _all_or_nothing(decisions: DataFrame) -> DataFrame:
    """One statement: if any request is refused, every accepted one is too.

    The test is an uncorrelated ``EXISTS`` subquery (stops at the first
    refusal, evaluated once), so no join is formed.
    """
    refused = decisions.filter(F.col("decision") != ACCEPTED).exists()
    return decisions.withColumn(
        "decision", F.when(refused & (F.col("decision") == ACCEPTED), F.lit(ROLLED_BACK))
        .otherwise(F.col("decision")))


# C2 ----------------------------------------------------------------------

def guard_delete_items(items: DataFrame, deletes: DataFrame, atomic: bool = False
                       ) -> tuple[DataFrame, DataFrame]:
    """Delete line items; a receipt may never lose its last item.

    A receipt whose every item is requested for deletion would become empty:
    all deletes of that receipt are refused (``LAST_ITEM``). Deletes of rows
    that do not exist are reported ``NO_SUCH_ROW``. ``atomic=True`` refuses
    the whole batch when any receipt would become empty.
    Returns ``(kept_items, decisions)``.
    """
    req = deletes.select(*ITEM_KEY).distinct()
    hit = req.join(items.select(*ITEM_KEY), ITEM_KEY, "left_semi")
    n_del = hit.groupBy("sale_id").agg(F.count(F.lit(1)).alias("n_del"))
    n_have = (items.select("sale_id").join(n_del.select("sale_id"), "sale_id", "left_semi")
              .groupBy("sale_id").agg(F.count(F.lit(1)).alias("n_have")))
    emptied = (n_del.join(n_have, "sale_id")
               .filter(F.col("n_del") >= F.col("n_have")).select("sale_id"))
    decisions = (req.join(hit.withColumn("_hit", F.lit(True)), ITEM_KEY, "left")
                 .join(emptied.withColumn("_empty", F.lit(True)), "sale_id", "left")
                 .select(*ITEM_KEY, F.when(F.col("_hit").isNull(), F.lit(NO_SUCH_ROW))
                         .when(F.col("_empty"), F.lit(LAST_ITEM))
                         .otherwise(F.lit(ACCEPTED)).alias("decision")))
    if atomic:
        decisions = _all_or_nothing(decisions)
    gone = decisions.filter(F.col("decision") == ACCEPTED).select(*ITEM_KEY)
    return items.join(gone, ITEM_KEY, "left_anti"), decisions


# C3 ----------------------------------------------------------------------

def guard_update_items(items: DataFrame, updates: DataFrame, atomic: bool = False
                       ) -> tuple[DataFrame, DataFrame]:
    """Set new quantities on line items.

    A quantity <= 0 on a receipt's only item is refused by the last-item rule
    (``LAST_ITEM_ZERO``); on a receipt with more items it is refused by the
    quantity CHECK (``CHECK_QUANTITY``). A NULL one is refused by ``NOT_NULL``. Positive updates are
    accepted; they do not touch stock. Two different new quantities for one
    line item are both refused (``CONFLICTING_UPDATE``). ``updates``: ``sale_id, product_upc,
    new_quantity``. Returns ``(new_items, decisions)``.
    """
    # Identical repeats of a request collapse; different new quantities for
    # the same line item have no order to decide between them: all refused.
    # One shuffle by item serves the repeats, the conflicts and the join with the items.
    upd = (updates.select(*ITEM_KEY, "new_quantity").repartition(*ITEM_KEY).distinct()
           .withColumn("_conflict", F.count(F.lit(1)).over(Window.partitionBy(*ITEM_KEY)) > 1))
    n_have = (items.select("sale_id").join(upd.select("sale_id"), "sale_id", "left_semi")
              .groupBy("sale_id").agg(F.count(F.lit(1)).alias("n_have")))
    q = F.col("new_quantity")
    bad = q <= 0
    decisions = (upd.join(items.select(*ITEM_KEY).withColumn("_hit", F.lit(True)),
                          ITEM_KEY, "left")
                 .join(n_have, "sale_id", "left")
                 .select(*ITEM_KEY, "new_quantity",
                         F.when(F.col("_hit").isNull(), F.lit(NO_SUCH_ROW))
                         .when(F.col("_conflict"), F.lit(CONFLICTING_UPDATE))
                         .when(q.isNull(), F.lit(NOT_NULL))
                         .when(bad & (F.col("n_have") == 1), F.lit(LAST_ITEM_ZERO))
                         .when(bad, F.lit(CHECK_QUANTITY))
                         .otherwise(F.lit(ACCEPTED)).alias("decision")))
    if atomic:
        decisions = _all_or_nothing(decisions)
    accepted = decisions.filter(F.col("decision") == ACCEPTED).select(*ITEM_KEY, "new_quantity")
    new_items = (items.join(accepted, ITEM_KEY, "left")
                 .withColumn("quantity", F.coalesce("new_quantity", "quantity").cast("int"))
                 .select(*items.columns))
    return new_items, decisions


# C2 and C3, row by row ----------------------------------------------------

def replay_item_changes(items: DataFrame, changes: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Apply a log of single-row deletes and updates one by one.

    ``changes``: ``sale_id, product_upc, new_quantity, delete`` (boolean) and
    the columns ``order_by``; rows that these do not tell apart are taken in the order of the log.
    Each change sees the receipt as the accepted ones before it left it, so the deletes of a whole receipt
    remove all but its last item. Decisions: ``ACCEPTED``; ``NO_SUCH_ROW``, also for an item
    deleted before; ``LAST_ITEM`` for a delete on a receipt of one; ``LAST_ITEM_ZERO`` for a
    quantity <= 0 on a receipt of one; else ``CHECK_QUANTITY`` and ``NOT_NULL`` for such a quantity.
    Returns ``(new_items, decisions)``; decisions carry all columns of ``changes``.

    A receipt of n items loses the first n - 1 of its products for which a delete arrives, each at its
    first delete; the n-th stays for good. So no receipt's log is walked: the first delete of each
    (receipt, product) is an aggregate, its place among the receipt's products a row number, and a receipt has one item
    left from the (n - 1)-th of them on.
    """
    ensure_checkpoint_dir(items.sparkSession)
    log = changes.withColumn("_line", F.monotonically_increasing_id()).checkpoint(eager=True)
    at = F.struct(*order_by, "_line")
    log = log.withColumn("_at", at)
    firsts = (log.filter("delete").groupBy(*ITEM_KEY).agg(F.min("_at").alias("_first"))
              .join(items.select(*ITEM_KEY), ITEM_KEY, "left_semi"))
    place = F.row_number().over(Window.partitionBy("sale_id").orderBy("_first"))
    touched = log.select("sale_id").distinct()
    sizes = (items.join(touched, "sale_id", "left_semi").groupBy("sale_id").agg(F.count(F.lit(1)).alias("_n")))
    firsts = firsts.withColumn("_place", place).join(sizes, "sale_id")
    gone = firsts.filter(F.col("_place") < F.col("_n")).select(*ITEM_KEY, F.col("_first").alias("_gone"))
    # when a receipt comes down to one item; those of one item are there from the start
    single = sizes.join(firsts.filter(F.col("_place") == F.col("_n") - 1).select("sale_id", F.col("_first").alias("_single")),
                        "sale_id", "left")
    seen = (log.join(items.select(*ITEM_KEY).withColumn("_hit", F.lit(True)), ITEM_KEY, "left")
            .join(gone, ITEM_KEY, "left").join(single, "sale_id", "left"))
    q = F.col("new_quantity")
    alone = (F.col("_n") == 1) | F.coalesce(F.col("_at") > F.col("_single"), F.lit(False))
    decision = (F.when(F.col("_hit").isNull() | F.coalesce(F.col("_at") > F.col("_gone"), F.lit(False)), F.lit(NO_SUCH_ROW))
                .when(F.col("delete"), F.when(alone, F.lit(LAST_ITEM)).otherwise(F.lit(ACCEPTED)))
                .when(q.isNull(), F.lit(NOT_NULL))
                .when((q <= 0) & alone, F.lit(LAST_ITEM_ZERO)).when(q <= 0, F.lit(CHECK_QUANTITY))
                .otherwise(F.lit(ACCEPTED)))
    decided = seen.withColumn("decision", decision)
    last = (decided.filter(~F.col("delete") & (F.col("decision") == ACCEPTED))
            .groupBy(*ITEM_KEY).agg(F.max_by("new_quantity", "_at").alias("_set")))
    new_items = (items.join(gone.select(*ITEM_KEY), ITEM_KEY, "left_anti").join(last, ITEM_KEY, "left")
                 .withColumn("quantity", F.coalesce("_set", "quantity").cast("int")).select(*items.columns))
    return new_items, decided.select(*changes.columns, "decision")


# C4 / C5 -----------------------------------------------------------------

def _children(parent: str) -> list[tuple[str, ForeignKey]]:
    return [(name, fk) for name, spec in SPECS.items() for fk in spec.foreign_keys
            if fk.parent == parent]


def _key_cols(table: str) -> list[str]:
    return list(SPECS[table].primary_key)


def _refs(child: DataFrame, fk: ForeignKey, keys: DataFrame) -> DataFrame:
    """Child rows whose FK points at one of ``keys`` (columns = parent cols)."""
    k = keys.select([F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns)])
    return child.join(k, list(fk.columns), "left_semi")


def restrict_delete(tables: Mapping[str, DataFrame], table: str, keys: DataFrame,
                    atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split requested parent keys into allowed and blocked deletes.

    A key is blocked when a RESTRICT child references it, directly or through
    rows that a CASCADE would remove. ``atomic=True`` allows no key when any is
    blocked, as one statement does. Returns ``(allowed, blocked)``;
    ``blocked`` carries ``blocked_by`` (the child table).
    """
    pk = _key_cols(table)
    keys = keys.select(*pk).distinct()
    marked, names = keys.withColumn("_by", F.lit("")), set()
    for child, fk in _children(table):
        if child not in tables or (fk.on_delete == "CASCADE" and not any(c in tables for c, _ in _children(child))):
            continue
        if fk.on_delete == "CASCADE":
            # rows removed by the cascade must themselves be deletable
            refs = _refs(tables[child], fk, keys)
            _, sub_blocked = restrict_delete(tables, child, refs)
            refs = refs.join(sub_blocked.select(*_key_cols(child)), _key_cols(child), "left_semi")
        else:
            refs = tables[child]
        names.add(child)
        marked = marked.unionByName(refs.dropna(subset=list(fk.columns)).select(
            [F.col(c).alias(p) for c, p in zip(fk.columns, fk.parent_columns)]).distinct().withColumn("_by", F.lit(child)))
    if not names:
        return keys, keys.limit(0).withColumn("blocked_by", F.lit(None).cast("string"))
    # requested and referenced keys meet in one hash aggregate of fixed-width flags: a task sorts and joins nothing
    by = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in sorted(names)]))
    met = (marked.groupBy(*pk).agg(F.max(F.col("_by") == "").alias("_asked"), *[F.max(F.col("_by") == n).alias(f"_{n}") for n in names])
           .filter("_asked").select(*pk, F.array_join(by, ",").alias("blocked_by")))
    allowed, blocked = met.filter("blocked_by = ''").select(*pk), met.filter("blocked_by <> ''")
    if atomic:
        allowed = allowed.filter(~blocked.exists())
    return allowed, blocked


def cascade_delete(tables: Mapping[str, DataFrame], table: str, keys: DataFrame,
                   atomic: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete parent rows with their CASCADE children (RESTRICT is checked).

    Returns ``(new_tables, blocked)``: the changed tables only, and the keys
    refused because a RESTRICT child still references them. Cascaded rows are
    removed without firing row guards (cascaded deletes fire no trigger).
    ``atomic=True`` removes nothing when any key is refused.
    """
    allowed, blocked = restrict_delete(tables, table, keys, atomic)
    out: dict[str, DataFrame] = {}

    def remove(name: str, dead: DataFrame) -> None:
        pk = _key_cols(name)
        for child, fk in _children(name):
            if fk.on_delete == "CASCADE" and child in tables:
                remove(child, _refs(out.get(child, tables[child]), fk, dead)
                       .select(*_key_cols(child)))
        base = out.get(name, tables[name])
        out[name] = base.join(dead.select(*pk), pk, "left_anti")

    remove(table, allowed)
    return out, blocked


# C6 ----------------------------------------------------------------------

def cascade_update(tables: Mapping[str, DataFrame], table: str, mapping: DataFrame,
                   atomic: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Change primary keys of ``table``: ``old_id -> new_id``, or for a key of several columns
    ``old_<column>... -> new_<column>...``.

    ON UPDATE CASCADE children get the new value; a RESTRICT child (or no
    action clause) referencing the old key blocks the change, as does a new
    key that already exists or that two old keys are to get (``DUPLICATE_KEY``),
    a NULL in the new key (``NOT_NULL``), an old key that no row has
    (``NO_SUCH_ROW``), one old key with several new ones
    (``CONFLICTING_UPDATE``), and a key column that refers to a given table where the new
    value has no row (``FOREIGN_KEY:<table>``). A key mapped to itself is no change.
    ``atomic=True`` changes nothing when anything is blocked. Returns
    ``(new_tables, blocked)``; ``blocked`` has the columns of the mapping and ``reason``.
    """
    pk = _key_cols(table)
    parent = tables[table]
    types = dict(parent.dtypes)
    given = ([("old_id", "new_id")] if len(pk) == 1 else [(f"old_{c}", f"new_{c}") for c in pk])

    def key(*columns: Column) -> Column:
        return F.struct(*[v.cast(types[c]).alias(c) for v, c in zip(columns, pk)])

    m = (mapping.select(key(*[F.col(o) for o, _ in given]).alias("old"), key(*[F.col(n) for _, n in given]).alias("new"))
         .distinct().filter(~F.col("old").eqNullSafe(F.col("new"))))
    here = key(*[F.col(c) for c in pk])

    def several(side: str, reason: str) -> DataFrame:
        many = m.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return because(m.join(many, side, "left_semi"), reason)

    def because(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select("old", "new", F.lit(reason).alias("reason"))

    no_key = F.exists(F.array(*[F.col(f"new.{c}").isNull() for c in pk]), lambda x: x)
    blocked = (because(m.join(parent.select(here.alias("new")), "new", "left_semi"), DUPLICATE_KEY)
               .unionByName(several("new", DUPLICATE_KEY))
               .unionByName(several("old", CONFLICTING_UPDATE))
               .unionByName(because(m.filter(no_key), NOT_NULL))
               .unionByName(because(m.join(parent.select(here.alias("old")), "old", "left_anti"), NO_SUCH_ROW)))
    for child, fk in _children(table):
        if child in tables and fk.on_update != "CASCADE":
            at = dict(zip(fk.parent_columns, fk.columns))
            used = tables[child].select(key(*[F.col(at[c]) for c in pk]).alias("old"))
            blocked = blocked.unionByName(because(m.join(used, "old", "left_semi"), f"{RESTRICTED}:{child}"))
    for fk in SPECS[table].foreign_keys:
        if fk.parent in tables and set(fk.columns) <= set(pk):
            known = tables[fk.parent].select(*[F.col(p).alias(f"_{p}") for p in fk.parent_columns])
            found = [F.col(f"new.{c}") == F.col(f"_{p}") for c, p in zip(fk.columns, fk.parent_columns)]
            blocked = blocked.unionByName(because(m.filter(~no_key).join(known, found, "left_anti"), f"FOREIGN_KEY:{fk.parent}"))
    blocked = blocked.groupBy("old", "new").agg(_names("reason").alias("reason"))
    ok = m.join(blocked.select("old"), "old", "left_anti")
    if atomic:
        ok = ok.filter(~blocked.exists())

    def remap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``df`` with the key in ``columns`` (in the order of the primary key) changed."""
        own = dict(df.dtypes)
        moved = df.join(ok, key(*[F.col(c) for c in columns]) == F.col("old"), "left")
        return moved.select(*[
            F.when(F.col("new").isNotNull(), F.col(f"new.{pk[columns.index(c)]}")).otherwise(F.col(c)).cast(own[c]).alias(c)
            if c in columns else F.col(c) for c in df.columns])

    out = {table: remap(parent, pk)}
    for child, fk in _children(table):
        if child in tables and fk.on_update == "CASCADE":
            at = dict(zip(fk.parent_columns, fk.columns))
            # a child with several cascading keys takes every remap in turn
            out[child] = remap(out.get(child, tables[child]), [at[c] for c in pk])
    return out, blocked.select(*[F.col(f"old.{c}").alias(o) for c, (o, _) in zip(pk, given)],
                               *[F.col(f"new.{c}").alias(n) for c, (_, n) in zip(pk, given)], "reason")
