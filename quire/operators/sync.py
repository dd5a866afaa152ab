"""Changes between two refreshes: keyed row diff, fingerprints, change reports, sync states, minimal refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.shape import content_hash, known, row_hash

# The states of a binding.
LINKED, PINNED, OVERRIDDEN, STALE, ERROR = "linked", "pinned", "overridden", "stale", "error"


def row_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``key columns, change_type``: inserted, updated, removed or unchanged. Keys and values compare null-safely and by type.

    With repeated keys the old side counts once, with the row that is largest over all columns; each new row counts.
    Without a key a row is its own key: inserted and unchanged count new rows, removed the distinct old ones.
    """
    if old.schema.simpleString() != new.schema.simpleString():
        raise ValueError("old and new differ in schema")
    if not key:
        return _whole_row_diff(old, new)
    rest = [c for c in new.columns if c not in known(new, key)]
    # The key as one struct compares null-safely, and grouping the old side and joining share its partitioning.
    whole = F.struct(*rest) if rest else F.lit(1)
    o = old.select(F.struct(*key).alias("__key"), whole.alias("__old")).groupBy("__key").agg(F.max("__old").alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(F.struct(*key).alias("__key"), whole.alias("__new"), F.lit(True).alias("__in_new"))
    both = o.join(n, "__key", "full_outer")
    change = F.when(F.col("__in_old").isNull(), "inserted").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    return both.select(*(F.col("__key")[k].alias(k) for k in key), change.alias("change_type"))


def _whole_row_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One aggregate over both sides: rows are grouped null-safely, and counts combine before the shuffle."""
    columns = new.columns
    both = new.select(*columns, F.lit(1).alias("__new")).unionByName(old.select(*columns, F.lit(0).alias("__new")))
    each = both.groupBy(*columns).agg(F.sum("__new").alias("__n"), F.min("__new").alias("__old"))
    change = F.when(F.col("__n") == 0, "removed").when(F.col("__old") == 0, "unchanged").otherwise("inserted")
    return each.withColumn("change_type", F.explode(F.array_repeat(change, F.greatest(F.lit(1), F.col("__n")).cast("int")))).select(*columns, "change_type")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count("*").alias("n"))


def fingerprint(resolved: DataFrame, binding_id: str) -> DataFrame:
    """``binding_id, fingerprint`` of a resolved frame: a hash of its content, never its text."""
    h = content_hash(resolved)
    return h.select(F.lit(binding_id).alias("binding_id"), F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "h1", "h2", "schema_hash"), 256).alias("fingerprint"))


def keyed_fingerprints(resolved: DataFrame, binding: str = "binding_id") -> DataFrame:
    """Fingerprints of all bindings of one long frame, in one aggregate."""
    rest = [c for c in resolved.columns if c != binding]
    sums = [F.sum(row_hash(rest, s).cast("decimal(38,0)")).cast("string") for s in (1, 2)]
    parts = F.concat_ws("|", F.count("*").cast("string"), *sums)
    return resolved.groupBy(binding).agg(F.sha2(parts, 256).alias("fingerprint"))


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``binding_id, change`` (changed, unchanged, added, removed) from two frames ``binding_id, fingerprint``."""
    b, a = before.select(F.col("binding_id").alias("b_id"), F.col("fingerprint").alias("b_fp")), after.select("binding_id", "fingerprint")
    both = b.join(a, F.col("b_id") == F.col("binding_id"), "full_outer")
    change = F.when(F.col("b_id").isNull(), "added").when(F.col("binding_id").isNull(), "removed").when(F.col("b_fp").eqNullSafe(F.col("fingerprint")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("binding_id", "b_id").alias("binding_id"), change.alias("change"))


def invalidated(bindings: DataFrame, changed_queries: DataFrame) -> DataFrame:
    """Bindings (``binding_id, query_id``) that read a changed query; all others are left alone."""
    return bindings.join(changed_queries.select("query_id").distinct(), "query_id", "left_semi")


def transition(state: DataFrame, changed_queries: DataFrame, actions: DataFrame | None = None, stamps: DataFrame | None = None) -> DataFrame:
    """The next state table (``binding_id, query_id, status``). New data makes bindings stale unless they are pinned or
    overridden; then user actions (``binding_id, action``: pin, override, relink, resolve) apply, at most one each.

    With ``stamps`` (``query_id, stamp``: the revision that each query's source has now) the state also has ``last_resolved``:
    bindings that a resolve links take the stamp, all others keep theirs, null if ``state`` has none."""
    touched = changed_queries.select("query_id").distinct().withColumn("__hit", F.lit(True))
    s = state.join(touched, "query_id", "left")
    status = F.when(F.col("__hit") & ~F.col("status").isin(PINNED, OVERRIDDEN), STALE).otherwise(F.col("status"))
    s = s.withColumn("status", status).drop("__hit")
    kept = ["binding_id", "query_id", "status"]
    if stamps is not None:
        kept.append("last_resolved")
        s = s.join(stamps.select("query_id", F.col("stamp").alias("__stamp")), "query_id", "left")
        if "last_resolved" not in state.columns:
            s = s.withColumn("last_resolved", F.lit(None).cast(stamps.schema["stamp"].dataType))
    if actions is not None:
        s = s.join(actions.select("binding_id", "action"), "binding_id", "left")
        done = F.when(F.col("action") == "pin", PINNED).when(F.col("action") == "override", OVERRIDDEN).when(F.col("action") == "relink", STALE)
        done = done.when((F.col("action") == "resolve") & ~F.col("status").isin(PINNED, OVERRIDDEN), LINKED).otherwise(F.col("status"))
        if stamps is not None:
            links = (F.col("action") == "resolve") & ~F.col("status").isin(PINNED, OVERRIDDEN)
            s = s.withColumn("last_resolved", F.when(links, F.col("__stamp")).otherwise(F.col("last_resolved")))
        s = s.withColumn("status", done).drop("action")
    return s.select(*kept)


def sync_report(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") != LINKED).select("binding_id", "status").orderBy("binding_id")


def minimal_refresh(current: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fields (``key, value``) to write: those resolved whose value differs from the current one; fields that only the
    current frame knows are untouched."""
    c = current.select(F.col("key").alias("c_key"), F.col("value").alias("c_value"))
    both = resolved.join(c, resolved.key == F.col("c_key"), "left")
    return both.where(F.col("c_key").isNull() | ~F.col("value").eqNullSafe(F.col("c_value"))).select("key", "value")
