"""Edit history: ordered deltas and their fold.

A fold of sparse deltas keeps each field's last value, so it is an aggregation
by key and field with ``max_by``; no key's log is gathered in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.hashing import numbered_by_key
from heliograph.sources.shared import written

#: The fields that the compatible fold reads.
COMPATIBLE_FIELDS = (
    "exposure", "contrast", "highlights", "shadows", "whites", "blacks", "temperature", "tint", "saturation", "vibrance",
    "clarity", "sharpness", "noiseReduction", "vignette", "grain", "rotation", "straighten", "dehaze",
)


def applied(log: DataFrame, key: str, order: list[str], cursor: Column) -> DataFrame:
    """The rows of each key's log before its cursor, the number of rows that count."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("__nth", nth).where(F.col("__nth") <= cursor).drop("__nth")


def field_rows(log: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """One row for each field that a delta (a map) sets."""
    return log.select(key, *order, F.explode(delta).alias("field", "value"))


def folded(log: DataFrame, key: str, order: list[str], delta: str, base: DataFrame | None = None) -> DataFrame:
    """``key``, ``field``, ``value``: the last value of each field; ``base`` rows (the same columns) hold where no delta sets a field."""
    last = field_rows(log, key, order, delta).groupBy(key, "field").agg(F.max_by("value", F.struct(*order)).alias("value"))
    if base is None:
        return last
    return last.unionByName(base.select(key, "field", "value").join(last, [key, "field"], "left_anti"))


def state_maps(fields: DataFrame, key: str) -> DataFrame:
    """The fields of each key as one map; a state has as many entries as there are fields."""
    return fields.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("state"))


def numeric_fields(state: Column, defaults: dict[str, float]) -> dict[str, Column]:
    """Fields as numbers; what is missing or no number keeps the default."""
    return {name: F.coalesce(F.try_element_at(state, F.lit(name)).try_cast("double"), F.lit(value)) for name, value in defaults.items()}


def undone(log: DataFrame, key: str, order: list[str], cursors: DataFrame, cursor_col: str = "cursor") -> DataFrame:
    """The log without what its cursor has undone; keys without a cursor keep all."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = log.withColumn("__nth", nth).join(cursors.select(key, cursor_col), key, "left")
    return rows.where(F.col(cursor_col).isNull() | (F.col("__nth") <= F.col(cursor_col))).drop("__nth", cursor_col)


def appended(log: DataFrame, rows: DataFrame, key: str, order: list[str], cursors: DataFrame, cursor_col: str = "cursor") -> DataFrame:
    """The log with new rows; what a key's cursor has undone is cut off first, if the key gets a row."""
    touched = rows.select(key).distinct()
    return undone(log, key, order, cursors.join(touched, key, "left_semi"), cursor_col).unionByName(rows)


def sparse_diff(old: Column, new: Column) -> Column:
    """The entries of the map ``new`` that ``old`` lacks or has otherwise."""
    return F.map_filter(new, lambda k, v: ~F.try_element_at(old, k).eqNullSafe(v))


def merged(old: Column, delta: Column) -> Column:
    """``old`` with the entries of ``delta`` put over it; nulls count as empty."""
    empty = F.map_filter(F.coalesce(old, delta), lambda k, v: F.lit(False))
    first, second = F.coalesce(old, empty), F.coalesce(delta, empty)
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def active_versions(versions: DataFrame, key: str, version: str, created: str, active: str) -> DataFrame:
    """For each key the first active version, else the last one."""
    return versions.groupBy(key).agg(
        F.coalesce(
            F.min_by(version, F.when(F.col(active), F.struct(created, version))),
            F.max_by(version, F.struct(created, version)),
        ).alias(version)
    )


def activated(versions: DataFrame, key: str, version: str, active: str, chosen: DataFrame) -> DataFrame:
    """The versions with one active for each key in ``chosen`` (``key``, ``version``); other keys stay."""
    picked = chosen.select(key, F.col(version).alias("__chosen"))
    rows = versions.join(picked, key, "left")
    return rows.withColumn(active, F.when(F.col("__chosen").isNull(), F.col(active)).otherwise(F.col(version) == F.col("__chosen"))).drop("__chosen")


def removed_version(versions: DataFrame, key: str, version: str, created: str, active: str, gone: object, protected: str = "default") -> DataFrame:
    """The versions without one, unless it is protected; if it was active its key's first version becomes active."""
    hit = (F.col(version) == F.lit(gone)) & (F.col("name") != protected) if "name" in versions.columns else F.col(version) == F.lit(gone)
    left = versions.where(~F.coalesce(hit, F.lit(False)))
    per_key = Window.partitionBy(key)
    first = F.row_number().over(per_key.orderBy(created, version)) == 1
    none_active = F.max(F.col(active).cast("int")).over(per_key) == 0
    return left.withColumn("__first", first).withColumn("__none", none_active).withColumn(active, F.col(active) | (F.col("__first") & F.col("__none"))).drop("__first", "__none")


def batch_applied(targets: DataFrame, active: DataFrame, key: str, version: str, delta: Column, label: str) -> DataFrame:
    """Log rows of one delta for the active version of each target; targets without one are left out."""
    return targets.select(key).distinct().join(active.select(key, version), key).select(key, version, delta.alias("delta"), F.lit(label).alias("label"))


def cloned(log: DataFrame, ids: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """The log's rows under new ids (``old_id``, ``new_id``), parents among them."""
    own = ids.select(F.col("old_id").alias(id_col), F.col("new_id").alias("__own"))
    above = ids.select(F.col("old_id").alias(parent_col), F.col("new_id").alias("__above"))
    rows = log.join(own, id_col).join(above, parent_col, "left")
    return rows.withColumn(id_col, F.col("__own")).withColumn(parent_col, F.coalesce("__above", parent_col)).select(*log.columns)


def ancestors(spark, versions: str, leaf: object) -> DataFrame:
    """The chain from a version of the view ``versions`` (``id``, ``parent_id``) up to its root, the version at step 0.

    Steps double: each round the jumps of all versions are joined with themselves, to
    jumps twice as long, and those of the chain so far lead to as many versions again.
    A chain of n versions takes log2(n) joins, whatever its length; a loop is an error.
    """
    rows = spark.table(versions).select("id", "parent_id")
    known = written(rows, "versions")
    jumps = known.where("id is not null and parent_id is not null").select("id", F.col("parent_id").alias("to"))
    chain = written(known.where(F.col("id") == F.lit(leaf)).select("id").distinct().select("id", F.lit(0).alias("step")), "ancestors")
    long, most = 1, known.count()
    while True:
        # the chain is small beside the versions; Spark sends it to them where it is
        longer = chain.join(jumps, "id").select(F.col("to").alias("id"), (F.col("step") + long).alias("step"))
        longer = written(longer.join(known.select("id").distinct(), "id", "left_semi"), "ancestors")
        if longer.isEmpty():
            return known.select("id").join(chain, "id").select("id", "step")
        if long > most:
            raise ValueError("a version is its own ancestor")
        chain = chain.unionByName(longer)
        jumps = written(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("__to")), "to").select("id", F.col("__to").alias("to")), "versions")
        long *= 2


def created_versions(versions: DataFrame, requests: DataFrame, key: str, version: str, name: str, active: str) -> DataFrame:
    """``versions`` with one new version for each request (``key``, ``version``, ``name``), which becomes its key's active one.

    A blank name becomes ``Version n``, n being how many versions the key had.  An
    id that the key has already is an error when the result is computed.
    """
    had = versions.groupBy(key).agg(F.count("*").alias("__n"), F.collect_set(version).alias("__ids"))  # a key has few versions
    asked = requests.select(key, version, name).join(had, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    taken = F.coalesce(F.array_contains("__ids", F.col(version)), F.lit(False))
    named = F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.concat(F.lit("Version "), F.col("__n").cast("string"))).otherwise(F.col(name))
    new = asked.where(F.when(taken, F.raise_error("version already exists").cast("boolean")).otherwise(True)).select(key, version, named.alias(name), F.lit(True).alias(active))
    return activated(versions.unionByName(new, allowMissingColumns=True), key, version, active, new.select(key, version))


def renamed_version(versions: DataFrame, version: str, which: object, name: str, new_name: str) -> DataFrame:
    return versions.withColumn(name, F.when(F.col(version) == F.lit(which), F.lit(new_name)).otherwise(F.col(name)))


def stage_params(text: Column) -> Column:
    """The operators of a stage's JSON as a map from type to parameters (JSON text); of one type the last counts; null for text that is no such JSON."""
    raw = F.from_json(text, "operators array<struct<type:int,params:string>>")["operators"]
    known = F.filter(raw, lambda o: o["type"].isNotNull())
    return F.map_from_entries(F.transform(known, lambda o: F.struct(o["type"].alias("key"), o["params"].alias("value"))))


def merged_stage(text: Column, changes: Column) -> Column:
    """The JSON of a stage with the operators of another put over its own, in order of type."""
    both = merged(stage_params(text), stage_params(changes))
    rows = F.transform(F.array_sort(F.map_entries(both)), lambda e: F.struct(e["key"].alias("type"), e["value"].alias("params")))
    return F.to_json(F.struct(rows.alias("operators")))


#: Kinds of rows in a log of actions; any other is an edit.  A ``mark`` is a row that only says that something was undone or redone.
UNDO, REDO, MARK = "undo", "redo", "mark"

#: The fields that batch changes set, and their defaults.
BATCH_DEFAULTS = {
    "exposure": 0.0, "contrast": 0.0, "highlights": 0.0, "shadows": 0.0, "whites": 0.0, "blacks": 0.0, "temperature": 0.0, "tint": 0.0, "saturation": 0.0, "vibrance": 0.0,
    "clarity": 0.0, "sharpen": 0.0, "rotation": 0.0, "perspectiveH": 0.0, "perspectiveV": 0.0, "filmGrainAmount": 0.0, "halationAmount": 0.0, "lutIntensity": 1.0,
}


def undo_cursors(placed: DataFrame, key: str, kind: str) -> DataFrame:
    """``key``, ``rows`` (how many rows there are to replay) and ``cursor`` (how many of them, from the last back, are undone).

    ``placed`` is a log with ``place``, from 0 in order (:func:`numbered_by_key`).  An
    edit makes every row count again; after the last one each undo takes one row
    more, each redo one less, never below none nor beyond all.  That walk between two
    walls is worked out from sums: with the sum so far ``f`` (0 at first) and ``n``
    rows, it ends at ``f(end) - max(min(0, min f), max over s of min(f(s) - n, min of f from s on))``.
    """
    k, moves = F.col(kind), F.col(kind).isin(UNDO, REDO)
    edits = placed.groupBy(key).agg(F.count_if(~moves | k.isNull()).alias("rows"), F.max(F.when(k.isNull() | ~k.isin(UNDO, REDO, MARK), F.col("place"))).alias("__edit"))
    tail = placed.where(moves).join(edits, key).where(F.col("place") > F.coalesce("__edit", F.lit(-1)))
    by_place = Window.partitionBy(key).orderBy("place")
    tail = tail.withColumn("__f", F.sum(F.when(k == UNDO, 1).otherwise(-1)).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tail = tail.withColumn("__from", F.min("__f").over(by_place.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ends = tail.groupBy(key).agg(F.max_by("__f", "place").alias("__end"), F.least(F.lit(0), F.min("__f")).alias("__least"), F.max(F.least(F.col("__f") - F.col("rows"), F.col("__from"))).alias("__most"), F.max("rows").alias("__n"))
    cursor = F.col("__end") - F.greatest("__least", "__most", F.least(-F.col("__n"), F.col("__least")))
    return edits.select(key, "rows").join(ends.select(key, cursor.alias("cursor")), key, "left").withColumn("cursor", F.coalesce("cursor", F.lit(0)).cast("long"))


def replayed(log: DataFrame, key: str, order: list[str], kind: str, delta: str) -> DataFrame:
    """``key``, ``field``, ``value`` after all undos and redos of a log of actions.

    Undos and redos are no rows to replay; marks are among them but change nothing.
    Keys whose rows are all undone have no fields, so the defaults hold.
    """
    placed = numbered_by_key(log.select(key, *(c for c in dict.fromkeys(order) if c != key), kind, delta), key, order)
    cursors = undo_cursors(placed, key, kind)
    # places among the rows to replay: those of all rows less the undos and redos before them
    moves = F.col(kind).isin(UNDO, REDO)
    real = numbered_by_key(placed.where(moves.isNull() | ~moves).drop("place"), key, order)
    alive = real.join(cursors, key).where(F.col("place") < F.col("rows") - F.col("cursor")).where(F.col(kind).isNull() | (F.col(kind) != MARK))
    return folded(alive, key, order, delta)


def overrides(values: Column) -> Column:
    """All fields of :data:`BATCH_DEFAULTS` as a delta: the value of the map ``values`` as a number, else the default, as text."""
    value = lambda name, default: F.coalesce(F.try_element_at(values, F.lit(name)).try_cast("double"), F.lit(default)).cast("string")
    return F.create_map(*(x for name, default in BATCH_DEFAULTS.items() for x in (F.lit(name), value(name, default))))


def batch_preset(targets: DataFrame, active: DataFrame, key: str, version: str, preset: dict[str, float], label: str) -> DataFrame:
    """Log rows that give the active version of each target all fields of a preset; fields that it lacks get the default."""
    values = F.create_map(*(F.lit(x) for name, v in preset.items() for x in (name, str(v)))) if preset else F.create_map().cast("map<string,string>")
    return batch_applied(targets, active, key, version, overrides(values), label)


def batch_reset(targets: DataFrame, active: DataFrame, key: str, version: str) -> DataFrame:
    """Log rows that set all fields of each target's active version to the defaults."""
    return batch_preset(targets, active, key, version, {}, "Reset")


def batch_copied(targets: DataFrame, active: DataFrame, states: DataFrame, key: str, version: str, state: str, copies: DataFrame, source: str) -> DataFrame:
    """Log rows that give each target's active version all fields of another key's active version.

    ``copies``: ``key`` (the target) and ``source``, at most one for a target;
    ``states``: the map of fields of each version.  A source without an active
    version copies nothing; one without a state copies the defaults.
    """
    first = active.select(key, version).join(states.select(F.col(version), F.col(state).alias("__state")), version, "left").select(F.col(key).alias(source), "__state")
    asked = copies.join(targets.select(key).distinct(), key, "left_semi").join(first, source)
    rows = asked.join(active.select(key, version), key)
    return rows.select(key, version, overrides(F.coalesce("__state", F.create_map().cast("map<string,string>"))).alias("delta"), F.concat(F.lit("Copy from "), F.col(source).cast("string")).alias("label"))
