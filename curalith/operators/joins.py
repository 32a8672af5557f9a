"""Keyed joins of two projections, with prefixes and provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.operators.matching import match
from curalith.operators.project import JOIN, column, prefix_side

PRIMARY, SECONDARY = "primary_", "secondary_"
JOIN_TYPES = ("inner", "left_outer", "full_outer", "full_outer_compat")
#: A key of which :func:`join_many` makes more rows is cut into cells of about as many.
CELL_ROWS = 100_000


def provenance(
    join_type: str,
    key: str | None,
    key_value: Column | None,
    matched: Column | None,
    sources: Sequence[str] | Column,
) -> Column:
    """The ``__join__`` struct: ``matched`` is false on unmatched rows and null elsewhere."""
    null = F.lit(None)
    return F.struct(
        F.lit(join_type).alias("type"),
        F.lit(key).cast("string").alias("key"),
        (null if key_value is None else key_value).cast("string").alias("key_value"),
        (null if matched is None else matched).cast("boolean").alias("matched"),
        (sources if isinstance(sources, Column) else F.array(*[F.lit(s) for s in sources])).alias("sources"),
    )


def filtered(df: DataFrame, filters: Mapping[str, object] | str | None) -> DataFrame:
    """Filters of one source, before it is joined: a SQL condition, or a mapping of
    columns to the value, or list of values, they must have."""
    if not filters:
        return df
    if isinstance(filters, str):
        return df.where(filters)
    for name, wanted in filters.items():
        values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        df = df.where(column(name).isin(*values))
    return df


def _family(of_type: T.DataType) -> str:
    return "number" if isinstance(of_type, T.NumericType) else of_type.typeName()


def _aligned(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], key_types: str) -> tuple:
    """Both sides with comparable keys ``__key_i``. Numbers of any width match each other;
    other unlike types are an error, or compared as text with ``key_types="string"``."""
    for key in keys:
        for side, df in (("primary", primary), ("secondary", secondary)):
            if key not in df.columns:
                raise ValueError(f"join key {key!r} is not a column of the {side} source: {df.columns}")
    left, right = [], []
    for key in keys:
        a, b = primary.schema[key].dataType, secondary.schema[key].dataType
        as_text = False
        if _family(a) != _family(b):
            if key_types != "string":
                raise ValueError(
                    f"join key {key!r} is {a.simpleString()} on one side and {b.simpleString()} on the other; "
                    "pass key_types='string' to compare them as text"
                )
            as_text = True
        left.append(column(key).cast("string") if as_text else column(key))
        right.append(column(key).cast("string") if as_text else column(key))
    return left, right


def keyed_join(
    primary: DataFrame,
    secondary: DataFrame | None,
    keys: Sequence[str] | str,
    join_type: str = "inner",
    *,
    primary_name: str = "primary",
    secondary_name: str = "secondary",
    key_types: str = "error",
) -> DataFrame:
    """Join two projections on equal keys; null keys match nothing, duplicates fan out.

    Columns are prefixed by side and every row carries ``__join__``. Without a secondary
    source the rows pass through unprefixed. ``full_outer_compat`` keeps unmatched rows of
    the primary side only.

    An outer join can be split on its outer side only. So the rows of one are found apart: an
    inner join, whose hot keys the adaptive skew join splits on either side, and an anti
    join against the distinct keys of the other side, which keeps rows without a key. This
    is the plan at every size; Spark broadcasts the parts that are small.
    """
    if secondary is None:
        return primary.withColumn(JOIN, provenance("passthrough", None, None, None, [primary_name]))
    if join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {JOIN_TYPES}, not {join_type!r}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    left_keys, right_keys = _aligned(primary, secondary, keys, key_types)
    label = ",".join(keys)

    def side(df: DataFrame, prefix: str, key_columns: list[Column], mark: str) -> DataFrame:
        kept = [c for c in df.columns if not c.startswith("__")]
        text = F.concat_ws(",", *[F.coalesce(column(k).cast("string"), F.lit("null")) for k in keys])
        return df.select(
            *[column(c).alias(f"{prefix}{c}") for c in kept],
            *[k.alias(f"__{mark}{i}") for i, k in enumerate(key_columns)],
            F.when(F.lit(len(keys) > 1) | column(keys[0]).isNotNull(), text).alias(f"__{mark}_text"),
        )

    p = side(primary, PRIMARY, left_keys, "p")
    s = side(secondary, SECONDARY, right_keys, "s")
    p_keys = [f"__p{i}" for i in range(len(keys))]
    s_keys = [f"__s{i}" for i in range(len(keys))]
    bookkeeping = [*p_keys, *s_keys, "__p_text", "__s_text", "__hit"]

    def equal(left: DataFrame, right: DataFrame) -> Column:
        condition = F.lit(True)
        for a, b in zip(p_keys, s_keys):
            condition = condition & (left[a] == right[b])
        return condition

    def same(left: DataFrame, right: DataFrame) -> Column:
        return match(*[(left[a], right[b]) for a, b in zip(p_keys, s_keys)])

    def with_key(df: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            df = df.where(F.col(name).isNotNull())
        return df

    both = [primary_name, secondary_name]
    hit = provenance(join_type, label, F.col("__p_text"), None, both)
    lone_p = provenance(join_type, label, F.col("__p_text"), F.lit(False), [primary_name])
    lone_s = provenance(join_type, label, F.col("__s_text"), F.lit(False), [secondary_name])

    if join_type == "inner":
        return p.join(s, equal(p, s), "inner").withColumn(JOIN, hit).drop(*bookkeeping)
    p_set, s_set = with_key(p, p_keys), with_key(s, s_keys)
    parts = [p_set.join(s_set, same(p_set, s_set), "inner").withColumn(JOIN, hit)]
    # The distinct keys hold no null, so rows without a key are among the unmatched.
    s_seen = s_set.select(*s_keys).distinct()
    parts.append(p.join(s_seen, same(p, s_seen), "left_anti").withColumn(JOIN, lone_p))
    if join_type == "full_outer":
        p_seen = p_set.select(*p_keys).distinct()
        parts.append(s.join(p_seen, same(p_seen, s), "left_anti").withColumn(JOIN, lone_s))
    out = parts[0].drop(*bookkeeping)
    for part in parts[1:]:
        out = out.unionByName(part.drop(*bookkeeping), allowMissingColumns=True)
    return out


def key_text(parts: Sequence[Column]) -> Column:
    """A key as text; one of several parts names the parts it has."""
    texts = [p.cast("string") for p in parts]
    return texts[0] if len(texts) == 1 else F.concat_ws(",", *[F.coalesce(t, F.lit("null")) for t in texts])


def present_sources(join_type: str, keys: Sequence[str], text: Column, names: Sequence[str], has: Sequence[Column]) -> Column:
    """``__join__`` of a row that has some of the sources; ``matched`` is false if it lacks one."""
    none = F.array().cast("array<string>")
    present = F.concat(*[F.when(there, F.array(F.lit(name))).otherwise(none) for there, name in zip(has, names)])
    return provenance(join_type, ",".join(keys), text, F.when(F.size(present) < len(names), F.lit(False)), present)


def join_many(
    sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] | str, join_type: str = "inner", *, key_types: str = "error"
) -> DataFrame:
    """Join any number of projections, ``(alias, rows)`` each, on keys that all of them have.

    Columns are prefixed by alias. ``inner`` keeps keys that every source has, ``left_outer``
    all rows of the first source, ``full_outer`` all rows of all. Null keys match nothing and
    duplicates fan out. ``__join__`` names the sources that a row has; ``matched`` is false
    where one is absent.

    The sources meet one after the other on the keys of the first, by which the rows already
    lie, so each source is shuffled once. A full join meets on the distinct keys of all
    sources, which combine before their shuffle; rows without a key are added as they are.

    A key that many rows of several sources share makes as many rows as the product of their
    numbers, out of little input. Such keys, found by counting first, are cut into cells: each
    source's rows of the key fall into parts by their content, a cell is a part of every source,
    and a row goes to all cells of its part. So each combination is made once, in some cell,
    and the cells spread over all shuffle partitions. ``__join__`` is the same for all rows of a
    key in an inner or full join, so it is made before they multiply.
    """
    if join_type not in ("inner", "left_outer", "full_outer"):
        raise ValueError(f"join_type must be inner, left_outer or full_outer, not {join_type!r}")
    names = [name for name, _ in sources]
    if len(sources) < 2 or len(set(names)) < len(names):
        raise ValueError(f"a join needs two or more sources of different alias, not {names}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    shown = [f"{name}_{c}" for name, df in sources for c in df.columns if not c.startswith("__")]
    if len(set(shown)) < len(shown):
        raise ValueError(f"aliases {names} make columns of one name: {sorted({c for c in shown if shown.count(c) > 1})}")
    for _, df in sources[1:]:
        _aligned(sources[0][1], df, keys, key_types)
    unlike = {k for k in keys if len({_family(df.schema[k].dataType) for _, df in sources}) > 1}
    spine = [f"__k_{i}" for i in range(len(keys))]

    def own(no: int) -> list[str]:
        return [f"__k{no}_{i}" for i in range(len(keys))]

    def side(no: int) -> DataFrame:
        name, df = sources[no]
        parts = [column(k).cast("string") if k in unlike else column(k) for k in keys]
        return df.select(
            *[column(c).alias(f"{name}_{c}") for c in df.columns if not c.startswith("__")],
            *[p.alias(n) for p, n in zip(parts, own(no))],
        )

    def without_key(no: int) -> Column:
        return reduce(lambda a, b: a | b, (F.col(n).isNull() for n in own(no)))

    every = range(len(sources))
    keyed = reduce(
        DataFrame.unionByName,
        (side(no).where(~without_key(no)).select(*[F.col(n).alias(k) for n, k in zip(own(no), spine)], F.lit(no).alias("__no")) for no in every),
    )
    large = _large_keys(keyed, spine, len(sources), join_type)
    cut = not large.isEmpty()

    def dealt(rows: DataFrame, at: Sequence[str], no: int | None) -> DataFrame:
        """Rows of a source in the cells they belong to, or keys in all cells of theirs."""
        if not cut:
            return rows
        found = large.withColumnsRenamed({k: f"__large{i}" for i, k in enumerate(spine)})
        rows = rows.join(found, match(*[(F.col(k), F.col(f"__large{i}")) for i, k in enumerate(at)]), "left")
        cells = F.lit(1).cast("bigint")
        below = [cells := cells * F.col("__parts")[i] for i in every]  # up to and with source i
        if no is None:
            copies, cell = cells, lambda r: r
        else:
            size, step = F.col("__parts")[no], below[no - 1] if no else F.lit(1).cast("bigint")
            plain = [column(f.name) for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType) and not f.name.startswith("__")]
            part = F.pmod(F.xxhash64(*plain, F.lit(no)), size)
            copies, cell = below[-1] / size, lambda r: r % step + part * step + F.floor(r / step) * step * size
        places = F.transform(F.sequence(F.lit(0).cast("bigint"), copies.cast("bigint") - 1), lambda r: cell(r).cast("bigint"))
        places = F.when(F.col("__parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(places)
        return rows.withColumn("__cell", F.explode(places)).drop("__parts", *[f"__large{i}" for i in range(len(keys))])

    def meet(left: DataFrame, no: int, at: Sequence[str], how: str) -> DataFrame:
        right = dealt(side(no).where(~without_key(no)), own(no), no)
        equal = reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in zip(at, own(no))))
        if not cut:
            return left.join(right, equal, how)
        right = right.withColumnRenamed("__cell", "__its_cell").drop("__held")
        met = left.join(right, equal & (left["__cell"] == right["__its_cell"]), how).drop("__its_cell")
        # A part may be empty: then its cells have no rows, as the source has the key in others.
        return met.where(~F.coalesce(F.col("__held")[no], F.lit(False)) | ~without_key(no))

    def spread(rows: DataFrame, at: Sequence[str]) -> DataFrame:
        """By key and cell, in all shuffle partitions: the input is small against what comes of it."""
        if not cut:
            return rows
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at, "__cell")

    def origin(at: Sequence[str], has: Sequence[Column]) -> Column:
        """``__join__``, with the key as text of the type in which all sources compare it."""
        values = [F.col(n).cast(keyed.schema[k].dataType) for n, k in zip(at, spine)]
        return present_sources(join_type, keys, key_text(values), names, has)

    all_there = [F.lit(True)] * len(names)
    if join_type == "full_outer":
        there = keyed.groupBy(*spine).agg(*[F.bool_or(F.col("__no") == no).alias(f"__has{no}") for no in every])
        named = there.select(*spine, origin(spine, [F.col(f"__has{no}") for no in every]).alias(JOIN))
        out = spread(dealt(named, spine, None), spine)
        for no in every:
            out = meet(out, no, spine, "left_outer")
        for no in every:
            alone = origin(own(no), [F.lit(no == other) for other in every])
            out = out.unionByName(side(no).where(without_key(no)).withColumn(JOIN, alone), allowMissingColumns=True)
    elif join_type == "inner":
        out = spread(dealt(side(0).where(~without_key(0)).withColumn(JOIN, origin(own(0), all_there)), own(0), 0), own(0))
        for no in every[1:]:
            out = meet(out, no, own(0), "inner")
    else:
        out = spread(dealt(side(0), own(0), 0), own(0))
        for no in every[1:]:
            out = meet(out, no, own(0), "left_outer")
        out = out.withColumn(JOIN, origin(own(0), [F.lit(True), *[~without_key(no) for no in every[1:]]]))
    return out.select(*[column(c) for c in shown], JOIN)


def _large_keys(keyed: DataFrame, spine: Sequence[str], sources: int, join_type: str) -> DataFrame:
    """Keys that make more than :data:`CELL_ROWS` rows, from the ``spine`` and source ``__no`` of all
    rows: into how many ``__parts`` each source's rows fall, and whether the source ``__held`` any.

    There are fewer of them than rows in a part. Parts are so large that a full cell has
    :data:`CELL_ROWS` rows, so the copies are few against the rows that are made.
    """
    every = range(sources)
    counts = keyed.groupBy(*spine).agg(*[F.count_if(F.col("__no") == no).alias(f"__n{no}") for no in every])
    if join_type != "full_outer":
        for no in every if join_type == "inner" else [0]:
            counts = counts.where(F.col(f"__n{no}") > 0)
    several = reduce(lambda a, b: a + b, ((F.col(f"__n{no}") > 1).cast("int") for no in every))
    size = F.floor(F.pow(F.lit(float(CELL_ROWS)), F.lit(1.0) / F.greatest(several, F.lit(1))))
    parts = F.array(*[F.greatest(F.ceil(F.col(f"__n{no}") / size), F.lit(1)).cast("bigint") for no in every])
    held = F.array(*[F.col(f"__n{no}") > 0 for no in every])
    return counts.select(*spine, parts.alias("__parts"), held.alias("__held")).where(F.exists("__parts", lambda n: n > 1))


def join_stats(joined: DataFrame) -> DataFrame:
    """One row: rows out, and how many of them are matches."""
    return joined.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.count_if(F.coalesce(F.col(JOIN)["matched"], F.lit(True)) & (F.col(JOIN)["type"] != "passthrough")).alias(
            "match_count"
        ),
    )


__all__ = ["filtered", "join_many", "join_stats", "key_text", "keyed_join", "prefix_side", "present_sources", "provenance"]
