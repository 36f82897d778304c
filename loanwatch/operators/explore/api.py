"""Explorer for enrichment responses in long form: which fields separate
severe customers from the rest?

All features of a kind are unpivoted to (endpoint, feature, value) and handled
in one job, never one job per feature.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ... import constants as C
from ...functions.columns import clean_number
from ...functions.quantiles import quantiles
from ...session import pin, small_side
from ...sources.tables import resolve_column
from .. import classify

log = logging.getLogger(__name__)

EP, CAT = "endpoint", "CURRENT_CAT"
KEY = [EP, "feature"]


# ---- schema discovery ----------------------------------------------------------------

def is_pii(column: str, substrings=C.PII_SUBSTRINGS) -> bool:
    name = column.lower()
    return any(s in name for s in substrings)


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return "json"
    if isinstance(t, T.NumericType):
        return "numeric"
    return "text"


def analysed_columns(df: DataFrame, exclude=()) -> list[str]:
    skip = {c.lower() for c in (*C.RESPONSE_META_COLUMNS, *exclude)}
    return [c for c in df.columns if c.lower() not in skip]


def discover(df: DataFrame, exclude=(), numeric: set | frozenset = frozenset(),
             categorical: set | frozenset = frozenset(), pii=C.PII_SUBSTRINGS,
             max_cat_levels: int = C.MAX_CAT_LEVELS, max_id_cardinality: int = C.MAX_ID_CARDINALITY,
             min_present: int = C.MIN_PRESENT) -> DataFrame:
    """(endpoint, feature, type, n_present, null_rate, n_unique) of every field
    an endpoint returned at least once.

    Cardinality comes from counting (endpoint, feature, value) groups, which
    combine map-side, not from one distinct aggregate per column.
    """
    kinds = {f.name: _kind(f.dataType) for f in df.schema}
    cols = analysed_columns(df, exclude)
    plain = [c for c in cols if kinds[c] != "json"]
    nested = [c for c in cols if kinds[c] == "json"]
    sizes = small_side(df.groupBy(EP).agg(F.count(F.lit(1)).alias("__rows")))
    parts = []
    if plain:
        text = df.select(EP, *[F.col(c).cast("string").alias(c) for c in plain]).unpivot(
            EP, plain, "feature", "v").where("v is not null")
        per = text.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("n"))
        whole = F.abs(F.pmod(F.col("v").try_cast("double"), F.lit(1.0))) <= 1e-8
        parts.append(per.groupBy(*KEY).agg(
            F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_unique"),
            F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole")))
    if nested:
        here = df.select(EP, *[F.col(c).isNotNull().cast("bigint").alias(c) for c in nested]).unpivot(
            EP, nested, "feature", "v")
        parts.append(here.groupBy(*KEY).agg(F.sum("v").alias("n_present")).where("n_present > 0").select(
            *KEY, "n_present", F.lit(-1).cast("bigint").alias("n_unique"), F.lit(False).alias("whole")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)

    def named(names):
        return F.col("feature").isin(sorted(names)) if names else F.lit(False)
    n, u = F.col("n_present"), F.col("n_unique")
    is_num = named({c for c in plain if kinds[c] == "numeric"})
    kind = (F.when(named(set(numeric)), "numeric").when(named(set(categorical)), "categorical")
            .when(named({c for c in cols if is_pii(c, pii)}), "pii_excluded")
            .when(named(set(nested)), "json_skipped")
            .when(n < min_present, "sparse").when(u <= 1, "constant")
            .when(is_num & F.col("whole") & (u <= max_cat_levels), "categorical")
            .when(is_num, "numeric")
            .when((u <= max_id_cardinality) & (n / u >= C.MIN_ROWS_PER_LEVEL), "categorical")
            .otherwise("id_like"))
    return out.join(sizes, EP).select(
        *KEY, kind.alias("type"), "n_present",
        F.round(1 - n / F.col("__rows"), 4).alias("null_rate"), "n_unique")


# ---- long bases ------------------------------------------------------------------------

def numeric_long(df: DataFrame, features: list[str]) -> DataFrame:
    """(endpoint, feature, cat, v): one row per row and numeric feature, NULLs kept."""
    return df.select(EP, F.col(CAT).alias("cat"), *[clean_number(F.col(f)).alias(f) for f in features]) \
        .unpivot([EP, "cat"], features, "feature", "v")


def level_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(endpoint, feature, level, cat, n); a NULL level is kept apart."""
    return df.select(EP, F.col(CAT).alias("cat"), *[F.col(f).cast("string").alias(f) for f in features]) \
        .unpivot([EP, "cat"], features, "feature", "level") \
        .groupBy(*KEY, "level", "cat").agg(F.count(F.lit(1)).alias("n"))


def returned(long: DataFrame, schema: DataFrame, kind: str) -> DataFrame:
    """Only the (endpoint, feature) pairs the schema gives this type."""
    pairs = small_side(schema.where(F.col("type") == kind).select(*KEY))
    return long.join(pairs, KEY, "left_semi")


# ---- numeric features --------------------------------------------------------------------

def summarize_numeric(long: DataFrame, method: str = "exact") -> DataFrame:
    """Per class: n, null rate, mean, sample std, min, max and five quantiles."""
    by = [*KEY, "cat"]
    base = long.groupBy(*by).agg(
        F.count("v").alias("n"),
        F.round(1 - F.count("v") / F.count(F.lit(1)), 4).alias("null_rate"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, by, "v", list(C.STAT_QUANTILES), method).groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100):02d}")
          for p in C.STAT_QUANTILES])
    return base.join(q, by, "left")


def _folded_auc(long: DataFrame, hit: Column, name: str) -> DataFrame:
    a = classify.auc(long.where("v is not null").withColumn("hit", hit.cast("int")), KEY, "v", "hit")
    value = F.when(F.col("n") >= 10, F.col("auc"))
    return a.select(*KEY, F.col("n").alias(f"{name}_n"), value.alias(f"{name}_auc"))


def separation_numeric(long: DataFrame, severe_ge: int = C.CARVE_CATEGORY) -> DataFrame:
    """ROC-AUC folded to >= 0.5 against severe, and on the queue against its
    worst category; NULL with under ten rows or one class."""
    pairs = long.select(*KEY).distinct()
    full = _folded_auc(long, F.col("cat") >= severe_ge, "all")
    queue = _folded_auc(long.where(F.col("cat") < severe_ge), F.col("cat") == severe_ge - 1, "q")

    def fold(c):
        return F.round(F.greatest(c, 1 - c), 4)
    out = pairs.join(full, KEY, "left").join(queue, KEY, "left")
    a, q = F.col("all_auc"), F.col("q_auc")
    return out.select(
        *KEY, F.lit("auc").alias("metric"), fold(a).alias("value"),
        F.when(a >= 0.5, "high=severe").when(a < 0.5, "low=severe").otherwise("").alias("direction"),
        fold(q).alias("queue_value"), F.coalesce("q_n", F.lit(0)).alias("queue_n"))


def suggest_thresholds(long: DataFrame, severe_ge: int = C.CARVE_CATEGORY) -> DataFrame:
    """The cut with the best F1 per feature among 19 quantiles, both directions.

    Values are counted between cuts first; the scan runs over those counts.
    """
    probs = [round(0.05 * i, 2) for i in range(1, 20)]
    vals = pin(long.where("v is not null").groupBy(*KEY, "v").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cat") >= severe_ge).alias("p")))
    cuts = quantiles(vals, KEY, "v", probs, weight="n").groupBy(*KEY).agg(
        F.array_sort(F.collect_set("value")).alias("cuts"))
    cuts = small_side(cuts)
    at_least = F.size(F.filter("cuts", lambda c: c <= F.col("v")))     # cuts at or below v
    above = F.size(F.filter("cuts", lambda c: c < F.col("v")))         # cuts below v
    cells = vals.join(cuts, KEY).groupBy(*KEY, "cuts", at_least.alias("ge"), above.alias("gt")).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"))
    rows = cells.select(*KEY, "n", "p", "ge", "gt", F.posexplode("cuts").alias("i", "threshold"))
    high, low = F.col("ge") > F.col("i"), F.col("gt") <= F.col("i")

    def total(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    per = rows.groupBy(*KEY, "i", "threshold").agg(
        F.sum("n").alias("all_n"), F.sum("p").alias("all_p"),
        total(high, "n").alias("hn"), total(high, "p").alias("hp"),
        total(low, "n").alias("ln"), total(low, "p").alias("lp"))
    sides = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(name).alias("direction"),
                               F.col(n).alias("flagged"), F.col(p).alias("tp"))
                      for d, name, n, p in ((0, "high=severe", "hn", "hp"), (1, "low=severe", "ln", "lp"))])
    per = per.select(*KEY, "i", "threshold", "all_n", "all_p", F.inline(sides)).where(
        "tp > 0 and all_p > 0 and all_p < all_n and all_n >= 10")
    prec = F.col("tp") / F.col("flagged")
    rec = F.col("tp") / F.col("all_p")
    per = per.withColumns({"precision": prec, "recall": rec}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    best = per.groupBy(*KEY).agg(F.max(F.struct(
        "f1", (-F.col("i")).alias("oi"), (-F.col("d")).alias("od"), "threshold", "direction",
        "precision", "recall", "flagged", "all_n", "all_p")).alias("b")).select(*KEY, "b.*")
    base = F.col("all_p") / F.col("all_n")
    return best.select(
        *KEY, "direction", "threshold", F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"),
        F.round(F.col("precision") / base, 3).alias("lift"), F.col("flagged").alias("n_flagged"),
        F.round(base, 4).alias("base_rate"))


def histogram(long: DataFrame, bins: int = 39, method: str = "exact") -> DataFrame:
    """Rows per class in equal bins over [p1, p99], outliers clipped into the ends."""
    v = long.where("v is not null")
    q = quantiles(v, KEY, "v", [0.01, 0.99], method).groupBy(*KEY).agg(
        F.min("value").alias("a"), F.max("value").alias("b"))
    ends = v.groupBy(*KEY).agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    flat = F.col("a") == F.col("b")
    spec = q.join(ends, KEY).select(
        *KEY, F.when(flat, F.col("mn")).otherwise(F.col("a")).alias("lo"),
        F.when(~flat, F.col("b")).when(F.col("mn") == F.col("mx"), F.col("mn") + 1.0)
        .otherwise(F.col("mx")).alias("hi"))
    x = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    number = F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))
    return v.join(small_side(spec), KEY).groupBy(*KEY, "cat", number.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- categorical features ------------------------------------------------------------------

def category_rates(levels: DataFrame, severe_ge: int = C.CARVE_CATEGORY) -> DataFrame:
    """Per level: support, severe rate, lift over the endpoint's base, rows in queue."""
    sev = F.sum(F.when(F.col("cat") >= severe_ge, F.col("n")).otherwise(0))
    base = levels.groupBy(*KEY).agg((sev / F.sum("n")).alias("base"))       # NULL levels included
    per = levels.where("level is not null").groupBy(*KEY, "level").agg(
        F.sum("n").alias("n"), sev.alias("s"),
        F.sum(F.when(F.col("cat") < severe_ge, F.col("n")).otherwise(0)).alias("n_queue"))
    rate = F.col("s") / F.col("n")
    return per.join(base, KEY).select(
        *KEY, "level", "n", F.round(rate, 4).alias("severe_rate"), F.round("base", 4).alias("base_rate"),
        F.round(rate / F.when(F.col("base") != 0, F.col("base")), 3).alias("lift"), "n_queue")


def cramers_v(levels: DataFrame, hit: Column, name: str) -> DataFrame:
    """Cramer's V of level against a yes/no target, from contingency counts.

    With two levels the continuity correction of a 2x2 table applies.
    """
    tab = levels.where("level is not null").groupBy(*KEY, "level").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("no"))
    tot = tab.groupBy(*KEY).agg(F.sum("yes").alias("ty"), F.sum("no").alias("tn"),
                                F.count(F.lit(1)).alias("k"))
    x = tab.join(tot, KEY)
    n = F.col("ty") + F.col("tn")

    def term(o, col_total):
        e = (F.col("yes") + F.col("no")) * F.col(col_total) / n
        gap = F.abs(F.col(o) - e)
        gap = gap - F.when(F.col("k") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return gap * gap / F.when(e != 0, e)
    per = x.groupBy(*KEY, "ty", "tn", "k").agg(F.sum(term("yes", "ty") + term("no", "tn")).alias("chi2"))
    ok = (F.col("k") >= 2) & (F.col("ty") > 0) & (F.col("tn") > 0)
    rows = levels.groupBy(*KEY).agg(F.sum("n").alias("__rows"))
    return rows.join(per, KEY, "left").select(
        *KEY, F.round(F.when(ok, F.sqrt(F.col("chi2") / n)), 4).alias(f"{name}_v"),
        F.when(ok, n).otherwise(F.col("__rows")).alias(f"{name}_n"))


def separation_categorical(levels: DataFrame, severe_ge: int = C.CARVE_CATEGORY) -> DataFrame:
    """Cramer's V on all rows and on the queue."""
    full = cramers_v(levels, F.col("cat") >= severe_ge, "all")
    queue = cramers_v(levels.where(F.col("cat") < severe_ge), F.col("cat") == severe_ge - 1, "q")
    return full.join(queue, KEY, "left").select(
        *KEY, F.lit("cramers_v").alias("metric"), F.col("all_v").alias("value"), F.lit("").alias("direction"),
        F.col("q_v").alias("queue_value"), F.coalesce("q_n", F.lit(0)).alias("queue_n"))


def class_composition(levels: DataFrame, max_levels: int = 20) -> DataFrame:
    """Share of each level within a class, over the most frequent levels."""
    from pyspark.sql import Window
    known = levels.where("level is not null")
    size = known.groupBy(*KEY, "level").agg(F.sum("n").alias("ln"))
    # The rank filter is pushed below the shuffle as a per-task group limit.
    w = Window.partitionBy(*KEY).orderBy(F.col("ln").desc(), "level")
    top = size.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max_levels)
    kept = known.join(small_side(top.select(*KEY, "level")), [*KEY, "level"], "left_semi")
    total = kept.groupBy(*KEY, "cat").agg(F.sum("n").alias("cn"))
    return kept.join(total, [*KEY, "cat"]).select(*KEY, "cat", "level", (F.col("n") / F.col("cn")).alias("share"))


# ---- list columns --------------------------------------------------------------------------

def unwrap_union(c: Column, dtype: T.DataType) -> Column:
    """A nullable-union field {branch: [x, ...]} to text, several joined by '|'."""
    if isinstance(dtype, T.StructType) and len(dtype) == 1:
        inner = dtype.fields[0]
        if isinstance(inner.dataType, T.ArrayType):
            return F.array_join(c.getField(inner.name).cast("array<string>"), "|")
        return c.getField(inner.name)
    return c


def _is_union(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and len(dtype) == 1


def item_fields(df: DataFrame, column: str) -> dict[str, T.DataType]:
    """Field name to type of a list column's items."""
    return {f.name: f.dataType for f in df.schema[column].dataType.elementType}


def explode_list(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per list item, its fields as columns, unions unwrapped, no repeats."""
    fields = item_fields(df, column)
    items = df.select(*keep, F.explode(column).alias("__i")).where("__i is not null")
    return items.select(*keep, *[unwrap_union(F.col(f"__i.{n}"), t).alias(n)
                                 for n, t in fields.items()]).distinct()


def jalali_ordinal(value: Column) -> Column:
    """Jalali YYYYMMDD (number, or text with a time) to a day number comparable
    with a proleptic Gregorian ordinal; 0, short and out-of-range give NULL."""
    digits = F.substring(F.regexp_replace(value.cast("string"), "[^0-9]", ""), 1, 8)
    d = F.when(F.length(digits) == 8, digits).cast("int")
    y, m, day = F.floor(d / 10000), F.floor(d / 100) % 100, d % 100
    yy = y + 1595
    days = (-355668 + 365 * yy + F.floor(yy / 33) * 8 + F.floor((yy % 33 + 3) / 4) + day
            + F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186))
    # Fixed point of the scale: 1403-01-01 is 2024-03-20, ordinal 738965.
    anchor = -355668 + 365 * (1403 + 1595) + (2998 // 33) * 8 + (2998 % 33 + 3) // 4 + 1
    ok = y.between(1300, 1500) & m.between(1, 12) & day.between(1, 31)
    return F.when(ok, (days + (738965 - anchor)).cast("bigint"))


def is_amount_like(name: str) -> bool:
    return name.lower().startswith("am") or "amount" in name.lower()


def is_date_like(name: str) -> bool:
    return "date" in name.lower()


def roll_up_list(df: DataFrame, column: str, as_of: int | None = None,
                 bank_field: str | None = None, own_bank_code=None) -> DataFrame:
    """Add a customer's list figures as columns, row by row (no shuffle).

    Counts; sum and max of amounts; max of other numbers; days since the newest
    and oldest date; number of banks; every figure again for the own bank and
    for the rest, and the outside share. An empty list gives NULL, not 0.
    Fields that hold no value anywhere are left out.
    """
    fields = item_fields(df, column)
    whole_list = F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))
    items = F.filter(whole_list, lambda i: i.isNotNull())

    def number(t):
        """A number, bare or inside a union of one member."""
        if isinstance(t, T.StructType) and len(t.fields) == 1:
            t = t.fields[0].dataType
        return isinstance(t, T.NumericType)
    amounts = sorted(n for n, t in fields.items() if is_amount_like(n) and number(t))
    dates = sorted(n for n in fields if is_date_like(n)) if as_of is not None else []
    coded = sorted(n for n, t in fields.items() if number(t)
                   and not is_amount_like(n) and not is_date_like(n) and n != bank_field)

    def values(name, where=None):
        src = items if where is None else F.filter(items, where)
        return F.filter(F.transform(src, lambda i: unwrap_union(i[name], fields[name]).cast("double")), lambda x: x.isNotNull())

    def days(name):
        src = F.transform(items, lambda i: as_of - jalali_ordinal(unwrap_union(i[name], fields[name])))
        return F.filter(src, lambda x: x.isNotNull())

    # One pass decides which fields ever hold a value (one number per field).
    probe = {f"v_{n}": F.max(F.size(values(n))) for n in amounts + coded}
    probe |= {f"d_{n}": F.max(F.size(days(n))) for n in dates}
    seen = df.agg(*[c.alias(k) for k, c in probe.items()]).first().asDict() if probe else {}
    amounts = [n for n in amounts if seen[f"v_{n}"]]
    coded = [n for n in coded if seen[f"v_{n}"]]
    dates = [n for n in dates if seen[f"d_{n}"]]

    def total(arr):
        return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x))

    out = {"n_items": F.size(whole_list), "has_items": F.size(whole_list) > 0}     # an empty record is one too
    for n in amounts:
        out[f"sum_{n}"], out[f"max_{n}"] = total(values(n)), F.array_max(values(n))
    for n in coded:
        out[f"max_{n}"] = F.array_max(values(n))
    for n in dates:
        out[f"min_days_since_{n}"], out[f"max_days_since_{n}"] = F.array_min(days(n)), F.array_max(days(n))
    if bank_field and bank_field in fields:
        banks = F.array_distinct(F.filter(F.transform(items, lambda i: unwrap_union(i[bank_field], fields[bank_field])), lambda x: x.isNotNull()))
        out["n_banks"] = F.when(F.size(whole_list) > 0, F.size(banks))
        if own_bank_code is not None:
            own = str(own_bank_code)
            code = lambda i: F.coalesce(unwrap_union(i[bank_field], fields[bank_field]).cast("string"), F.lit("None"))
            for prefix, where in (("own_", lambda i: code(i) == own), ("ext_", lambda i: code(i) != own)):
                out[f"{prefix}n_items"] = F.size(F.filter(items, where))
                for n in amounts:
                    v = values(n, where)
                    out[f"{prefix}sum_{n}"], out[f"{prefix}max_{n}"] = total(v), F.array_max(v)
                for n in coded:
                    out[f"{prefix}max_{n}"] = F.array_max(values(n, where))
            for n in amounts:
                whole = out[f"sum_{n}"]
                out[f"ext_share_{n}"] = out[f"ext_sum_{n}"] / F.when(whole > 0, whole)
    res = df.withColumns(out)
    if "own_n_items" in out:
        share = res.where("n_items > 0").agg(F.avg((F.col("own_n_items") > 0).cast("double"))).first()[0]
        if share is not None and share < 0.8:
            log.warning("own bank code %s matches %.0f%% of customers with items; the own/ext split "
                        "is very likely meaningless", own_bank_code, 100 * share)
    return res


def code_reference(items: DataFrame, order: list[str], code: str = "code",
                   description: str = "description") -> DataFrame:
    """Code to its first description in the stated order. The two columns are found in any letter case."""
    code, description = resolve_column(items, code), resolve_column(items, description)
    known = items.where(F.col(code).isNotNull() & F.col(description).isNotNull())
    return known.groupBy(code).agg(F.min_by(description, F.struct(*order, description)).alias(description))


# ---- the whole explorer -----------------------------------------------------------------------

@dataclass
class Exploration:
    """The result tables of one run."""

    schema: DataFrame
    summary: DataFrame
    separation: DataFrame
    thresholds: DataFrame
    category_rates: DataFrame
    references: dict[str, DataFrame] = field(default_factory=dict)


def _typed(df: DataFrame, schema: DataFrame, kind: str) -> list[str]:
    names = {r[0] for r in schema.where(F.col("type") == kind).select("feature").distinct().collect()}
    return [c for c in df.columns if c in names]


def explore(df: DataFrame, list_columns: bool = True, id_col: str = "NATIONAL_CODE",
            as_of: int | None = None, bank_field: str | None = None, own_bank_code=None,
            severe_ge: int = C.CARVE_CATEGORY, **discover_options) -> Exploration:
    """Real endpoints, and every list column as two more: its items and its
    per-customer figures; all through the same statistics."""
    df = df.where(F.col(CAT).isNotNull())
    frames = [(df, discover(df, **discover_options))]
    references = {}
    if list_columns:
        nested = frames[0][1].where("type = 'json_skipped'").select(*KEY).collect()   # one per list column
        for r in nested:
            ep, col = r[EP], r["feature"]
            if is_pii(col) or not isinstance(df.schema[col].dataType, T.ArrayType) or \
                    not isinstance(df.schema[col].dataType.elementType, T.StructType):
                continue
            ids = [c for c in (id_col, CAT) if c in df.columns]
            own = pin(df.where(F.col(EP) == ep).select(*ids, col))
            # Written once: discovery and every table below read single columns of them.
            items = pin(explode_list(own, col, ids)).withColumn(EP, F.lit(f"{ep}::{col}[item]"))
            item_schema = discover(items, exclude=ids, max_id_cardinality=max(
                discover_options.get("max_id_cardinality", C.MAX_ID_CARDINALITY), 100))
            text = resolve_column(items, "description", required=False)
            if text and resolve_column(items, "code", required=False):
                references[f"{ep}::{col}"] = code_reference(items, ids)
                item_schema = item_schema.withColumn("type", F.when(
                    F.col("feature") == text, "reference").otherwise(F.col("type")))
            frames.append((items, item_schema))
            agg = roll_up_list(own.select(CAT, col), col, as_of, bank_field, own_bank_code).drop(col)
            agg = pin(agg.withColumnsRenamed({c: f"{col}_{c}" for c in agg.columns if c != CAT})).withColumn(
                EP, F.lit(f"{ep}::{col}[agg]"))
            frames.append((agg, discover(agg, exclude=[CAT])))
    tables: dict[str, DataFrame | None] = dict.fromkeys(
        ("schema", "summary", "separation", "thresholds", "category_rates"))

    def add(name, part):
        tables[name] = part if tables[name] is None else tables[name].unionByName(part)
    for data, schema in frames:
        schema = small_side(schema)
        add("schema", schema)
        nums, cats = _typed(data, schema, "numeric"), _typed(data, schema, "categorical")
        if nums:
            long = pin(returned(numeric_long(data, nums), schema, "numeric"))
            add("summary", summarize_numeric(long))
            add("separation", separation_numeric(long, severe_ge))
            add("thresholds", suggest_thresholds(long, severe_ge))
        if cats:
            levels = pin(returned(level_counts(data, cats), schema, "categorical"))
            add("separation", separation_categorical(levels, severe_ge))
            add("category_rates", category_rates(levels, severe_ge))
    return Exploration(**tables, references=references)
