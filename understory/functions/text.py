"""String classification and parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Habit by the first word found in a vegetation name.
HABITS = (
    (("mixed",), "mixed"),
    (("hardwood", "deciduous", "oak"), "hardwood"),
    (("pine", "conifer", "evergreen"), "conifer"),
    (("shrub", "chaparral"), "shrub"),
    (("grass", "herbaceous"), "grass"),
)


def growth_habit(name: Column) -> Column:
    """Habit of a vegetation type name; the first rule with a word in the name wins, else ``other``."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for words, habit in HABITS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, habit) if out is None else out.when(hit, habit)
    return out.otherwise("other")


#: Fixed values of the source map: life forms that are a group by themselves, and first words of named classes that decide the mixed ones.
LIFE_FORMS = {
    "conifer forest": ("conifer forest",),
    "hardwood forest": ("hardwood forest",),
    "shrub": ("shrub", "riparian shrub", "non-native shrub"),
    "grass": ("herbaceous", "herbaceous wetland"),
}
MIXED_FORMS = ("mixed conifer-hardwood forest", "non-native forest")
CONIFER_NAMES = ("pseudotsuga", "sequoia", "pinus", "hesperocyparis")
HARDWOOD_NAMES = ("quercus", "eucalyptus")


def broad_group(map_class: Column, lifeform: Column) -> Column:
    """One of five broad groups from a map's life form, and from the named class where the form is mixed; missing values are ``other``."""
    form, name = F.lower(F.coalesce(lifeform, F.lit(""))), F.lower(F.coalesce(map_class, F.lit("")))
    begins = lambda words: name.rlike("^(?:" + "|".join(words) + ")")
    mixed = form.isin(*MIXED_FORMS)
    rules = [(form.isin(*forms), group) for group, forms in LIFE_FORMS.items()]
    rules += [(mixed & begins(CONIFER_NAMES), "conifer forest"), (mixed & begins(HARDWOOD_NAMES) | (form == "riparian forest") & begins(("populus",)), "hardwood forest")]
    out = F.lit("other")
    for rule, group in reversed(rules):
        out = F.when(rule, group).otherwise(out)
    return out


def voltage_kv(value: Column) -> Column:
    """Largest of the volts listed with ``;``, ``/`` or ``,`` in kilovolts; unreadable parts are skipped, null if none is left."""
    parts = F.split(F.translate(value, ",/", ";;"), ";")
    volts = F.transform(parts, lambda p: F.expr("try_cast(1 as double)") * F.trim(p).try_cast("double"))
    return F.array_max(F.filter(volts, lambda v: v.isNotNull())) / 1000


def tile_stem(epoch: Column, index: Column) -> Column:
    return F.format_string("%s_t%04d", epoch, index.cast("int"))


def surface_names(epoch: Column, index: Column) -> Column:
    """Struct of the file names of a tile's surfaces."""
    stem = tile_stem(epoch, index)
    return F.struct(*[F.concat(stem, F.lit(f"_{k}.tif")).alias(k) for k in ("dtm", "dsm", "chm")])


def spatial_stratum(x: Column, y: Column, box: tuple[float, float, float, float], rows: int = 5, columns: int = 5) -> Column:
    """Label of the coarse grid cell of a point, clamped to the grid."""
    w, s, e, n = box
    place = lambda v, lo, hi, k: F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor((v - lo) / (hi - lo) * k).cast("int")))
    return F.concat(F.lit("r"), place(y, s, n, rows), F.lit("c"), place(x, w, e, columns))


def disallowed_chars(df: DataFrame, text: str, ident: str, allowed: str = r"[\x09\x20-\x7e]") -> DataFrame:
    """(ident, line, char, n): characters outside ``allowed`` with their 1-based line, counted per line."""
    lines = df.select(ident, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line_text"))
    odd = lines.withColumn("c", F.explode(F.split(F.regexp_replace("line_text", allowed, ""), ""))).where("c <> ''")
    return odd.groupBy(ident, (F.col("at") + 1).cast("long").alias("line"), F.col("c").alias("char")).agg(F.count("*").alias("n"))
