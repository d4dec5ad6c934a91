"""Ordered keyword rules, packed lists and label normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrace.functions.core import ColumnLike, col

# Rock-class keywords, in order of priority.
LITHOLOGY_RULES = {
    "unconsolidated": [
        "alluv", "unconsolidat", "colluv", "loess", "evaporit", "gypsum", " salt", "halite", "glacial",
        " till", "eolian", "aeolian", "fluvial", "lacustrine", "regolith", "soil",
    ],
    "carbonate": ["limestone", "dolomit", "carbonate", "chalk", "marl", "calcite", "travertine"],
    "crystalline": [
        "granit", "granodiorit", "diorit", "gabbro", "tonalit", "syenit", "plutonic", "intrusive",
        "gneiss", "schist", "granulit", "charnockit", "quartzit", "migmatit", "phyllit", "amphibolit",
        "metamorphic", "metased", "metavolcan", "slate", "marble", "eclogite", "anorthosite",
        "peridotit", "pegmatit", "crystalline",
    ],
    "volcanic": [
        "basalt", "andesit", "rhyolit", "dacit", "volcanic", "tuff", "lava", "pyroclast", "ignimbrit",
        "trachyt", "obsidian", "felsic", "mafic",
    ],
    "clastic_sed": [
        "sandstone", "shale", "mudstone", "siltstone", "conglomerat", "clastic", "greywacke",
        "graywacke", "turbidit", "arkose", "sedimentary", "flysch", "molasse", "claystone", "sand",
        "clay", "silt", "gravel",
    ],
}


def keyword_class(text: ColumnLike, rules: Mapping[str, Sequence[str]], default: str = "default") -> Column:
    """P-16: the first rule, in order, one of whose keywords occurs in the text."""
    s = F.lower(F.coalesce(col(text), F.lit("")))
    out = None
    for label, words in rules.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | s.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def normalise_label(text: ColumnLike, aliases: Mapping[str, str]) -> Column:
    """P-24: upper-case, trimmed label with known spellings unified; others pass through."""
    s = F.upper(F.trim(col(text)))
    out = F.lit(None).cast("string")
    for alias, label in aliases.items():
        out = F.coalesce(out, F.when(s == alias, F.lit(label)))
    return F.coalesce(out, s)


def region_display(region: ColumnLike, label: ColumnLike, mark_prefix: str | None = None,
                   mark: str = " (US)") -> Column:
    """P-25: label from a label table, else the key in title case, tagged for one prefix."""
    key = col(region)
    shown = F.coalesce(col(label), F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))
    if mark_prefix is None:
        return shown
    bare = F.regexp_replace(shown, " US$", "")
    return F.when(key.startswith(mark_prefix), F.concat(bare, F.lit(mark))).otherwise(shown)


def explode_list(df: DataFrame, column: str, separator: str, out: str) -> DataFrame:
    """J-7: one row per item of a packed list; blanks dropped."""
    items = df.withColumn(out, F.explode(F.split(F.col(column), separator)))
    return items.withColumn(out, F.trim(out)).filter(F.col(out) != "")


def cascade_edges(topology: DataFrame, station: str = "station_name",
                  upstream: str = "direct_upstream_stations") -> DataFrame:
    """P-12: ``Name (ch12,...,tau=3); ...`` to edges (up, down, tau_h); no tau means 0."""
    listed = topology.select(F.col(station).alias("down"), F.explode(F.split(F.col(upstream), ";")).alias("entry"))
    rows = listed.select("down", F.trim("entry").alias("entry")).filter("entry <> ''")
    return rows.select(
        F.trim(F.regexp_replace("entry", r"\s*\(ch.*$", "")).alias("up"),
        "down",
        F.coalesce(
            F.nullif(F.regexp_extract("entry", r"tau=(\d+)", 1), F.lit("")).cast("int"), F.lit(0)
        ).alias("tau_h"),
    )


def risk_bin(alteration: ColumnLike) -> Column:
    """P-27: generic ordinal bin of an absolute alteration."""
    a = F.abs(col(alteration))
    return F.when(a.isNull(), "na").when(a > 0.5, "high").when(a > 0.25, "moderate").otherwise("low")


def sign_class(effect: ColumnLike) -> Column:
    """P-26."""
    e = col(effect)
    return F.when(e > 0, "harmful").when(e < 0, "beneficial").otherwise("neutral")


def input_key(*columns: ColumnLike) -> Column:
    """X-13: content hash of the inputs."""
    return F.sha2(F.concat_ws("|", *[col(c).cast("string") for c in columns]), 256)
