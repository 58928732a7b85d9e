"""Display formatting of result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenlens.functions.keys import variant_parts

# Fixed values of the results table.
TIME_ZONE = "Europe/Brussels"
MAX_SHOWN = 15
KEPT = 11
GENE_LINK = "http://www.ncbi.nlm.nih.gov/omim/?term="


def significant(value: Column, digits: int = 3) -> Column:
    """Decimal text with the given number of significant digits, trailing zeros dropped."""
    value = value.cast("double")
    # the power of ten of the leading digit says how many decimals are needed
    lead = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    places = F.greatest(F.lit(digits - 1) - lead, F.lit(0))
    text = F.printf(F.concat(F.lit("%."), places.cast("string"), F.lit("f")), value)
    trimmed = F.when(places > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(value.isNotNull(), trimmed)


def scientific(value: Column, digits: int = 3) -> Column:
    """Scientific text with the given number of significant digits."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value.cast("double")))


def gene_link(gene: Column, prefix: str = GENE_LINK) -> Column:
    """Link to an external gene database."""
    return F.concat(
        F.lit("<a href='" + prefix), gene, F.lit("' target='_blank'>"), gene, F.lit("</a>")
    )


def shorten(text: Column) -> Column:
    """Text over 15 characters is cut to 11 and dots."""
    return F.when(
        F.length(text) > MAX_SHOWN, F.concat(F.substring(text, 1, KEPT), F.lit("..."))
    ).otherwise(text)


def local_time(epoch_seconds: Column, zone: str = TIME_ZONE) -> Column:
    """Wall-clock time in the given zone, as text, whatever the session time zone is."""
    instant = F.timestamp_seconds(epoch_seconds.cast("double"))
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


# Names of the statistics in the results table.
SHOWN_AS = {
    "score": "Ratio_Difference",
    "pvalue": "P_Value",
    "ratio_case": "Ratio_Case",
    "ratio_control": "Ratio_Control",
    "sum_case": "Score_Case",
    "sum_control": "Score_Control",
}
_VARIANT_PARTS = {"chr": "Chr", "pos": "Position", "ref": "Reference", "alt": "Alternative"}


def results_table(ranking: DataFrame, links: bool = True) -> DataFrame:
    """A ranking as people read it: numbers to three digits, variants in their parts, genes linked.

    The sums are shown as they are. Works for every key of a ranking.
    """
    shown = []
    for name, label in SHOWN_AS.items():
        value = F.col(name)
        if name == "pvalue":
            value = scientific(value)
        elif not name.startswith("sum"):
            value = significant(value)
        shown.append(value.alias(label))
    for name in ranking.columns:
        number = name[-1] if name[-1].isdigit() else ""
        if name.startswith("gene_symbol"):
            gene = gene_link(F.col(name)) if links else F.col(name)
            shown.append(gene.alias(f"Gene_Symbol{number}"))
        elif name.startswith("variant_id"):
            parts = variant_parts(name)
            shown += [parts[p].alias(label + number) for p, label in _VARIANT_PARTS.items()]
    return ranking.select(*shown)


def blank_nulls(df: DataFrame) -> DataFrame:
    """Every column as text with NULL shown as the empty string."""
    return df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
