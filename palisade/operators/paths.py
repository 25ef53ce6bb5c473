"""What an evidence file's path says: month, system, subsystem, display name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import SYSTEMS, bound, compact, evidence_month, extension, file_name

# Kinds of evidence, their limits, and the folder names of placed().
IMAGES, TEXTS, PDFS = (".png", ".jpg", ".jpeg", ".gif", ".bmp"), (".txt", ".log", ".csv"), (".pdf",)
ALLOWED = IMAGES + TEXTS + PDFS
#: Bytes beyond which a file of the kind fails to parse.
MOST_BYTES = {TEXTS: 10 << 20, PDFS: 100 << 20, IMAGES: 50 << 20}
MOST_PATH = 4096


def placed(path: Column) -> Column:
    """struct(system, subsystem, display) from a path below its month folder, by an ordered ladder of layouts."""
    parts = F.split(path, "/")
    keys = F.struct(parts.alias("parts"), F.transform(parts, compact).alias("keys"), compact(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")).alias("scope"))
    return bound(keys, _placed)


def _placed(given: Column) -> Column:
    parts, keys = given["parts"], given["keys"]
    n = F.size(parts)
    at = lambda values, i: F.coalesce(F.get(values, F.lit(i) if isinstance(i, int) else i), F.lit(""))
    part, key = lambda i: at(parts, i), lambda i: at(keys, i)
    name = F.element_at(parts, -1)
    display = F.when(n == 1, name).otherwise(F.concat(F.lit("["), F.array_join(F.slice(parts, 1, n - 1), "/"), F.lit("] "), name))
    first, name_key = key(0), F.element_at(keys, -1)
    to = lambda system, subsystem: F.struct((F.lit(system) if isinstance(system, str) else system).alias("system"), (F.lit(subsystem) if isinstance(subsystem, str) else subsystem).alias("subsystem"))

    systems = F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])
    direct = systems[first]
    below = F.when(n > 2, part(1)).otherwise("Base System")
    below = F.when((direct == "RADIO") & (compact(below) == "site"), "Site Radio").otherwise(below)
    scope = given["scope"]
    depot, wrapper = first.isin("depotscreenshot", "depothqscreenshot"), first.isin("depotscreenshot", "depothqscreenshot", "hqscreenshot")
    nested = wrapper & (n > 2) & (key(1) == "hqscreenshot")
    cursor = F.when(nested, 2).otherwise(1)
    inner = F.when(depot & ~nested, "Depot").otherwise("HQ")
    has_child = wrapper & (cursor < n - 1)
    child = key(cursor)
    token = reduce(lambda c, s: c.when(F.contains(name_key, F.lit(s[0])), to(s[1], "Unspecified")), list(SYSTEMS.items())[1:], F.when(F.contains(name_key, F.lit("radio")), to("RADIO", "Unspecified")))
    where = (
        F.when(direct.isNotNull(), to(direct, below))
        .when(first == "eporeportcombined", to(F.when(F.contains(scope, F.lit("info")), "INFO").when(F.contains(scope, F.lit("epm")), "EPM").otherwise("Uncategorized"), "Report"))
        .when(first == "voicereport", to("VOICE", "Site U"))
        .when(F.startswith(first, F.lit("siteradio")), to("RADIO", "Site Radio"))
        .when(F.startswith(first, F.lit("depotradio")) | (first == "febscreenshot"), to("RADIO", "Legacy mixed radio"))
        .when(has_child & (child == "radio"), to("RADIO", inner))
        .when(has_child & (child == "hqcctv"), to("CCTV", "HQ"))
        .when(has_child & systems[child].isNotNull(), to(systems[child], inner))
        .otherwise(F.coalesce(token, to("Uncategorized", "Base System")))
    )
    return F.struct(where["system"].alias("system"), where["subsystem"].alias("subsystem"), display.alias("display"))


def accepted(path: Column) -> Column:
    """Whether a path names evidence: an allowed kind, not hidden, no traversal."""
    name = file_name(path)
    ok = extension(path).isin(*ALLOWED) & ~F.startswith(name, F.lit(".")) & (F.lower(name) != "thumbs.db")
    return ok & (F.length(path) <= MOST_PATH) & ~F.contains(path, F.lit("\0")) & ~F.array_contains(F.split(path, "/"), "..")


def kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*TEXTS), "text").when(ext.isin(*PDFS), "pdf")


def too_large(path: Column, length: Column) -> Column:
    ext = extension(path)
    return reduce(lambda c, k: c.when(ext.isin(*k[0]), length > k[1]), MOST_BYTES.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """files (path month/...) that are evidence, with month, system, subsystem, display, kind, too_large if a length is there; in order of the lower-cased path."""
    p = F.col(path)
    below = F.regexp_replace(p, "^[^/]*/", "")
    df = files.where(accepted(p)).withColumn("month", F.element_at(F.split(p, "/"), 1)).withColumn("_at", placed(below))
    df = df.withColumns({"system": F.col("_at.system"), "subsystem": F.col("_at.subsystem"), "display": F.col("_at.display"), "kind": kind(p), "type": F.upper(F.replace(extension(p), F.lit("."), F.lit("")))}).drop("_at")
    if "length" in files.columns:
        df = df.withColumn("too_large", too_large(p, F.col("length")))
    return df


def months(files: DataFrame, path: str = "path") -> DataFrame:
    """Month folders, newest first; equal months by name."""
    df = files.select(F.element_at(F.split(F.col(path), "/"), 1).alias("month")).where(~F.startswith("month", F.lit("."))).distinct()
    at = evidence_month(F.col("month"))
    return df.withColumns({"year": F.coalesce(at["year"], F.lit(0)), "month_no": F.coalesce(at["month"], F.lit(0))}).orderBy(F.desc("year"), F.desc("month_no"), "month")
