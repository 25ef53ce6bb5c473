"""Screenshots: recognised tokens to rows, findings and an audited verdict.

Tokens (image, seq, bbox, text, confidence) come from a recogniser outside. The
clustering of tokens into rows depends on the order they are met in and on the
medians so far, so places are settled in one Python group an image, once for all
confidences asked for: rows, the counts beside threat labels and the texts beside version labels. An image's
tokens are few, and images are spread by hash. What the texts say, and the verdict, are columns; profiles of
strictness are rows, so that several cost one plan and one placing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palisade.functions.text import NO_COUNT, lines_of, strings
from palisade.functions.versions import log_number
from palisade.lineage import cut
from palisade.operators import scan_text as T

#: What a label and its value may be apart in height, in heights of the larger.
BAND = 0.65
LABEL, IGNORED = re.compile(T.LABEL, re.I), re.compile(T.IGNORED, re.I)
# Wording in screenshots.
NOT_A_COUNT = re.compile(NO_COUNT)
DAT_LABEL = re.compile(r"(?:\b(?:amcore|a[i1l]?core)|~core)\s+content\s+versi[oc]n\b|\b(?:anti[- ]?virus\s+dat\s+version|dat\s+version)\b", re.I)
OTHER_LABEL = re.compile(r"\b(?:scan\s+engine|amcore\s+engine|engine|systemcore|mcafee\s+agent|endpoint\s+security)\s+version\b", re.I)
CONTEXT = r"last\s+(?:full\s+|quick\s+)?scan|scan\s+(?:started|stopped|comp(?:l|[\]\|i1])?ete(?:d)?|su[mn]{1,2}ary)|scan\s+date|date\s+scanned"
DECISION = r"last\s+(?:full\s+)?scan\b|scan\s+(?:comp(?:l|[\]\|i1])?ete(?:d)?|su[mn]{1,2}ary)"
NOTHING = r"\bnothing\s+found\b|\bno\s+(?:threats?|malware|infections?)\s+found\b|\b(?:detections?|threats?)\s*[:=]\s*[0o]\b"
HEADING = re.compile(r"\bmfetp\b|ods\w*[.\s_-]*activity|scan\s+(?:summary|surrary|su[mn]{1,2}ary|summ\w*)", re.I)
HEADING_WORD = re.compile(r"\bscan\b|su[mn]{1,2}ary|surrary", re.I)
MOST_PANELS = 6
UNPLACED = "A threat-count label was readable, but its value could not be associated safely."
UNSURE = "[LOW CONFIDENCE OCR]"


@dataclass
class Box:
    index: int
    text: str
    confidence: float
    left: float
    right: float
    top: float
    bottom: float

    @property
    def middle(self) -> float:
        return (self.top + self.bottom) / 2

    @property
    def height(self) -> float:
        return max(1.0, self.bottom - self.top)

    @classmethod
    def of(cls, index: int, bbox, text: str, confidence) -> Box | None:
        points = [p for p in (bbox if bbox is not None else []) if p is not None and len(p) >= 2]
        if len(points) < 2:
            return None
        xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
        return cls(index, str(text).strip(), float(confidence or 0.0), min(xs), max(xs), min(ys), max(ys))


def upper_median(values) -> float:
    values = sorted(values)
    return values[len(values) // 2]


@dataclass
class Row:
    items: list[Box]
    middle: float
    height: float

    def distance(self, box: Box) -> float | None:
        """How far the box's middle is off, if the box belongs to the row at all."""
        off, low = abs(box.middle - self.middle), min(box.height, self.height)
        shared = min(box.bottom, self.middle + self.height / 2) - max(box.top, self.middle - self.height / 2)
        return off if off <= max(3.0, 0.25 * low) or max(0.0, shared) / low >= 0.5 else None

    def add(self, box: Box) -> None:
        self.items.append(box)
        self.middle, self.height = upper_median(b.middle for b in self.items), upper_median(b.height for b in self.items)

    @property
    def text(self) -> str:
        return " ".join(b.text for b in self.items)

    @property
    def confidence(self) -> float:
        return max((b.confidence for b in self.items), default=0.0)

    def trusted(self, least: float) -> str:
        return " ".join(b.text for b in self.items if b.confidence >= least).strip()


def rows_of(boxes: list[Box]) -> list[Row]:
    """Boxes from top to bottom join the nearest of the last six rows they fit, or start one."""
    rows: list[Row] = []
    for box in sorted((b for b in boxes if b.text), key=lambda b: (b.middle, b.left)):
        near = [(d, -k) for k, row in enumerate(rows[-6:]) if (d := row.distance(box)) is not None]
        if near:
            rows[-6:][-min(near)[1]].add(box)
        else:
            rows.append(Row([box], box.middle, box.height))
    for row in rows:
        row.items.sort(key=lambda b: (b.left, b.index))
    return sorted(rows, key=lambda r: (r.middle, r.items[0].left))


def offset(value: Box, label: Box) -> tuple[float, float]:
    """How far a value is from a label: in heights, then in pixels to the right."""
    return abs(value.middle - label.middle) / max(value.height, label.height), max(0.0, value.left - label.right)


def beside(value: Box, owner: Box) -> bool:
    """Whether a value stands in an owner's band, to its right and within its reach."""
    level = abs(value.middle - owner.middle) <= BAND * max(value.height, owner.height)
    return level and value.left >= owner.right - 2 and value.left - owner.right <= max(240.0, owner.height * 20.0)


def isolated(text: str) -> int | None:
    clean = re.sub(r"^\s*[:=]?\s*|\s*$", "", text)
    return 0 if clean in ("o", "O") else int(clean) if re.fullmatch(r"\d{1,7}", clean) else None


class Places:
    """What stands beside what in an image, for all confidences: numbers and named texts by height, so that each meets its band only."""

    def __init__(self, rows: list[Row]):
        self.rows, boxes = rows, [b for row in rows for b in row.items]
        self.reach = BAND * max((b.height for b in boxes), default=0.0)
        self.numbers = sorted(((b, n) for b in boxes if (n := isolated(b.text)) is not None), key=lambda x: x[0].middle)
        named = sorted((b for b in boxes if b.confidence >= 0.25 and re.search("[A-Za-z]{3}", b.text) and not LABEL.search(b.text)), key=lambda b: b.middle)
        heights = [b.middle for b in named]
        #: How far the nearest other named text that a number stands beside is.
        self.nearest = {b.index: min((offset(b, o) for o in named[bisect_left(heights, b.middle - self.reach) : bisect_right(heights, b.middle + self.reach)] if beside(b, o)), default=None) for b, _ in self.numbers}
        self.heights = [b.middle for b, _ in self.numbers]
        self.found: dict[float, list[tuple[str, Box]]] = {}

    def belonging(self, label: Box) -> Iterator[tuple[Box, int]]:
        """Numbers beside a label that stand beside no other named text that is nearer."""
        for b, n in self.numbers[bisect_left(self.heights, label.middle - self.reach) : bisect_right(self.heights, label.middle + self.reach)]:
            if beside(b, label) and not (self.nearest[b.index] is not None and self.nearest[b.index] < offset(b, label)):
                yield b, n

    def labels(self, floor: float) -> list[tuple[str, Box]]:
        """What is said of threats in each row that counts them, and the box that says it."""
        if floor not in self.found:
            rows = [(said[1], row) for row in self.rows if (said := LABEL.search(row.trusted(floor)))]
            boxes = [(said, next((b for b in row.items if b.confidence >= floor and (LABEL.search(b.text) or re.search("d[e3]t[e3]c|infect", b.text, re.I))), row.items[-1])) for said, row in rows]
            self.found[floor] = [(said, box) for said, box in boxes if not IGNORED.search(box.text)]
        return self.found[floor]

    def empty_table(self, least: float) -> bool:
        seen = "\n".join(r.trusted(least) for r in self.rows).lower()
        return all(w in seen for w in ("clean delete", "detection name", "action taken"))


def count_at(label: Box, places: Places, least: float) -> int | None:
    """The count inside a label's own box, else the nearest number alone that belongs to the label."""
    said = LABEL.search(label.text) if label.confidence >= least else None
    tail = label.text[said.end() :] if said else ""
    n = None if NOT_A_COUNT.search(tail) else re.search(r"(?<![:\d])(\d{1,7})(?![:\d])", tail)
    if n and not re.search(r"ignatures?|\$ignatures?|extra\s*dat", tail, re.I):
        return int(n[1])
    if re.fullmatch(r"\s*[:=]?\s*[oO]\s*", tail):
        return 0
    values = [(abs(b.middle - label.middle), max(0.0, b.left - label.right), -b.confidence, b.index, n) for b, n in places.belonging(label) if b.confidence >= least]
    return min(values)[-1] if values else None


def spatial_counts(rows: list[Row], least: float, places: Places | None = None) -> tuple[float, list[tuple[str, int]], bool]:
    """(least, (label, count) of threat labels, whether some label's count is open), from text of at least this confidence."""
    places, found, unresolved = places or Places(rows), [], False
    for said, label in places.labels(min(least, 0.25)):
        n = count_at(label, places, least)
        if n is None and not places.empty_table(least):
            unresolved = True
        else:
            found.append((said, n or 0))
    return least, found, unresolved


def version_spots(boxes: list[Box], rows: list[Row], least: float) -> tuple:
    """(least, texts in version labels, (text, heights away, pixels away) of texts whose nearest label asks for a version, texts behind labels in rows, whether there is a label)."""
    labels = [(b, bool(DAT_LABEL.search(b.text))) for b in boxes if b.confidence >= least and (DAT_LABEL.search(b.text) or OTHER_LABEL.search(b.text))]
    placed = []
    for b in boxes:
        if b.confidence >= least and re.search(r"\d{4}", b.text) and not re.search(r"\b(?:engine|date|time)\b", b.text, re.I):
            near = [(*offset(b, label), k) for k, (label, _) in enumerate(labels) if b.left >= label.right - 20 and abs(b.middle - label.middle) <= max(120.0, 3.0 * max(b.height, label.height))]
            if near and labels[min(near)[2]][1]:
                placed.append((b.text, min(near)[0], b.left - labels[min(near)[2]][0].right))
    tails = [row.text[m.end() :] for row in rows if (m := DAT_LABEL.search(row.text))]
    return least, [DAT_LABEL.sub("", b.text) for b, wanted in labels if wanted], placed, tails, bool(tails) or any(wanted for _, wanted in labels)


PLACED = """image string, system string, folder string, located boolean, spoken array<struct<text:string,confidence:double>>,
rows array<struct<text:string,confidence:double,items:array<struct<text:string,confidence:double>>>>,
counts array<struct<least:double,labels:array<struct<label:string,n:int>>,unresolved:boolean>>,
spots array<struct<least:double,inline:array<string>,placed:array<struct<text:string,away:double,gap:double>>,tails:array<string>,label:boolean>>"""


def each_image(tokens: DataFrame, schema: str, read: Callable[[str, str, str, list[tuple]], list[tuple]], extra: Sequence[str] = ()) -> DataFrame:
    """Rows (schema) that read(image, system, folder, tokens) makes of each image's tokens in their order, in Arrow batches of images."""
    token = F.struct("seq", "bbox", "text", "confidence")
    images = tokens.groupBy("image").agg(*[F.first(c).alias(c) for c in extra], F.array_sort(F.collect_list(token)).alias("tokens"))
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = [(t["bbox"], t["text"] or "", 0.0 if t["confidence"] is None else t["confidence"]) for t in row["tokens"]]
                out += read(row["image"], row.get("system") or "", row.get("folder") or "", found)
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return images.mapInArrow(run, schema)


def boxes_of(tokens: list[tuple]) -> list[Box]:
    return [b for i, t in enumerate(tokens) if (b := Box.of(i, *t))]


def placed_texts(tokens: DataFrame, profiles: Sequence[T.Profile]) -> DataFrame:
    """One row an image of tokens (OCR_TOKENS, system, folder): visual rows, and what stands where beside labels at each confidence of the profiles."""
    levels, contexts = sorted({0.0} | {c for p in profiles for c in (p.positive, p.zero)}), sorted({0.0} | {p.context for p in profiles})

    def places(image: str, system: str, folder: str, found: list[tuple]) -> list[tuple]:
        boxes = boxes_of(found)
        rows = rows_of(boxes)
        said = [(r.text, float(r.confidence), [(b.text, float(b.confidence)) for b in r.items]) for r in rows]
        where = Places(rows)
        counts = [spatial_counts(rows, c, where) for c in levels]
        spots = [version_spots(boxes, rows, c) for c in contexts]
        return [(image, system, folder, len(boxes) == len(found), [(str(t), float(c or 0.0)) for _, t, c in found], said, counts, spots)]

    return each_image(tokens, PLACED, places, ["system", "folder"])


class ProfileColumns:
    """The profile of a row: its fields as columns."""

    FIELDS = ("name", "metadata", "positive", "context", "zero", "lenient")

    def __getattr__(self, field: str) -> Column:
        return F.col(f"p.{field}")


P = ProfileColumns()


def by_profile(placed: DataFrame, profiles: Sequence[T.Profile]) -> DataFrame:
    """Each image once for each profile (p), with its name (strictness)."""
    rows = [F.struct(*[F.lit(getattr(p, f)).alias(f) for f in P.FIELDS]) for p in profiles]
    return placed.withColumn("p", F.explode(F.array(*rows))).withColumn("strictness", P.name)


def trusted_text(items: Column, least: Column) -> Column:
    return F.array_join(F.transform(F.filter(items, lambda b: b["confidence"] >= least), lambda b: b["text"]), " ")


def spoken_lines(placed: DataFrame, profiles: Sequence[T.Profile]) -> DataFrame:
    """image, strictness, pass, n, line, system, folder: the lines of raw texts (of no strictness) and of each profile's trusted and, where nothing has a place, strong and zero texts."""
    keep = ["image", "strictness", "system", "folder"]
    told = by_profile(placed, profiles)
    flat = told.where(F.size("rows") == 0)
    texts = lambda tokens: F.array_join(F.transform(tokens, lambda t: t["text"]), "\n")
    least = lambda r: F.when(T.likes(r["text"], CONTEXT) & (r["confidence"] >= P.context), P.context).otherwise(P.metadata)
    raw = placed.withColumn("strictness", F.lit("")).select(*keep, F.lit("raw").alias("pass"), texts(F.when(F.size("rows") > 0, F.transform("rows", lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence")))).otherwise(F.col("spoken"))).alias("text"))
    sure = told.where(F.size("rows") > 0).select(*keep, F.lit("trusted").alias("pass"), F.array_join(F.transform("rows", lambda r: trusted_text(r["items"], least(r))), "\n").alias("text"))
    at = lambda name, c: flat.select(*keep, F.lit(name).alias("pass"), texts(F.filter("spoken", lambda t: t["confidence"] >= c)).alias("text"))
    whole = raw.unionByName(sure).unionByName(at("strong", P.positive)).unionByName(at("zero", P.zero))
    whole = whole.select(*keep, "pass", F.posexplode(lines_of(F.col("text"))).alias("n", "line"))
    # without places: strong texts, and those around a marker, with the gaps between them kept
    said = flat.select(*keep, "p", F.posexplode("spoken").alias("i", "t")).select(*keep, "p", "i", F.col("t.text").alias("text"), F.col("t.confidence").alias("c"))
    inside = Window.partitionBy("image", "strictness").orderBy("i")
    marked = F.max((F.col("c") >= P.context) & T.likes(F.col("text"), CONTEXT)).over(inside.rowsBetween(-T.NEAR, T.NEAR))
    said = said.withColumn("near", marked).withColumn("sure", (F.col("c") >= P.metadata) | F.col("near") & (F.col("c") >= P.context)).where("sure or near")
    line = F.when(F.col("sure"), F.col("text")).otherwise(UNSURE)
    gap = F.lag("i").over(inside) < F.col("i") - 1
    around = said.withColumn("lines", F.when(gap, F.array(F.lit(T.GAP), line)).otherwise(F.array(line))).select(*keep, F.lit("trusted").alias("pass"), "i", F.posexplode("lines").alias("k", "line"))
    around = around.select(*keep, "pass", (2 * F.col("i") + F.col("k")).alias("n"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where("line <> ''")
    return whole.unionByName(around)


def placed_version(spot: Column) -> Column:
    """The version in a label's box, else of the best placed text, else behind a label in its row; '' without."""
    versions = lambda texts: F.filter(F.transform(texts, lambda t: T.clean_version(t)), lambda v: v != "")
    n = lambda v: v.try_cast("double")
    ranked = F.transform(spot["placed"], lambda p: F.struct(T.clean_version(p["text"]).alias("v"), p["away"].alias("away"), p["gap"].alias("gap")))
    ranked = F.transform(F.filter(ranked, lambda p: p["v"] != ""), lambda p: F.struct((~n(p["v"]).between(4000, 40000)).alias("odd"), (~F.contains(p["v"], F.lit("."))).alias("whole"), p["away"], p["gap"], p["v"].alias("v")))
    return F.coalesce(F.get(versions(spot["inline"]), F.lit(0)), F.array_min(ranked)["v"], F.get(versions(spot["tails"]), F.lit(0)), F.lit(""))


def plausible(dat: Column) -> Column:
    n = log_number(dat)
    return F.when(n.between(1900, 2100) | (n > 50000), "Unknown").otherwise(dat)


def audits(tokens: DataFrame, strictness: str | Sequence[str] = "high", thresholds: dict[str, float] | None = None, zero: float = 0.0) -> DataFrame:
    """One row an image of tokens (OCR_TOKENS, system, folder) and strictness: verdict, metadata, candidates, reasons.

    Three passes read threats: everything for candidates, strong text for positives,
    text of the zero confidence for zeros. Only a placed, strong count is a threat;
    weaker signs are reasons for a person to look.
    """
    profiles = [T.Profile.of(s, zero) for s in ([strictness] if isinstance(strictness, str) else strictness)]
    p, limits = P, dict(thresholds or {})
    placed = cut(placed_texts(tokens, profiles))  # read by every pass
    fields = ["product", "times", "threats", "flags", "known", "open", "dat_version", "last_scan"]
    said = cut(T.readings(spoken_lines(placed, profiles), ["image", "strictness", "pass"]).select("image", "strictness", "pass", F.struct(*fields).alias("said")))
    raw = said.where(F.col("pass") == "raw").select("image", F.col("said").alias("raw"))
    own = said.where(F.col("pass") != "raw").groupBy("image", "strictness").agg(*[F.first(F.when(F.col("pass") == k, F.col("said")), ignorenulls=True).alias(k) for k in ("trusted", "strong", "zero")])
    df = by_profile(placed.join(raw, "image", "left"), profiles).join(own, ["image", "strictness"], "left").withColumn("spatial", F.size("rows") > 0)
    at = lambda column, level: F.get(F.filter(column, lambda c: c["least"] == level), F.lit(0))
    none = strings().cast("array<string>")

    def read(k: str, level: Column) -> Column:
        """struct(threats, flags, result) of a pass, placed (the counts of a level) or, where nothing has a place, plain (column k)."""
        c = at("counts", level)
        seen = F.array_join(F.transform("rows", lambda r: trusted_text(r["items"], level)), "\n")
        known = T.likes(seen, NOTHING) | (F.size(c["labels"]) > 0)
        threats = F.array_distinct(F.transform(F.filter(c["labels"], lambda x: x["n"] > 0), lambda x: F.concat(x["label"], F.lit(": "), x["n"].cast("string"))))
        flags = F.when(c["unresolved"] & ~known, strings(UNPLACED)).otherwise(none)
        here = F.struct(threats.alias("threats"), flags.alias("flags"), T.result_of(threats, flags, known, c["unresolved"]).alias("result"))
        plain = [F.coalesce(F.col(f"{k}.threats"), none), F.coalesce(F.col(f"{k}.flags"), none), F.coalesce(F.col(f"{k}.known"), F.lit(False)), F.coalesce(F.col(f"{k}.open"), F.lit(False))]
        there = F.struct(plain[0].alias("threats"), plain[1].alias("flags"), T.result_of(*plain).alias("result"))
        return F.when(F.col("spatial"), here).otherwise(there)

    keyword = lambda x: F.startswith(x, F.lit(T.KEYWORD))
    df = df.withColumns({"weak": read("raw", F.lit(0.0)), "sure": read("strong", p.positive), "least": read("zero", p.zero)})
    result = F.when((F.col("sure.result") != T.POSITIVE) & (F.col("least.result") == T.ZERO), T.ZERO).otherwise(F.col("sure.result"))
    plain_keywords = F.when(F.col("spatial"), F.filter(F.coalesce("raw.threats", none), keyword)).otherwise(none)
    df = df.withColumns({"result": result, "candidates": F.concat("weak.threats", plain_keywords), "found": F.filter("sure.threats", lambda x: ~keyword(x))})
    told = lambda text, xs: F.transform(xs, lambda x: F.concat(F.lit(text), x))
    flags = F.array_distinct(F.concat(
        "weak.flags", F.filter("sure.flags", lambda f: (F.col("result") != T.ZERO) | (f != UNPLACED)),
        told("Keyword-only possible threat requires review: ", F.filter("candidates", keyword)),
        told("Low-confidence possible threat requires review: ", F.array_except(F.filter("candidates", lambda x: ~keyword(x)), "found")),
    ))
    unread = F.when((F.size("found") == 0) & (F.col("result") != T.ZERO), strings("No explicit, resolved zero-threat outcome was extracted.")).otherwise(none)
    df = df.withColumn("flags", F.concat(flags, unread))
    # the version: what stands beside a label goes before what the lines say
    system, low, high = F.col("system"), at("spots", F.lit(0.0)), at("spots", p.context)
    by_place = F.col("spatial") & (system != "RADIO")
    labelled = low["label"] | high["label"]
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    df = df.withColumn("value", F.when(by_place, placed_version(high)).otherwise(""))
    dat = F.when(F.col("value") != "", F.col("value")).when(by_place & labelled, "Unknown").otherwise(unknown(F.col("trusted.dat_version")))
    raw_dat = F.when(by_place & low["label"], F.coalesce(F.nullif(placed_version(low), F.lit("")), F.lit("Unknown"))).otherwise(unknown(F.col("raw.dat_version")))
    product = F.coalesce("trusted.product", T.product_of(system, F.lit("")))
    df = df.withColumns({"dat": F.when(by_place, plausible(dat)).otherwise(dat), "raw_dat": F.when(by_place, plausible(raw_dat)).otherwise(raw_dat), "product": F.when(by_place & (product == "clamwin"), "mcafee").otherwise(product)})
    # the time: repeated three times beside a trusted marker it is the scan's; a weak last marker makes it unknown
    times = F.coalesce("raw.times", none)
    marker = lambda text: F.when(system == "RADIO", T.likes(text, r"scan\s+started")).otherwise(T.likes(text, DECISION))
    spoken = F.when(F.col("spatial"), F.transform("rows", lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence")))).otherwise(F.col("spoken"))
    df = df.withColumns({"seen": times, "marks": F.transform(F.filter(spoken, lambda t: marker(t["text"])), lambda t: t["confidence"])})
    repeated = F.array_max(F.filter(F.array_distinct("seen"), lambda t: F.size(F.filter("seen", lambda x: x == t)) >= 3))
    agreed = F.when(F.array_max("marks") >= p.context, repeated)
    weak_mark = agreed.isNull() & (F.element_at(F.concat("marks", F.array(F.lit(1.0))), F.greatest(F.size("marks"), F.lit(1))) < p.context) & (F.size("marks") > 0)
    last = F.coalesce(agreed, F.when(weak_mark, "Unknown"), unknown(F.col("trusted.last_scan")))
    df = df.withColumns({"agreed": agreed, "weak_mark": F.coalesce(weak_mark, F.lit(False)), "last": last})
    date_candidate = F.when((F.col("last") == "Unknown") & (F.size("seen") > 0), F.array_max("seen"))
    counted = F.coalesce(date_candidate, "agreed")
    updated = F.startswith("dat", F.lit("Updated:")) & log_number(F.col("dat")).isNull()
    reason = lambda when, text: F.when(when, strings(text)).otherwise(none)
    reasons = F.concat(
        "flags",
        reason(updated, "A ClamWin update date was found, but the numeric daily signature version was unreadable."),
        reason((F.col("dat") == "Unknown") & (F.col("raw_dat") != "Unknown"), "DAT version was found in lower-confidence OCR and needs confirmation."),
        reason((F.col("dat") == "Unknown") & (F.col("raw_dat") == "Unknown"), "No confirmed DAT/signature version was extracted."),
        reason(F.col("weak_mark"), "The latest scan event label has low OCR confidence."),
        reason(date_candidate.isNotNull(), "A valid date was found, but it could not be confirmed as the completed scan time."),
        reason((F.col("last") == "Unknown") & (F.size("seen") == 0), "No calendar-valid completed-scan timestamp was extracted."),
    )
    clean = p.lenient | (F.col("result") == T.ZERO) & (F.size("flags") == 0)
    status = F.when(F.size("found") > 0, "Threats Found").when(clean & ~updated & ~F.col("weak_mark"), "Clean").otherwise("Manual Verification Needed")
    return df.select(
        "image", "strictness", T.with_evidence(status, F.col("last"), F.col("dat"), p).alias("status"), F.col("dat").alias("dat_version"), F.col("last").alias("last_scan"),
        T.is_outdated(F.col("dat"), F.col("product"), limits).alias("outdated"),
        F.when((F.col("dat") == "Unknown") & (F.col("raw_dat") != "Unknown"), F.col("raw_dat")).otherwise("").alias("dat_candidate"), F.coalesce(date_candidate, F.lit("")).alias("date_candidate"),
        F.when(counted.isNotNull(), F.size(F.filter("seen", lambda x: x == counted))).otherwise(0).alias("date_count"), F.col("result").alias("threat_result"), F.col("weak.result").alias("candidate_result"), reasons.alias("reasons"),
        (F.col("located") & (F.size("spoken") > 0) & F.forall("spoken", lambda t: t["confidence"] >= p.metadata)).alias("strong"),
    )


def complete() -> Column:
    """Of audits(): whether every token is strong and placed and every field settled without a reason left."""
    settled = (F.col("threat_result") != T.UNKNOWN) & (F.col("dat_version") != "Unknown") & (F.col("last_scan") != "Unknown")
    return F.col("strong") & settled & (F.col("dat_candidate") == "") & (F.col("date_candidate") == "") & (F.size("reasons") == 0)


def usable(tokens: Column) -> Column:
    """Whether cached tokens can be placed: all have a box, or there are none."""
    return F.forall(tokens, lambda t: t["bbox"].isNotNull())


def visual_rows(tokens: DataFrame) -> DataFrame:
    """image, row_no, text, n_items, middle, height."""

    def rows(image: str, system: str, folder: str, found: list[tuple]) -> list[tuple]:
        return [(image, i, r.text, len(r.items), float(r.middle), float(r.height)) for i, r in enumerate(rows_of(boxes_of(found)))]

    return each_image(tokens, "image string, row_no int, text string, n_items int, middle double, height double", rows)


def panel(boxes: list[Box], anchors: list[Box], height: float) -> tuple[int, int]:
    """Left and right bound of the text group around a row's anchors: it takes in what is near on its level until nothing more is, then gets a margin."""
    near, taken = max(18.0, 4.0 * height), list(anchors)
    waiting = [b for b in boxes if all(b is not a for a in anchors)]
    while True:
        left, right, level = min(b.left for b in taken), max(b.right for b in taken), upper_median(b.middle for b in taken)
        joins = [b for b in waiting if abs(b.middle - level) <= BAND * max(b.height, height) and max(left - b.right, b.left - right, 0.0) <= near]
        if not joins:
            break
        taken += joins
        waiting = [b for b in waiting if all(b is not j for j in joins)]
    margin = max(8.0, 1.5 * height)
    return max(0, round(left - margin)), round(right + margin)


def panels_of(rows: list[Row]) -> list[tuple[int, int, int, int, int]]:
    """left, top, right, bottom, line height of the panels that may hold result rows: around summary headings of images without a readable threat label."""
    if any(LABEL.search(b.text) for row in rows for b in row.items):
        return []
    found, levels = [], set()
    for row in rows:
        anchors = [b for b in row.items if HEADING.search(b.text) or HEADING_WORD.search(b.text)] if HEADING.search(row.text) else []
        if not anchors:
            continue
        widest = max(anchors, key=lambda b: b.right - b.left)
        height = max(6.0, widest.height)
        level = round(widest.middle / max(4.0, height / 2.0))
        if level in levels:  # the same line of text, cut in two
            continue
        levels.add(level)
        left, right = panel(row.items, anchors, height)
        top, bottom = max(0, round(widest.top - 0.5 * height)), round(widest.bottom + 3.5 * height)
        if right > left and bottom > top:
            found.append((left, top, right, bottom, round(height)))
    return found[:MOST_PANELS]


def panels(tokens: DataFrame) -> DataFrame:
    """image, panel_no, x0, y0, x1, y1, height: where a recogniser should look again for result rows (at most MOST_PANELS an image, the feature)."""

    def group(image: str, system: str, folder: str, found: list[tuple]) -> list[tuple]:
        return [(image, i, *p) for i, p in enumerate(panels_of(rows_of(boxes_of(found))))]

    return each_image(tokens, "image string, panel_no int, x0 int, y0 int, x1 int, y1 int, height int", group)


def timestamp_consensus(rows: DataFrame) -> DataFrame:
    """image, agreed: the latest time that three or more rows (image, time) show."""
    counts = rows.where("time is not null and time <> ''").groupBy("image", "time").agg(F.count("*").alias("n"))
    return counts.groupBy("image").agg(F.max(F.when(F.col("n") >= 3, F.col("time"))).alias("agreed"))
