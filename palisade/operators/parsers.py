"""Parsers: files of one vendor to rows of scan runs, without a shuffle.

Each takes files (source_id, text, and mtime where a file's time can stand in)
and returns SCAN_RUN rows. Segments and rows are arrays inside the file's row
until the last step, so a file is parsed where it was read. Numbers that a log
does not state are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import dates
from palisade.functions.text import collapsed, described, first_group, labelled_int, labelled_ints, lines_of, no_text, shortened, to_long
from palisade.schemas import SCAN_RUN_FIELDS

# Patterns, labels, statuses and messages below are fixed values of the log formats and of the run table.
PARSER_VERSION = "structured-v2"
DETECTED, CLEAN, WARNED, REVIEW = "Completed with detections", "Completed clean", "Completed with warnings", "Requires review"
MTIME_USED = "No scan timestamp was present; file modification time was used as a fallback."


def run_rows(df: DataFrame, vendor: str, **cols: Column) -> DataFrame:
    """SCAN_RUN rows from df (source_id, run_index) and the given columns; the id is a hash of what identifies the run."""
    empty = F.array().cast("array<string>")
    values = {name: F.lit(None) for name, _ in SCAN_RUN_FIELDS} | {"timestamp_source": F.lit("log_content"), "normalized_status": F.lit(REVIEW), "threat_names": empty, "detection_actions": empty, "warnings": empty} | cols
    values["endpoint"] = F.coalesce(no_text(values["endpoint"].cast("string")), F.lit("Unknown"))
    values["warnings"] = F.array_distinct(F.filter(values["warnings"], lambda w: w.isNotNull()))
    done = F.coalesce(dates.iso(values["scan_completion_time"].cast("timestamp_ntz")), dates.iso(values["scan_start_time"].cast("timestamp_ntz")), F.lit(""))
    seed = F.concat_ws(":", F.col("source_id"), F.lit(PARSER_VERSION), F.lit(vendor), values["endpoint"], done, F.col("run_index").cast("string"))
    values |= {"scan_run_id": F.substring(F.sha2(seed, 256), 1, 24), "source_file_id": F.col("source_id"), "run_index": F.col("run_index"), "vendor": F.lit(vendor), "parser_version": F.lit(PARSER_VERSION)}
    return df.select(*[values[name].cast(kind).alias(name) for name, kind in SCAN_RUN_FIELDS])


def warn(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


def outcome(threats: Column) -> Column:
    return F.when(threats > 0, DETECTED).otherwise(CLEAN)


def epo_rows(files: DataFrame) -> DataFrame:
    """Scan metadata rows of a properties report: one run a row, whose threats are unknown."""
    low = F.lower(F.col("text"))
    files = files.where(F.contains(low, F.lit("on-demand full scan date")) & F.contains(low, F.lit("amcore content version")) & F.contains(low, F.lit("system name")))
    row = r"(?i)^([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s+[AP]M)\s+([0-9]+(?:\.[0-9]+)?)\s+(<\s*1|[0-9]+(?:\.[0-9]+)?\+?)\s+([A-Z0-9][A-Z0-9_-]{1,})$"
    found = files.select("source_id", F.posexplode(F.filter(lines_of(F.col("text")), lambda line: F.rlike(line, F.lit(row)))).alias("run_index", "line"))
    part = lambda i: F.regexp_extract("line", row, i)
    hours = F.regexp_replace(part(3), r"[\s+]", "")
    return run_rows(
        found,
        "trellix_mcafee",
        endpoint=F.upper(part(4)),
        scan_type=F.lit("On-Demand Full Scan"),
        scan_completion_time=dates.vendor_datetime(part(1)),
        scan_duration_seconds=F.when(F.startswith(hours, F.lit("<")), 1800).otherwise((hours.try_cast("double") * 3600).cast("bigint")),
        timestamp_source=F.lit("report_scan_date"),
        original_status=F.lit("Listed in completed-scan report"),
        definition_version=F.when(part(2).try_cast("double").between(1000, 100000), part(2)),
        warnings=F.array(F.lit("The ePO properties report contains scan metadata but no detection-result field.")),
    )


def epo_threat_total(files: DataFrame) -> DataFrame:
    """The total of a threat-event report decides its single run."""
    text = F.col("text")
    files = files.where(F.rlike(text, F.lit(r"(?i)\bnumber of threat events\b"))).withColumn("total", to_long(first_group(text, r"(?i)\btotal\s+([0-9][0-9,]*)\b"))).where("total is not null")
    files = files.withColumn("done", dates.vendor_datetime(F.try_element_at(dates.dates_in(text), F.lit(-1)))).withColumn("run_index", F.lit(0))
    dated = F.col("done").isNotNull()
    return run_rows(
        files,
        "trellix_mcafee",
        scan_type=F.lit("ePO threat-event report"),
        scan_completion_time=F.col("done"),
        timestamp_source=F.when(dated, "report_generated_time").otherwise("unknown"),
        normalized_status=outcome(F.col("total")),
        original_status=F.lit("ePO threat event total"),
        threats_detected=F.col("total"),
        result_basis=F.lit("epo_threat_event_total"),
        warnings=F.array(warn(~dated, "The ePO threat-event total had no report timestamp.")),
    )


#: Labels of detection counts in activity logs.
THREAT_LABELS = (
    "files? with detections", "file detections", "processes detected", "boot sectors detected", "registry detections", "keys detected",
    "memory detections", "cookies detected", "threats? detected", "infected files?", "detections",
)
NOTHING = r"(?i)\bnothing found\b|\bno (?:threats?|viruses|infected files?) (?:were )?(?:detected|found)\b|\bdetections\s*(?::|=|-)?\s*0\b"
COMPLETE = r"(?i)\bscan complete(?:d)?\b"
CUT = "\x01"


def activity_segments(files: DataFrame) -> DataFrame:
    """source_id, run_index, chunk, text: the lines up to each completion line since the one before; later lines are dropped."""
    plain = F.replace(F.col("text"), F.lit(CUT), F.lit(" "))
    done = lambda line: F.rlike(line, F.lit(COMPLETE)) & F.rlike(line, F.lit(dates.DATE_IN_TEXT))
    marked = F.transform(lines_of(plain), lambda line: F.when(done(line), F.concat(line, F.lit(CUT))).otherwise(line))
    parts = F.split(F.array_join(marked, "\n"), CUT, -1)
    chunks = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda c: F.regexp_replace(c, "^\n", ""))
    return files.select("source_id", "text", F.posexplode(chunks).alias("run_index", "chunk"))


def activity_runs(files: DataFrame) -> DataFrame:
    """Activity logs: one run for each completion line."""
    text = F.col("text")
    product = F.rlike(text, F.lit(r"(?i)\b(?:mcafee|trellix)\b")) & F.rlike(text, F.lit(COMPLETE))
    df = activity_segments(files.where(F.rlike(text, F.lit(r"(?i)ods\.activity|scan summary|virus\s*scan enterprise")) | product))
    chunk = F.col("chunk")
    df = df.withColumn("line", F.element_at(F.split(chunk, "\n"), -1)).withColumn("tail", F.trim(F.regexp_extract("line", r"(?i)^.*?scan complete(?:d)?(.*)$", 1)))
    tail = F.col("tail")
    host = F.coalesce(first_group(tail, r"(?:[A-Za-z0-9_.-]+\\)?([A-Za-z0-9_-]+)\$(?:\s|$)"), first_group(tail, r"(?i)([A-Za-z0-9_-]+)\\(?:Administrator|SYSTEM|[^\\\s]+)"), F.lit("Unknown"))
    counts = labelled_ints(chunk, *THREAT_LABELS)
    df = df.withColumn("threats", F.when(F.size(counts) > 0, F.array_max(counts)).when(F.rlike(chunk, F.lit(NOTHING)), 0)).withColumn("skipped", labelled_int(chunk, "files? not scanned", "objects? skipped"))
    threats, skipped = F.col("threats"), F.col("skipped")
    warned = (skipped > 0) | threats.isNull()
    return run_rows(
        df,
        "trellix_mcafee",
        endpoint=F.upper(host),
        scan_type=F.coalesce(F.initcap(first_group(tail, r"(?i)\b(full scan|quick scan|targeted scan)\b")), F.lit("On-Demand Scan")),
        scan_completion_time=dates.vendor_datetime(dates.first_in_text(F.col("line"))),
        scan_duration_seconds=dates.duration_seconds(first_group(tail, r"\(([0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?)\)\s*$")),
        normalized_status=F.when(threats > 0, DETECTED).when(warned, WARNED).otherwise(CLEAN),
        original_status=F.lit("Scan Complete"),
        files_scanned=labelled_int(chunk, "files? scanned", "items? scanned"),
        files_skipped=skipped,
        threats_detected=threats,
        definition_version=first_group(F.col("text"), r"(?i)(?:anti[- ]?virus\s+dat|dat|amcore\s+content)\s+version\s*[:=]\s*([0-9]+(?:\.[0-9]+)*)"),
        engine_version=first_group(F.col("text"), r"(?i)(?:scan\s+)?engine\s+version(?:\s*\([^)]*\))?\s*[:=]\s*([0-9]+(?:\.[0-9]+)+)"),
        warnings=F.array(warn(skipped > 0, F.concat(skipped.cast("string"), F.lit(" files or objects were not scanned."))), warn(threats.isNull(), "No contextual numeric detection result was found in the completed summary.")),
    )


SCAN_STARTED = r"Scan\s+Started\s+\w+\s+\w+\s+[0-9]{1,2}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s+[0-9]{4}"
INFECTED = "infected files?"


def block_runs(files: DataFrame) -> DataFrame:
    """Concatenated logs: one run for each started block with a summary and an infected count; without any header the whole text is one."""
    text = F.col("text")
    files = files.where(F.rlike(text, F.lit(r"(?i)\bscan summary\b")))
    headed = F.rlike(text, F.lit(f"(?i){SCAN_STARTED}"))
    counted = lambda b: labelled_int(b, INFECTED).isNotNull()
    done = lambda b: F.rlike(b, F.lit(f"(?i)^{SCAN_STARTED}")) & F.rlike(b, F.lit(r"-+\s*SCAN SUMMARY\s*-+")) & counted(b)
    blocks = F.when(headed, F.filter(F.split(text, f"(?i)(?={SCAN_STARTED})"), done)).otherwise(F.filter(F.array(text), counted))
    df = files.select("source_id", "mtime", F.posexplode(blocks).alias("run_index", "block"))
    block = F.col("block")
    df = df.withColumn("done", dates.ctime(first_group(block, r"(?i)^Scan\s+Started\s+(\w+\s+\w+\s+[0-9]{1,2}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s+[0-9]{4})"))).withColumn("infected", labelled_int(block, INFECTED))
    dated = F.col("done").isNotNull()
    return run_rows(
        df,
        "clamwin",
        scan_type=F.lit("ClamWin scan"),
        scan_completion_time=F.coalesce("done", F.col("mtime").cast("timestamp_ntz")),
        timestamp_source=F.when(dated, "log_content").otherwise("file_mtime_fallback"),
        normalized_status=outcome(F.col("infected")),
        original_status=F.lit("Completed"),
        files_scanned=labelled_int(block, "scanned files"),
        threats_detected=F.col("infected"),
        definition_version=labelled_int(block, "known viruses").cast("string"),
        engine_version=first_group(block, r"(?i)\bengine version\s*:\s*([0-9.]+)"),
        warnings=F.array(warn(~dated, MTIME_USED)),
    )


def symantec_runs(files: DataFrame) -> DataFrame:
    """One run from the product's name and a risk count."""
    text = F.col("text")
    files = files.where(F.rlike(text, F.lit("(?i)symantec|endpoint protection"))).withColumn("threats", labelled_int(text, "total risks? detected", "risks? found", INFECTED)).where("threats is not null").withColumn("run_index", F.lit(0))
    last = F.try_element_at(dates.dates_in(text), F.lit(-1))
    return run_rows(
        files,
        "symantec",
        scan_type=F.lit("Symantec scan"),
        scan_completion_time=F.when(last.isNotNull(), dates.vendor_datetime(last)).otherwise(F.col("mtime").cast("timestamp_ntz")),
        timestamp_source=F.when(last.isNotNull(), "log_content").otherwise("file_mtime_fallback"),
        normalized_status=outcome(F.col("threats")),
        threats_detected=F.col("threats"),
        definition_version=first_group(text, r"(?i)(?:virus definitions?|definitions?)\s*[:=]\s*([0-9./-]+)"),
        warnings=F.array(warn(last.isNull(), "File modification time was used because no scan timestamp was present.")),
    )


COMPLETED_EVENTS = ("manual malware scan completed", "anti-malware scan completed", "scheduled malware scan completed")
#: Only names of detection events are findings; descriptions of rules speak of malware too.
POSITIVE_EVENT = r"(?i)\A(?:(?:anti-)?(?:malware|virus|threat)(?:/spyware)?\s+(?:detected|found)|infected file|malware detection)\z"


def is_completed(event: Column) -> Column:
    return F.lower(F.trim(event)).isin(*COMPLETED_EVENTS)


def is_positive(event: Column) -> Column:
    return F.rlike(F.trim(event), F.lit(POSITIVE_EVENT))


def target_key(target: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(target, r"\s*\([^)]*\)\s*$", "")))


def event_runs(rows: DataFrame) -> DataFrame:
    """System-event exports: every completed scan joined to all findings of its target, at any time.

    rows: source_id, row_no, fields map<string,string>. Findings are gathered by
    (file, target) before the join, so a target with many of each is never multiplied out.
    """
    field = lambda name: F.coalesce(F.col("fields").getItem(name), F.lit(""))
    rows = rows.select("source_id", "row_no", *[field(n).alias(n.lower().replace(" ", "_")) for n in ("Time", "Level", "Event ID", "Event", "Event Origin", "Target", "Manager", "Description")]).withColumn("target_key", target_key(F.col("target")))
    findings = rows.where(is_positive(F.col("event"))).groupBy("source_id", "target_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "event"))), lambda x: x["event"]).alias("findings"))
    done = rows.where(is_completed(F.col("event")))
    df = done.join(findings, ["source_id", "target_key"], "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
    order = F.transform(F.array_sort(F.collect_list("row_no")), lambda x: x)
    numbers = done.groupBy("source_id").agg(order.alias("order")).select("source_id", F.posexplode("order").alias("run_index", "row_no"))
    df = df.join(numbers, ["source_id", "row_no"])
    text = F.col("description")
    df = df.withColumn("explicit", labelled_int(text, "threats? detected", "malware detected", "malware found", INFECTED, "virus(?:es)? detected", "detections"))
    threats = F.coalesce("explicit", F.size("findings").cast("bigint"))
    return run_rows(
        df,
        "trend_micro",
        endpoint=F.trim(F.regexp_replace(F.coalesce(no_text(F.col("target")), F.col("manager")), r"\s*\([^)]*\)\s*$", "")),
        scan_type=F.coalesce(no_text(described(text, "Scan Type")), F.lit("Manual Malware Scan")),
        scan_completion_time=dates.vendor_datetime(F.coalesce(no_text(described(text, "Time")), F.col("time"))),
        scan_duration_seconds=labelled_int(text, "scan time"),
        normalized_status=outcome(threats),
        original_status=F.col("event"),
        files_scanned=labelled_int(text, "number of files scanned", "files scanned"),
        threats_detected=threats,
        threat_names=F.col("findings"),
        source_event_id=F.coalesce(no_text(F.col("event_id")), described(text, "Event ID")),
        source_level=F.coalesce(no_text(F.col("level")), described(text, "Level")),
        source_event_origin=F.col("event_origin"),
        description_summary=shortened(collapsed(text), 1000),
        result_basis=F.when(F.col("explicit").isNotNull(), "explicit_detection_count").when(F.size("findings") > 0, "trend_csv_detection_events").otherwise("trend_csv_no_detection_events"),
    )


def generic_csv_runs(rows: DataFrame) -> DataFrame:
    """Completed-scan exports: a row counts if its status says complete and its infected count is there."""
    low = F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))
    rows = rows.withColumn("low", low)
    field = lambda name: F.coalesce(F.col("low").getItem(name), F.lit(""))
    count = lambda name: to_long(first_group(field(name), r"^\s*(?::|=|-)?\s*([0-9][0-9,]*)"))
    df = rows.where(F.rlike(field("status"), F.lit(r"(?i)\b(?:scan )?complete(?:d)?\b"))).withColumn("infected", count("infected")).where("infected is not null")
    numbers = df.groupBy("source_id").agg(F.array_sort(F.collect_list("row_no")).alias("order")).select("source_id", F.posexplode("order").alias("run_index", "row_no"))
    df = df.join(numbers, ["source_id", "row_no"])
    done = dates.vendor_datetime(field("completed"))
    return run_rows(
        df,
        "generic_antivirus",
        endpoint=field("computer"),
        scan_type=F.coalesce(no_text(field("logged by")), F.lit("Antivirus scan")),
        scan_start_time=dates.vendor_datetime(field("started on")),
        scan_completion_time=done,
        timestamp_source=F.when(done.isNotNull(), "csv_completed_time").otherwise("unknown"),
        normalized_status=outcome(F.col("infected")),
        original_status=field("status"),
        files_scanned=count("total files"),
        threats_detected=F.col("infected"),
        result_basis=F.lit("generic_csv_infected_count"),
        warnings=F.array(warn(done.isNull(), "Completed-scan CSV row had no valid completion timestamp.")),
    )


def pdf_system_rows(files: DataFrame) -> DataFrame:
    """source_id, name, dat_version, last_scan of consolidated reports; the first row of a name wins."""
    date, name, dat = r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s+[AP]M)", r"([A-Z0-9][A-Z0-9_-]{1,}(?:-[A-Z0-9_-]+)?)", r"([456789][0-9]{3}\.[0-9]+)"
    one, two = rf"(?i){date}\s+{name}\s+{dat}", rf"(?i){date}\s+{dat}\s+(?:<\s*)?[0-9]+(?:\.[0-9]+)?\s+{name}"
    word = lambda n: ~F.lower(n).isin("page", "total", "date", "system")
    get = lambda line, p, i: F.regexp_extract(line, p, i)

    def parsed(line: Column) -> Column:
        row = lambda p, n, v: F.struct(get(line, p, n).alias("name"), get(line, p, v).alias("dat_version"), get(line, p, 1).alias("last_scan"))
        first, second = F.rlike(line, F.lit(one)) & word(get(line, one, 2)), F.rlike(line, F.lit(two)) & word(get(line, two, 3))
        return F.when(first, row(one, 2, 3)).when(second, row(two, 3, 2))

    rows = files.select("source_id", F.posexplode(F.transform(lines_of(F.col("text")), parsed)).alias("line_no", "r")).where("r is not null")
    firsts = rows.groupBy("source_id", F.col("r.name").alias("name")).agg(F.min(F.struct("line_no", "r")).alias("first"))
    return firsts.select("source_id", "name", F.col("first.line_no").alias("line_no"), F.col("first.r.dat_version").alias("dat_version"), dates.vendor_datetime(F.col("first.r.last_scan")).alias("last_scan"))
