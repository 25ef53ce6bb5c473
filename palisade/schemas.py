"""Schemas of the tables that plans hand to each other."""

from __future__ import annotations

EVIDENCE = "path string, modificationTime timestamp, length long, content binary"
#: The fact table. threats_detected stays NULL where a log asserts nothing: unknown never means clean.
SCAN_RUN = (
    "scan_run_id string, source_file_id string, run_index int, vendor string, endpoint string, system_id string, scan_type string, "
    "scan_start_time timestamp_ntz, scan_completion_time timestamp_ntz, scan_duration_seconds bigint, timestamp_source string, "
    "normalized_status string, original_status string, files_scanned bigint, files_skipped bigint, threats_detected bigint, "
    "threats_remediated bigint, threat_names array<string>, detection_actions array<string>, definition_version string, "
    "engine_version string, source_event_id string, source_level string, source_event_origin string, description_summary string, "
    "result_basis string, warnings array<string>, parser_version string"
)
SCAN_RUN_FIELDS = [tuple(f.strip().split(" ", 1)) for f in SCAN_RUN.split(",")]
CHECKLIST_ROW = (
    "id string, sheet string, row int, sheet_pos int, system string, location string, item string, pc_name string, dat_version string, date_scan string, "
    "scan_done string, virus_found string, screenshot_upload string, done_by string, endorsed_by string, av_software string, "
    "time_scanning string, remarks string, lookup string, tokens array<string>"
)
OCR_TOKENS = "image string, seq int, bbox array<array<double>>, text string, confidence double"
AUDIT = "ts timestamp, event string, actor string, details map<string,string>"
