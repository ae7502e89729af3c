"""Explicit schemas: nothing is inferred."""

ARCHIVE = "archive_id long, upload_id string, line_id string, station_id string, device_id string, collector_id string, work_order string, product_sn string, file_type string, result string, original_filename string, relative_path string, file_size long, file_sha256 string, produced_at timestamp, archived_at timestamp"
LINE = "line_id string, line_name string, enabled boolean"
STATION = "station_id string, line_id string, station_name string, station_type string, enabled boolean"
DEVICE = "device_id string, station_id string, device_model string, software_version string, hmac_secret binary, enabled boolean, last_seen_at timestamp"
BINDING = "collector_id string, device_id string, enabled boolean"
PROFILE = "device_id string, file_type string, profile_name string, enabled boolean"
ERROR_CODE = "error_code string, module_name string, title string, description string, recommended_action string, enabled boolean"
BATCH = "batch_id long, first_archive_id long, last_archive_id long, state string, segment_name string, source_file_count long, document_count long, segment_sha256 string, parsed_path string, parsed_sha256 string, failure_code string, created_at timestamp, published_at timestamp"
INDEXED = "archive_id long, batch_id long, parser_profile string, parser_version int, state string, document_count long, failure_code string, failure_line long, indexed_at timestamp"
DOCUMENT = "doc_id long, batch_id long, local_id long, archive_id long, byte_offset long, byte_length long, occurred_at_ms long, archived_at_ms long, term_count long, line_id string, station_id string, device_id string, collector_id string, work_order string, product_sn string, source_type string, level string, module_name string, error_code string, event_name string"
FILE = "batch_id long, archive_id long, file_size long, file_sha256 string, relative_path string"
POSTING = "batch_id long, term string, doc_id long, tf long"
TERM = "batch_id long, term string, df long, posting_begin long, posting_count long"
SIDECAR = "work_order string, product_sn string, file_type string, result string, produced_at string"
#: Columns of an archive row that may not be null.
ARCHIVE_REQUIRED = ("archive_id", "line_id", "station_id", "device_id", "collector_id", "file_type", "original_filename", "relative_path", "file_size", "file_sha256", "produced_at", "archived_at")
