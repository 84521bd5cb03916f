"""Schemas that files are read with; nothing is inferred."""

EXIF = "struct<created_at string, created_at_source string, created_at_is_embedded boolean, camera string, gps struct<latitude double, longitude double>>"
QUALITY = "struct<has_embedded_capture_time boolean, has_camera_metadata boolean, has_gps boolean>"
REGISTRY = f"file_path string, file_name string, extension string, size_bytes bigint, hash_sha256 string, exif {EXIF}, metadata_quality {QUALITY}, raw_exif_keys array<string>, seq bigint"
EVENT_FILE = "struct<file_name string, file_path string, effective_timestamp string, effective_timestamp_source string, effective_timestamp_confidence string, effective_timestamp_precision string>"
EVENTS = f"cluster_id string, cluster_no bigint, event_day string, day_sequence bigint, timestamp_start string, timestamp_end string, file_count bigint, cluster_confidence string, timestamp_source_mix map<string,bigint>, timestamp_confidence_mix map<string,bigint>, files array<{EVENT_FILE}>"
PLAN = (
    "cluster_id string, event_day string, cluster_confidence string, cluster_file_count bigint, day_cluster_count bigint, review_recommended boolean, proposed_bucket string, "
    "proposed_action string, timestamp_start string, timestamp_end string, source_path string, proposed_folder string, proposed_destination string, file_name string, "
    "effective_timestamp string, effective_timestamp_source string, effective_timestamp_confidence string, effective_timestamp_precision string, is_document boolean, "
    "is_duplicate_secondary boolean, hash_sha256 string, seq bigint"
)
