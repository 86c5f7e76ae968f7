"""Schemas of the tables that the engine reads and writes, as DDL."""

EVENT = "seq long, user_id string, day date, op string, days array<date>"
WIRE_EVENT = "struct<user_id: string, op: string, day: string, metadata: string>"
ENVELOPE = f"event {WIRE_EVENT}, events array<{WIRE_EVENT}>"
ACTIVITY = "seq long, step int, day date, user_key string, user_root string, op string, metadata string"
ERASURE = "erasure_id long, user_root string, days array<date>, pending boolean, version long"
RELEASE = "id long, metric string, day date, period string, epsilon double, delta double, mechanism string, seed long"
RDP_RELEASE = "id long, metric string, day date, period string, alpha double, epsilon double"
REQUEST = "req_seq long, metric string, day date, period string, window_days int, epsilon double, delta double"
REQUEST_LOG = "ts timestamp, handler string, method string, status int, duration_s double, client string"
RESET = "metric string, period string, id long"
SNAPSHOT = "exact_count long, sketch string, sketch_impl string, day date"
