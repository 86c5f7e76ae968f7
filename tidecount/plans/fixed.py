"""Values that the registered queries and their SQL share."""

SECRET = "tidecount-registered-queries"
SEED = 20251009
END_DAY = "2024-01-30"
BUCKET_K = 32
CAPS = {"dau": 3.0, "mau": 3.5}
