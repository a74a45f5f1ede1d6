"""Message flows on Spark: request records to audited, upserted, inspectable rows."""
