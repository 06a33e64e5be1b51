"""Reserved tokens and the schemas of stored tables."""

# Tokens that pad a sequence.
START, END = "__START__", "__END__"

# Names and types of the stored tables.
TABLES: dict[str, str] = {
    "transitions": "prefix string, token string, cnt bigint, probability double",
    "sequence_freq": "sequence string, n bigint",
    "models": "model_key string, context string, entity_type string, entity_id string, kind_order int, payload string, stored_at timestamp, ttl bigint, expires_at timestamp",
    "anomalies": "model_key string, type string, sequence string, score double, count bigint, metadata string, detected_at timestamp, resolved_at timestamp",
    "pattern_alerts": "model_key string, pattern string, severity string, metadata string, dispatched_at timestamp",
    "cluster_profiles": "model_key string, cluster_id int, profile string, size bigint, metadata string",
    "model_snapshots": "uuid string, model_key string, tag string, storage string, description string, compressed boolean, encrypted boolean, original_size bigint, stored_size bigint, payload string, metadata string, created_at timestamp",
    "schedules": "uuid string, action string, model_key string, frequency string, time string, cron_expression string, callback string, enabled boolean, last_run_at timestamp, next_run_at timestamp, options string, created_at timestamp",
    "predictions": "prediction_type string, customer_id string, metric string, prediction_data string, confidence double, features string, generated_at timestamp, actioned_at timestamp, action_result string",
}
