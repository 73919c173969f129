from otspark.plans import asset_queries, baseline_queries, field_queries, finding_queries, flow_queries, frame_queries, survey_queries  # noqa: F401  they register their queries
