"""cinderloom: a Spark-native engine for rollout analytics and record curation."""
