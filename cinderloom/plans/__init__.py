"""The query catalogue: each module has QUERIES (name to function) and SQL (name to oracle text)."""

MODULES = ["general", "analytics", "sequences", "rewards", "parsing", "intervals", "samples", "tables", "building", "files", "contracts", "extras"]
