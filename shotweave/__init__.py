"""Shot-curation analytics on Spark: timelines, shots, crops and audits as DataFrame operators."""
