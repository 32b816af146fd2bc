"""Network-security analytics as Spark jobs: flows, host context, scores, policies, blocks, metrics."""
