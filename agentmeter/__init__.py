"""agentmeter: token, cost and context analytics over coding-agent transcripts, as Spark jobs."""
