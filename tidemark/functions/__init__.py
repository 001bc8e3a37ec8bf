"""Column expressions: money, text keys, states, scores. No function here starts a job."""
