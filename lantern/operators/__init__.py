"""Table operators: detection, assessment, redaction, history."""
