"""Reading and writing: databases, JSON inputs, result sinks and the stored corpus."""
