"""Quality measurements for intent and entity recognition, and for the text behind it, on Spark."""
