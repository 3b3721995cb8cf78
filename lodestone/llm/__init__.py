"""Training-data operators: mixing, extraction, counting, search, scoring, filtering and output.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
