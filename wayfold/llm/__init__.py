"""Training-data operators on whole tables. Nothing outside this folder imports it."""
