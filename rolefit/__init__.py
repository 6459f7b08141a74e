"""Candidate screening on Spark: profiles, scores, rankings, reports and mails over DataFrames."""
