"""Queries over the test tables, with the inputs they are run on."""
