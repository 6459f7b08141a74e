"""Stored archives hold the texts of their documents, however many are packed by a task."""

import zipfile

from workload import standins


def test_archives_hold_their_documents(spark, tmp_path):
    docs = [(i, f"text {i} ß" * (i % 4 + 1), "en") for i in range(95)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    paths = [r.path for r in standins.stored_archives(spark, str(tmp_path)).collect()]
    assert len(paths) == 10
    held = {}
    for path in paths:
        with zipfile.ZipFile(path.removeprefix("file:")) as archive:
            assert archive.namelist()[0] == "folder/"
            held |= {name: archive.read(name).decode() for name in archive.namelist()[1:]}
    assert sorted(held.values()) == sorted(text for _, text, _ in docs)
